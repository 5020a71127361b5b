"""Placeholders in place of protected values, their restoration, and the messages made of tasks.

Slots keep the order in which their paths first occur. Results are JSON texts whose members at the
top level may be replaced; that rewrite runs in one vectorised pass, because the members differ by
domain and scalar texts must survive unchanged. Slots are made below these passes, never as an
argument of a Python function, which can't hold array functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldproof.functions.dictionaries import METHODS
from fieldproof.functions.jsontext import UNREADABLE, read_json

# The roles whose values are protected, and the form of a placeholder.
PROTECTED_ROLES = ["entity", "immutable", "semantic"]
OPEN, CLOSE = "[[FIELD_", "]]"
SLOTS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("path", "placeholder", "role")]))
# Fixed value: how the message of a task begins.
INSTRUCTION = "Generate the final user-facing answer for this post-tool stage. Return only the answer.\n"


def placeholder(path: Column) -> Column:
    """The placeholder of a path."""
    return F.concat(F.lit(OPEN), path, F.lit(CLOSE))


def slot_map(specs: Column | str = "field_specs", localizable: Column | str = "localizable_fields") -> Column:
    """array<struct<path, placeholder, role>> of the protected fields; role is that of the first specification of the path.

    Fields without path or value, localisable ones and those of other roles have no slot; a null
    list gives no slots.
    """
    specs = F.col(specs) if isinstance(specs, str) else specs
    local = F.coalesce(F.col(localizable) if isinstance(localizable, str) else localizable, F.array().cast("array<string>"))
    kept = F.filter(specs, lambda s: (s["path"] != "") & (s["value"] != "") & s["role"].isin(PROTECTED_ROLES) & ~F.coalesce(F.array_contains(local, s["path"]), F.lit(False)))
    paths = F.array_distinct(F.transform(kept, lambda s: s["path"]))
    slots = F.transform(paths, lambda p: F.struct(p.alias("path"), placeholder(p).alias("placeholder"), F.filter(specs, lambda s: s["path"] == p)[0]["role"].alias("role")))
    return F.coalesce(slots, F.array().cast(SLOTS))


def text_of(value) -> str:
    """The text a JSON value has in an answer: strings as they are, true and null as True and None."""
    return value if isinstance(value, str) else str(value)


def _rewritten(result: str | None, slots) -> str | None:
    value = read_json(result)
    if value is UNREADABLE or not isinstance(value, dict):
        return result
    return json.dumps(value | {s["path"]: s["placeholder"] for s in slots if s["path"] in value}, ensure_ascii=False)


def protect(tasks: DataFrame) -> DataFrame:
    """Tasks with placeholders in tool_result, values, accepted values and evaluation_values, and their slots as `protected_slots`.

    evaluation_values, a map of lists by path, is rewritten where tasks have such a column.
    Unreadable results stay as they are; tasks without slots get an empty list.
    """
    slotted = tasks.withColumn("protected_slots", slot_map())
    result, slots = slotted.columns.index("tool_result"), slotted.columns.index("protected_slots")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_rewritten(r, s) if s else r for r, s in zip(batch.column(result).to_pylist(), batch.column(slots).to_pylist())]
            columns = batch.columns
            columns[result] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    rewritten = slotted.mapInArrow(rewrite, slotted.schema)
    paths = F.transform("protected_slots", lambda s: s["path"])
    changed = {
        "field_specs": F.transform(
            "field_specs",
            lambda s: F.when(
                F.array_contains(paths, s["path"]), s.withField("value", placeholder(s["path"])).withField("accepted_values", F.array(placeholder(s["path"])))
            ).otherwise(s),
        )
    }
    if "evaluation_values" in tasks.columns:
        changed["evaluation_values"] = F.transform_values("evaluation_values", lambda k, v: F.when(F.array_contains(paths, k), F.array(placeholder(k))).otherwise(v))
    return rewritten.withColumns(changed)


def slot_values(tasks: DataFrame) -> DataFrame:
    """(id, slots): the slots with the text of the top-level member of tool_result, empty where there is none."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("placeholder", pa.string()), ("value", pa.string())]))
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                value = read_json(text) if own else None
                value = value if isinstance(value, dict) else {}
                out.append([{"placeholder": s["placeholder"], "value": text_of(value.get(s["path"], ""))} for s in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "slots"])

    return tasks.select("id", "tool_result", slot_map().alias("slots")).mapInArrow(values, "id string, slots array<struct<placeholder: string, value: string>>")


def restored(answer: Column, slots: Column) -> Column:
    """The answer with each placeholder replaced in slot order; a restored value may hold a later placeholder."""
    return F.aggregate(slots, answer, lambda text, s: F.replace(text, s["placeholder"], s["value"]))


def restore_answers(predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(pred_id, id, answer) with placeholders restored; predictions without task keep their answer."""
    own = slot_values(tasks)
    return predictions.join(own, "id", "left").select("pred_id", "id", F.when(F.col("slots").isNull(), F.col("answer")).otherwise(restored(F.col("answer"), F.col("slots"))).alias("answer"))


def render_messages(tasks: DataFrame, prompts: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """(id, method, messages): a system and a user message per task and method.

    prompts: (method, text), as many rows as methods. The tasks are protected for the method that
    asks for it. The payload is indented JSON; columns that a task doesn't have are left out.
    """
    wanted = methods or METHODS
    if unknown := sorted(set(wanted) - set(METHODS)):
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    protected = [m for m in wanted if m == "protected_slot_realization"]
    plain = [m for m in wanted if m not in protected]
    parts = []
    if plain:
        parts.append(tasks.withColumn("protected_slots", F.lit(None).cast(SLOTS)).withColumn("method", F.explode(F.array(*map(F.lit, plain)))))
    if protected:
        parts.append(protect(tasks).withColumn("method", F.lit(protected[0])))
    rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    policy = F.transform(
        "field_specs",
        lambda s: F.struct(
            s["path"].alias("path"), s["role"].alias("role"), F.coalesce(s["required"], F.lit(True)).alias("required"), s["description"].alias("description"), F.coalesce(s["requires_localization"], F.lit(False)).alias("requires_localization")
        ),
    )
    fixed = ["id", "user_language", "expected_answer_language", "user_query", "tool_name", "tool_result", "required_fields", "preserve_exact_fields", "localizable_fields", "forbidden_hallucinations"]
    optional = [c for c in ("immutable_fields", "entity_fields", "semantic_fields", "field_descriptions", "tool_source", "protected_slots") if c in rows.columns]
    payload = F.to_json(F.struct(*fixed, *optional, policy.alias("field_policy")), {"ignoreNullFields": "false"})

    def indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(text: str) -> str:
            value = json.loads(text)
            result = read_json(value["tool_result"])
            value["tool_result"] = value["tool_result"] if result is UNREADABLE else result
            for name in optional:
                if not value.get(name):
                    value.pop(name, None)
            if not value.get("field_policy"):
                value.pop("field_policy", None)
            return INSTRUCTION + json.dumps(value, ensure_ascii=False, indent=2)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([one(x) for x in batch.column(2).to_pylist()], pa.string())], names=["id", "method", "content"])

    messages = rows.select("id", "method", payload.alias("content")).mapInArrow(indented, "id string, method string, content string")
    # the prompts are one short text per method, so they become a literal and not a side of a join
    known = {r["method"]: r["text"] for r in prompts.filter(F.col("method").isin(wanted)).select("method", "text").collect()}
    system = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.lit(None).cast("map<string, string>")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return messages.filter(F.col("method").isin(list(known))).select("id", "method", F.array(message("system", F.try_element_at(system, F.col("method"))), message("user", F.col("content"))).alias("messages"))
