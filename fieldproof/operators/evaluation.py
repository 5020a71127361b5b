"""Evaluation of answers against the field specifications of their tasks.

Shape of the plan: task-side candidate forms are computed once per task, answers are normalised once
per prediction, both meet in one equi-join, and all checks run as array expressions of the joined
row. Three aggregates come from one GROUPING SETS pass over the rows.

Defined cases: a null answer is left out here and listed by `rejected`; a prediction without task
is left out and listed by `unknown_ids`; a task without specifications passes its field checks; a
label without rule fails the language check; null `required` counts as missing, which means true;
a null value is the text None in matching and no value in the exact-copy check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldproof.functions import matching as mt
from fieldproof.functions import text as tx
from fieldproof.functions.dictionaries import LANGUAGES, POLICIES

METRICS = [
    "language_accuracy", "target_script_present", "wrong_script_free", "language_marker_present", "field_coverage", "immutable_preservation", "entity_fidelity",
    "semantic_fidelity", "localization_quality", "hallucination_free", "faithful_localization_score", "core_pass",
]


def normalised_predictions(predictions: DataFrame) -> DataFrame:
    """(pred_id, id, method, answer): id falls back to sample_id where it is null or empty; a missing method is `unknown`."""
    return predictions.select("pred_id", F.coalesce(F.nullif("id", F.lit("")), F.nullif("sample_id", F.lit(""))).alias("id"), F.coalesce("method", F.lit("unknown")).alias("method"), "answer")


def rejected(predictions: DataFrame) -> DataFrame:
    """(pred_id, reason) of predictions that name no task or hold no answer."""
    p = normalised_predictions(predictions)
    return p.filter(F.col("id").isNull() | F.col("answer").isNull()).select("pred_id", F.when(F.col("id").isNull(), "no id").otherwise("no answer").alias("reason"))


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """One row per id: the last delivered line.

    One scan; earlier lines are dropped before the exchange already, where a partition holds several.
    """
    newest = Window.partitionBy("id").orderBy(F.col("line_no").desc())
    return tasks.filter(F.col("id").isNotNull()).withColumn("__nth", F.row_number().over(newest)).filter("__nth = 1").drop("__nth")


def unknown_ids(predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(pred_id, id) of predictions whose task isn't there."""
    return normalised_predictions(predictions).filter(F.col("id").isNotNull()).select("pred_id", "id").join(tasks.select("id"), "id", "left_anti").select("pred_id", "id")


def _table(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def specified_tasks(tasks: DataFrame) -> DataFrame:
    """(id, language, domain, expected, forbidden, specs): the checks of a task with all candidate forms.

    The distinct candidates of a task and the parts of those that enumerate are normalised in one
    vectorised pass; their forms are then made once per task.
    """
    language = F.coalesce("expected_answer_language", "user_language")
    specs = F.transform(
        F.filter(F.coalesce("field_specs", F.array().cast(dict(tasks.dtypes)["field_specs"])), lambda s: s.isNotNull()),
        lambda s: F.struct(
            s["path"].alias("path"),
            s["role"].alias("role"),
            F.coalesce(s["required"], F.lit(True)).alias("required"),
            F.coalesce(s["requires_localization"], F.lit(False)).alias("localize"),
            F.coalesce(s["value"], F.lit("")).alias("raw"),
            F.array_distinct(
                F.concat(
                    F.transform(F.coalesce(s["accepted_values"], mt.none()), lambda v: F.coalesce(v, F.lit("None"))),
                    F.array(F.coalesce(s["value"], F.lit("None"))),
                    mt.value_aliases(F.coalesce(s["value"], F.lit("None")), language, s["path"]),
                )
            ).alias("texts"),
            mt.code_aliases(s["path"], F.coalesce(s["value"], F.lit(""))).alias("code_texts"),
        ),
    )
    base = tasks.select("id", F.col("user_language").alias("language"), "domain", F.col("expected_answer_language").alias("expected"), F.coalesce("forbidden_hallucinations", mt.none()).alias("forbidden"), specs.alias("specs"))
    whole = base.withColumn("texts", F.array_distinct(F.flatten(F.transform("specs", lambda s: F.concat(s["texts"], s["code_texts"], F.array(s["raw"]))))))
    split = whole.withColumn("parts", F.transform("texts", tx.parts_of))
    every = split.withColumn("every", F.array_distinct(F.concat("texts", F.flatten("parts"))))
    plain = every.withColumn("plain", F.transform(tx.nfkc_array("every"), tx.ascii_thai_digits))
    formed = plain.withColumn("forms", F.zip_with("every", "plain", mt.candidate_forms))
    listed = formed.withColumn("form_of", _table(F.col("every"), F.col("forms"))).withColumn("plain_of", _table(F.col("every"), F.col("plain")))

    def candidate(text: Column, parts: Column, form_of: Column) -> Column:
        enumerated = (F.size(form_of[text]["dates"]) == 0) & (F.size(parts) >= 2)
        return F.struct(form_of[text].alias("one"), F.when(enumerated, F.transform(parts, lambda p: form_of[p])).otherwise(F.slice(F.array(form_of[text]), 1, 0)).alias("parts"))

    shaped = listed.withColumn("candidate_of", _table(F.col("texts"), F.zip_with("texts", "parts", lambda x, y: candidate(x, y, F.col("form_of")))))
    with_forms = F.transform(
        "specs",
        lambda s: F.struct(
            s["path"].alias("path"), s["role"].alias("role"), s["required"].alias("required"), s["localize"].alias("localize"), s["raw"].alias("raw"), F.col("plain_of")[s["raw"]].alias("plain"),
            F.transform(s["texts"], lambda t: F.col("candidate_of")[t]).alias("candidates"),
            F.transform(s["code_texts"], lambda t: F.col("candidate_of")[t]).alias("codes"),
        ),
    )
    return shaped.select("id", "language", "domain", "expected", "forbidden", with_forms.alias("specs"))


def phrase_hits(lower: Column, phrases: Column) -> Column:
    """The phrases, neither null nor empty, that a lower-case text holds in any case."""
    return F.filter(phrases, lambda p: p.isNotNull() & (p != "") & F.contains(lower, F.lower(p)))


def _ratio(ok: Column, of: Column) -> Column:
    return F.when(F.size(of) == 0, F.lit(1.0)).otherwise(F.size(ok) / F.size(of))


def evaluate(predictions: DataFrame, tasks: DataFrame, policy: str = "strict") -> DataFrame:
    """One row per prediction with a task and an answer: verdicts, metrics and lists of failing fields."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    relaxed = policy == "relaxed"
    answers = normalised_predictions(predictions).filter(F.col("answer").isNotNull() & F.col("id").isNotNull()).withColumn("plain", tx.nfkc("answer"))
    # the hash is a key of its own so that tasks, partitioned by id already, are exchanged for the join; a hot task is then split at run time
    spread = F.xxhash64("id").alias("spread")
    joined = answers.select("*", spread).join(specified_tasks(latest_tasks(tasks)).select("*", spread), ["id", "spread"])

    def checks(a: Column) -> Column:
        def coded(s: Column) -> Column:
            return (F.size(s["codes"]) > 0) & (mt.has_code(a["plain"], s["plain"]) | mt.any_match(a, s["codes"])) if relaxed else F.lit(False)

        def under(s: Column) -> Column:
            others = F.filter(s["candidates"], lambda c: c["one"]["lower"] != F.lower(s["raw"]))
            local = s["localize"] & F.coalesce(F.col("expected") != "en", F.lit(True))
            return local & F.lower(s["raw"]).rlike(r"\p{L}") & F.contains(a["lower"], F.lower(s["raw"])) & ~mt.any_match(a, others)

        def verdict(s: Column, code: Column) -> Column:
            return F.struct(
                s["path"].alias("path"),
                s["role"].alias("role"),
                (code | mt.any_match(a, s["candidates"])).alias("present"),
                ((s["raw"] == "") | F.contains(a["text"], s["raw"]) | code).alias("copied"),
                under(s).alias("under"),
            )

        seen = F.transform(F.filter("specs", lambda s: s["required"]), lambda s: tx.bound(coded(s), lambda code: verdict(s, code)))
        hits = phrase_hits(a["raw_lower"], F.col("forbidden"))
        return F.struct(seen.alias("seen"), hits.alias("hits"), mt.language_diagnostics(a["text"], a["lower"], a["match"], a["loose"], F.col("expected")).alias("lang"))

    looked = joined.select("pred_id", "id", "method", "language", "domain", "expected", tx.bound(mt.answer_forms(F.col("answer"), tx.ascii_thai_digits(F.col("plain"))), checks).alias("c"))

    def paths(of: Column) -> Column:
        return F.transform(of, lambda s: s["path"])

    seen = F.col("c.seen")
    semantic = F.concat(F.filter(seen, lambda s: s["role"] == "semantic"), F.filter(seen, lambda s: s["role"] == "status"))
    groups = {"all": (seen, "present"), "immutable": (F.filter(seen, lambda s: s["role"] == "immutable"), "copied"), "entity": (F.filter(seen, lambda s: s["role"] == "entity"), "present"), "semantic": (semantic, "present")}

    def passing(specs: Column, verdict: str) -> Column:
        return F.filter(specs, lambda s: s[verdict])

    grouped = looked.select(
        "pred_id", "id", "method", "language", "domain", "c",
        *[passing(specs, key).alias(f"ok_{name}") for name, (specs, key) in groups.items()],
        *[specs.alias(f"of_{name}") for name, (specs, _) in groups.items()],
    )

    def failing(name: str) -> Column:
        passed = paths(F.col(f"ok_{name}"))
        return F.filter(paths(F.col(f"of_{name}")), lambda p: ~F.array_contains(passed, p))

    one = lambda c: c.cast("double")
    scored = grouped.select(
        "pred_id", "id", "method", F.lit(policy).alias("evaluation_policy"), "language", "domain",
        one(F.col("c.lang.match")).alias("language_accuracy"),
        one(F.col("c.lang.target")).alias("target_script_present"),
        one(~F.col("c.lang.wrong")).alias("wrong_script_free"),
        one(F.col("c.lang.marker")).alias("language_marker_present"),
        _ratio(F.col("ok_all"), F.col("of_all")).alias("field_coverage"),
        _ratio(F.col("ok_immutable"), F.col("of_immutable")).alias("immutable_preservation"),
        _ratio(F.col("ok_entity"), F.col("of_entity")).alias("entity_fidelity"),
        _ratio(F.col("ok_semantic"), F.col("of_semantic")).alias("semantic_fidelity"),
        one(~F.exists("c.seen", lambda s: s["under"])).alias("localization_quality"),
        one(F.size("c.hits") == 0).alias("hallucination_free"),
        failing("all").alias("missing_fields"),
        failing("immutable").alias("immutable_corruptions"),
        failing("entity").alias("entity_mismatches"),
        failing("semantic").alias("semantic_mismatches"),
        paths(F.filter("c.seen", lambda s: s["under"])).alias("underlocalized_fields"),
        F.col("c.hits").alias("forbidden_hits"),
    )
    seven = [F.col(x) for x in ("language_accuracy", "field_coverage", "immutable_preservation", "entity_fidelity", "semantic_fidelity", "localization_quality", "hallucination_free")]
    total, perfect = seven[0], seven[0] == 1.0
    for x in seven[1:]:
        total, perfect = total + x, perfect & (x == 1.0)
    return scored.withColumn("faithful_localization_score", total / 7).withColumn("core_pass", perfect)


def unsupported_languages(tasks: DataFrame) -> DataFrame:
    """(id, label) of tasks whose expected language has no rule."""
    return tasks.filter(F.col("expected_answer_language").isNull() | ~F.col("expected_answer_language").isin(LANGUAGES)).select("id", F.col("expected_answer_language").alias("label")).distinct()


def reports(rows: DataFrame) -> DataFrame:
    """Means of all metrics by method, by method and language, and by method and domain, in one pass.

    `report` tells them apart; keys that a report doesn't have are null.
    """
    source = rows.withColumn("core_pass", F.col("core_pass").cast("double"))
    out = source.groupingSets([["method"], ["method", "language"], ["method", "domain"]], "method", "language", "domain").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS]
    )
    # grouping_id has a bit per key, set where the key isn't grouped by: 3 neither, 1 language, 2 domain
    report = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "by_language").otherwise("by_domain")
    return out.select(report.alias("report"), "method", "language", "domain", "n", *METRICS)


def duplicate_ids(tasks: DataFrame) -> DataFrame:
    """(id, n) of ids delivered more than once."""
    return tasks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
