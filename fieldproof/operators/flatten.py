"""Deeply nested records as related flat tables.

One pass over the records: a depth-first visitor emits for every object a table tag (its path
without list positions), its key (path), the key of the enclosing object and its scalar members.
The emission is written partitioned by tag, and each table is then read with a schema of its own.
No shuffle is needed to emit, and a record is never held beyond its own batch.

Defined cases: a null, cut-off or otherwise unreadable text gives no rows; a null or empty list
of objects gives no rows; null elements are counted but give no row; an empty object gives a row
with an empty payload; repeated records give their rows again, told apart by the record key.
Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldproof.functions.jsontext import UNREADABLE, objects, read_json

EMITTED = "record_key bigint, table_tag string, node_path string, parent_path string, payload string"


def emit_nodes(df: DataFrame, key: str, json_columns: list[str], struct_columns: list[str], payload: bool = True) -> DataFrame:
    """(record_key, table_tag, node_path, parent_path, payload) of every object of every record.

    json_columns hold JSON texts; struct_columns hold arrays of structs, whose elements are taken
    as objects (JSON inside their strings stays a string). payload: the scalar members as a JSON
    object, or null where it isn't asked for.
    """
    picked = df.select(
        F.col(key).cast("bigint").alias("k"),
        *[F.col(c).alias(f"j{i}") for i, c in enumerate(json_columns)],
        *[F.to_json(F.col(c)).alias(f"s{i}") if payload else F.transform(F.col(c), lambda x: x.isNotNull()).alias(f"s{i}") for i, c in enumerate(struct_columns)],
    )
    digits = re.compile(r"\[\d+\]")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            out: list[list] = [[], [], [], [], []]
            keys, tags, paths, parents, payloads = out

            def add(k: int, path: str, parent: str, node: dict) -> None:
                keys.append(k)
                tags.append(digits.sub("", path))
                paths.append(path)
                parents.append(parent)
                payloads.append(json.dumps({m: v for m, v in node.items() if not isinstance(v, (dict, list))}, ensure_ascii=False) if payload else None)

            for i, name in enumerate(json_columns):
                for k, text in zip(columns["k"], columns[f"j{i}"]):
                    if text is not None and (value := read_json(text)) is not UNREADABLE:
                        for path, parent, node in objects(value, name):
                            add(k, path, parent, node)
                columns[f"j{i}"] = None
            for i, name in enumerate(struct_columns):
                for k, elements in zip(columns["k"], columns[f"s{i}"]):
                    if payload and elements is not None:
                        elements = json.loads(elements)
                    for n, element in enumerate(elements or ()):
                        if element is None or element is False:
                            continue
                        if element is True:
                            add(k, f"{name}[{n}]", "", {})
                        else:
                            for path, parent, node in objects(element, f"{name}[{n}]"):
                                add(k, path, parent, node)
            for start in range(0, len(keys), 20_000):
                part = slice(start, start + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int64()), *[pa.array(x[part], pa.string()) for x in out[1:]]], names=["record_key", "table_tag", "node_path", "parent_path", "payload"])

    return picked.mapInArrow(visit, EMITTED)


def write_tables(nodes: DataFrame, folder: str, compact: bool = False) -> None:
    """Writes the emission partitioned by table tag; one scan, and readers prune to their tag.

    compact: rows of a tag are brought together first, which costs one exchange of the emission and
    saves files where many tasks hold rows of many tags; large tags are split at run time.
    """
    (nodes.hint("rebalance", "table_tag") if compact else nodes).write.mode("overwrite").partitionBy("table_tag").parquet(folder)


def table_schemas(nodes: DataFrame) -> dict[str, T.StructType]:
    """The schema of every table, from the members of all its payloads.

    Whole numbers are bigint, other numbers double; members of several types, of numbers over 64
    bits or of nulls only are strings.
    """

    def kind(v: object) -> str:
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, int):
            return "bigint" if -(2**63) <= v < 2**63 else "string"
        return "double" if isinstance(v, float) else "null" if v is None else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(t, m, kind(v)) for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m, v in (json.loads(p) or {"": None}).items()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["tag", "member", "kind"])

    members: dict[str, dict[str, set[str]]] = {}
    for r in nodes.select("table_tag", "payload").mapInArrow(run, "tag string, member string, kind string").distinct().collect():
        members.setdefault(r["tag"], {}).setdefault(r["member"], set()).add(r["kind"])
    types = {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType()}

    def merged(kinds: set[str]) -> T.DataType:
        known = kinds - {"null"}
        return types["double"] if known == {"bigint", "double"} else types.get(next(iter(known), ""), T.StringType()) if len(known) == 1 else T.StringType()

    return {tag: T.StructType([T.StructField(m, merged(k)) for m, k in sorted(many.items()) if m]) for tag, many in sorted(members.items())}


def read_table(nodes: DataFrame, tag: str, schema: T.StructType | str) -> DataFrame:
    """One flat table: the rows of a tag with the payload parsed by `schema`.

    Members missing from a payload are null, members missing from the schema are dropped. The key
    columns come first; a member that is named like one of them is kept as `<name>_`.
    """
    parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    keys = ["record_key", "node_path", "parent_path"]
    if not parsed.fields:
        return nodes.filter(F.col("table_tag") == tag).select(*keys)
    return (
        nodes.filter(F.col("table_tag") == tag)
        .select(*keys, F.from_json("payload", parsed).alias("p"))
        .select(*keys, *[F.col("p").getField(f.name).alias(f.name + "_" if f.name in keys else f.name) for f in parsed.fields])
    )


def table_counts(nodes: DataFrame, schemas: dict[str, T.StructType]) -> DataFrame:
    """(table_tag, member, n): per table of a written emission, read with its schema, its rows (member null) and the values of each member."""
    out: DataFrame | None = None
    for tag, schema in schemas.items():
        flat = read_table(nodes, tag, schema)
        members = flat.columns[3:]
        counts = flat.agg(F.array(F.count("*"), *[F.count(F.col(f"`{m}`")) for m in members]).alias("n"))
        names = F.array(F.lit(None).cast("string"), *map(F.lit, members))
        one = counts.select(F.lit(tag).alias("table_tag"), F.inline(F.arrays_zip(names.alias("member"), "n")))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else nodes.sparkSession.createDataFrame([], "table_tag string, member string, n bigint")


def table_report(nodes: DataFrame) -> dict[str, dict[str, int]]:
    """Per table of a written emission, read with its schema: its rows, and the values of each member."""
    out: dict[str, dict[str, int]] = {}
    for r in table_counts(nodes, table_schemas(nodes)).collect():
        out.setdefault(r["table_tag"], {})[r["member"] or "rows"] = r["n"]
    return out
