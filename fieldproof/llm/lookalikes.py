"""Pairs of texts that look alike but are stored with other characters (problem 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from fieldproof.functions.jsontext import UNREADABLE, read_json
from fieldproof.llm.canon import canonical, is_empty, per_distinct
from fieldproof.llm.standins import task_key


@F.pandas_udf(T.StringType())
def canonical_udf(text: pd.Series) -> pd.Series:
    """canonical() of each distinct value."""
    return pd.Series(per_distinct(text, canonical), dtype=object)


@F.pandas_udf(T.StringType())
def shown_form_udf(text: pd.Series) -> pd.Series:
    """canonical() of each answer that isn't empty, else null."""
    return pd.Series(per_distinct(text, lambda x: None if is_empty(x) else canonical(x)), dtype=object)


def _looks(predictions: DataFrame) -> DataFrame:
    """(pred_id, t1, look, look2, stored) of the answers that show something; 64 bits of the task, twice 64 of the look, and 64 of the stored text."""
    form = F.col("form")
    return (
        predictions.filter(F.col("answer").isNotNull())
        .select("pred_id", task_key().alias("task"), "answer", shown_form_udf("answer").alias("form"))
        .filter(form.isNotNull() & F.col("task").isNotNull() & (F.col("task") != ""))
        .select("pred_id", F.xxhash64("task").alias("t1"), F.xxhash64("task", form).alias("look"), F.xxhash64(form, F.lit(7)).alias("look2"), F.xxhash64("answer").alias("stored"))
    )


def look_classes(predictions: DataFrame) -> DataFrame:
    """(pred_id, class, n_links): each answer with a task, the class of answers of the task with its look, and how many of them are stored differently.

    The form for tables in which one answer is repeated very often: no pair is made.
    """
    keys = ["t1", "look", "look2"]
    rows = _looks(predictions)
    stored = rows.groupBy(*keys, "stored").agg(F.count("*").alias("same"))
    whole = stored.groupBy(*keys).agg(F.sum("same").alias("n"))
    counted = stored.join(whole, keys).select(*keys, "stored", (F.col("n") - F.col("same")).alias("n_links"))
    return rows.join(counted, [*keys, "stored"]).select("pred_id", F.concat(F.lower(F.hex("look")), F.lower(F.hex("look2"))).alias("class"), "n_links")


def look_alike_answers(predictions: DataFrame) -> DataFrame:
    """(key_a, key_b), a < b, of two predictions of one task that look alike but differ as stored.

    Rows are reduced to hashes before the shuffle. Only looks that are stored in more than one way
    take part in the pairing, which is an equi-join on (task, look) that the engine may split where
    a task is hot; equal copies are never paired with each other. Rows without task are left out.
    """
    rows = _looks(predictions)
    keys = ["t1", "look", "look2"]
    mixed = rows.groupBy(*keys).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo <> hi").select(*keys)
    kept = rows.join(mixed, keys, "left_semi")
    a = kept.withColumnsRenamed({"pred_id": "key_a", "stored": "sa"})
    b = kept.withColumnsRenamed({"pred_id": "key_b", "stored": "sb"})
    return a.join(b, keys).filter("key_a < key_b AND sa <> sb").select("key_a", "key_b")


STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def value_at(value: Any, path: str) -> Any:
    """The value at a path like a.b[0].c, from the outermost object; UNREADABLE if there is none."""
    while isinstance(value, list):
        value = next((x for x in value if isinstance(x, (dict, list))), UNREADABLE)
    for name, index in STEP.findall(path):
        if name and isinstance(value, dict) and name in value:
            value = value[name]
        elif index and isinstance(value, list) and int(index) < len(value):
            value = value[int(index)]
        else:
            return UNREADABLE
    return value


def look_alike_values(tasks: DataFrame) -> DataFrame:
    """(line_no, pos) of the field specifications whose value looks like the string at its path but differs."""
    picked = tasks.filter(F.col("tool_result").isNotNull() & (F.size("field_specs") > 0)).select(
        "line_no", "tool_result", F.transform("field_specs", lambda s: s["path"]).alias("paths"), F.transform("field_specs", lambda s: s["value"]).alias("values")
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines, places = [], []
            for line, text, paths, values in zip(b["line_no"], b["tool_result"], b["paths"], b["values"]):
                result = read_json(text)
                if result is UNREADABLE:
                    continue
                for pos, (path, value) in enumerate(zip(paths, values)):
                    if path is None or value is None:
                        continue
                    stored = value_at(result, path)
                    if isinstance(stored, str) and stored != value and canonical(stored) == canonical(value):
                        lines.append(line)
                        places.append(pos)
            if lines:
                yield pd.DataFrame({"line_no": lines, "pos": places})

    return picked.mapInPandas(look, "line_no bigint, pos bigint")
