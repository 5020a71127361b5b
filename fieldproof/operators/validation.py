"""Checks of a task table, deterministic splits and condition balance.

Instead of failing at the first bad row, every check gives a row of violations; `first_violation`
is the one a fail-fast reader would report (smallest line, then order of checks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldproof.functions.dictionaries import ROLES, TASK_LANGUAGES

# The columns without which a task can't be used.
REQUIRED = ["domain", "expected_answer_language", "field_specs", "forbidden_hallucinations", "id", "required_fields", "source_record_id", "tool_name", "tool_result", "user_language", "user_query"]
MAIN_ROWS, MAIN_DOMAINS = 1024, 32
BALANCED_ROWS, CONDITIONS, CONDITION_ROWS = 448, 7, 64
# The split of each id suffix.
SUFFIX_SPLIT = {"001": "dev", "003": "dev", "002": "test", "004": "test"}


def violations(tasks: DataFrame) -> DataFrame:
    """(line_no, priority, id, message), one row per failed check of a line.

    A null column counts as missing; an empty id is invalid; of lines with one id all but the first
    are duplicates; a null specification is one without path.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    paths = F.transform("field_specs", lambda s: s["path"])
    uncovered = F.array_sort(F.array_except(F.array_compact("required_fields"), F.coalesce(paths, F.array().cast("array<string>"))))
    roles = F.transform("field_specs", lambda s: F.coalesce(s["role"], F.lit("None")))
    bad_role = F.try_element_at(F.filter(roles, lambda r: ~r.isin(ROLES)), F.lit(1))
    first = tasks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")).filter("n > 1").select("id", "first_line")
    checks = [
        (1, F.size(missing) > 0, F.concat(F.lit("missing required keys: "), F.array_join(missing, ", "))),
        (2, F.col("id") == "", F.lit("invalid id")),
        (3, F.col("line_no") > F.col("first_line"), F.concat(F.lit("duplicate id: "), F.col("id"))),
        (4, F.exists("field_specs", lambda s: s["path"].isNull() | (s["path"] == "")), F.lit("field specification without a path")),
        (5, bad_role.isNotNull(), F.concat(F.lit("unsupported field role: "), bad_role)),
        (6, F.size(uncovered) > 0, F.concat(F.lit("required fields without specs: "), F.array_join(uncovered, ", "))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(p).alias("priority"), message.alias("message"))) for p, test, message in checks]))
    rows = tasks.join(first, "id", "left")
    return rows.select("line_no", "id", F.explode(found).alias("x")).select("line_no", "x.priority", "id", "x.message")


def first_violation(tasks: DataFrame) -> DataFrame:
    """The one violation that a reader in line order meets first."""
    return violations(tasks).orderBy("line_no", "priority").limit(1)


def summary(tasks: DataFrame) -> DataFrame:
    """Rows, distinct ids and domains, and the sorted languages, in one aggregate."""
    return tasks.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("unique_ids"), F.countDistinct("domain").alias("domains"), F.array_join(F.array_sort(F.collect_set("user_language")), ",").alias("languages"))


def main_problems(tasks: DataFrame, expected_rows: int | None = MAIN_ROWS) -> DataFrame:
    """(problem) of a main table: its shape, then the first failed check of a line; no row means it is valid."""
    return shape_problems(tasks, expected_rows).unionByName(first_violation(tasks).select(F.col("message").alias("problem")))


def attribution_problems(tasks: DataFrame, column: str = "attribution_condition", expected_rows: int | None = BALANCED_ROWS) -> DataFrame:
    """(problem) of an attribution table: rows, lines, and conditions that are missing or, at the released size, unbalanced."""
    counts = tasks.groupBy(F.col(column).alias("condition")).agg(F.count("*").alias("n"))
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "condition", "n"))), ", ")
    spread = counts.agg(F.count_if(F.col("condition").isNull()).alias("nulls"), F.count("condition").alias("groups"), F.min("n").alias("low"), F.max("n").alias("high"), shown.alias("shown"))
    uneven = (F.col("groups") != CONDITIONS) | (F.col("low") != CONDITION_ROWS) | (F.col("high") != CONDITION_ROWS)
    tests = [
        F.when(F.col("nulls") > 0, F.lit("a row has no condition")),
        F.when(F.lit(expected_rows == BALANCED_ROWS) & F.coalesce(uneven, F.lit(True)), F.concat(F.lit("unexpected condition balance: "), "shown")),
    ]
    conditions = spread.select(F.explode(F.array_compact(F.array(*tests))).alias("problem"))
    return main_problems(tasks, expected_rows).unionByName(conditions)


def split_problems(split: DataFrame) -> DataFrame:
    """(id, problem) of ids that no split takes, or that more than one does: none where splits are exhaustive and disjoint."""
    per = split.groupBy("id").agg(F.countDistinct("split").alias("splits"))
    return per.filter("splits <> 1").select("id", F.when(F.col("splits") == 0, "in no split").otherwise("in several splits").alias("problem"))


def split_balance(tasks: DataFrame) -> DataFrame:
    """(split, n_rows, n_ids, n_domains, n_languages): what each split holds; a null split is a row of its own."""
    return tasks.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.countDistinct("domain").alias("n_domains"), F.countDistinct("user_language").alias("n_languages"))


def shape_problems(tasks: DataFrame, expected_rows: int | None = MAIN_ROWS) -> DataFrame:
    """(problem) of a table as a whole: rows, and for the released size also languages and domains."""
    s = tasks.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("user_language")).alias("languages"), F.countDistinct("domain").alias("domains"))
    released = expected_rows == MAIN_ROWS
    tests = [
        F.when(F.col("n") == 0, F.lit("dataset is empty")),
        F.when(F.lit(expected_rows is not None) & (F.col("n") != F.lit(expected_rows or 0)), F.format_string(f"expected {expected_rows} rows, found %d", "n")),
        F.when(F.lit(released) & (F.col("languages") != F.array(*map(F.lit, TASK_LANGUAGES))), F.concat(F.lit("unexpected languages: "), F.array_join("languages", ","))),
        F.when(F.lit(released) & (F.col("domains") != MAIN_DOMAINS), F.format_string(f"expected {MAIN_DOMAINS} domains, found %d", "domains")),
    ]
    return s.select(F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def condition_counts(tasks: DataFrame, column: str) -> DataFrame:
    """(condition, n), sorted; a null condition is a row of its own."""
    return tasks.groupBy(F.col(column).alias("condition")).agg(F.count("*").alias("n")).orderBy("condition")


def balanced(tasks: DataFrame, column: str, groups: int = CONDITIONS, rows: int = CONDITION_ROWS) -> DataFrame:
    """(balanced): whether there are as many conditions as wanted, each with as many rows, and none is null."""
    counts = condition_counts(tasks, column)
    return counts.agg(((F.count("*") == groups) & (F.coalesce(F.min("n"), F.lit(0)) == rows) & (F.coalesce(F.max("n"), F.lit(0)) == rows) & (F.count(F.when(F.col("condition").isNull(), 1)) == 0)).alias("balanced"))


def suffix_split(tasks: DataFrame) -> DataFrame:
    """(line_no, id, source_record_id, split) by the part of the id after the last underscore; null for others."""
    suffix = F.substring_index("id", "_", -1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_SPLIT.items() for x in pair])
    return tasks.select("line_no", "id", "source_record_id", F.try_element_at(table, suffix).alias("split"))


def split_leaks(split: DataFrame) -> DataFrame:
    """(source_record_id, n_splits, n_rows) of records that are in more than one split."""
    per = split.filter(F.col("split").isNotNull() & F.col("source_record_id").isNotNull()).groupBy("source_record_id").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n_rows"))
    return per.filter("n_splits > 1")


def split_ids(split: DataFrame, name: str) -> DataFrame:
    """The ids of one split, in code-point order."""
    return split.filter(F.col("split") == name).select("id").orderBy("id")


def split_differences(committed: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(id, side) of ids that only one of two lists has, counting repetitions."""
    return committed.select("id").exceptAll(regenerated.select("id")).withColumn("side", F.lit("committed")).unionByName(
        regenerated.select("id").exceptAll(committed.select("id")).withColumn("side", F.lit("regenerated"))
    )
