"""Line-delimited JSON, id lists, prompt texts and report documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TASK_SCHEMA = (
    "id string, domain string, source_record_id string, user_language string, expected_answer_language string, user_query string, tool_name string, "
    "tool_result string, field_specs array<struct<path: string, role: string, value: string, accepted_values: array<string>, required: boolean, requires_localization: boolean, description: string>>, "
    "required_fields array<string>, forbidden_hallucinations array<string>, preserve_exact_fields array<string>, localizable_fields array<string>, attribution_condition string"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of the lines that aren't blank. line_no orders lines within and across files; it isn't consecutive."""
    text = spark.read.text(path).select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("line_no"))
    return text.filter(F.trim("raw") != "").select("line_no", "raw")


def line_problem(raw: Column) -> Column:
    """Why a line holds no record: it is no JSON, or no object; null for a record and for null."""
    value = F.try_parse_json(raw)
    return F.when(raw.isNotNull() & value.isNull(), F.lit("invalid JSON")).when(~F.schema_of_variant(value).startswith("OBJECT"), F.lit("not an object"))


def line_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, problem) of every line that isn't blank and holds no record; lines count from 1 in each file, blank ones too.

    Rows of one stretch of a file are numbered as they are read. What the stretches before it hold is
    summed up from one count per stretch, so no file is ever read by a single task.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw")
    )
    stretches = text.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = stretches.select("file", "start", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))
    wrong = text.filter(F.trim("raw") != "").select("file", "start", "at", line_problem(F.col("raw")).alias("problem")).filter("problem IS NOT NULL")
    return wrong.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "problem")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Typed tasks of a line-delimited file with their line_no; tool_result stays JSON text, unknown members are dropped."""
    rows = lines(spark, path)
    parsed = rows.select("line_no", F.from_json("raw", TASK_SCHEMA).alias("t"))
    return parsed.select("line_no", "t.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(pred_id, id, sample_id, method, answer) with aliases resolved by which members are present.

    The answer is the first present of answer, response and output, even if null; a missing method
    is `unknown`, a null one stays null.
    """
    rows = lines(spark, path).select(F.col("line_no").alias("pred_id"), "raw", F.json_object_keys("raw").alias("keys"))
    value = lambda name: F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "string")
    answer = F.when(F.array_contains("keys", "answer"), value("answer")).when(F.array_contains("keys", "response"), value("response")).otherwise(value("output"))
    return rows.select("pred_id", value("id").alias("id"), value("sample_id").alias("sample_id"), F.when(F.array_contains("keys", "method"), value("method")).otherwise("unknown").alias("method"), answer.alias("answer"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id): one trimmed id per line, blank lines dropped."""
    return lines(spark, path).select("line_no", F.trim("raw").alias("id"))


def write_ids(ids: DataFrame, path: str) -> None:
    """One id per line in order, as a folder of one text file; id lists of splits are small."""
    ids.orderBy("id").coalesce(1).select("id").write.mode("overwrite").text(path)


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(method, text) of the prompt files of a folder, one whole file per row."""
    files = spark.read.text(os.path.join(folder, "*.md"), wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+)\.md$", 1).alias("method"), F.col("value").alias("text"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table with its header, counts as integers and rates as doubles."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.col(c).cast("bigint" if c.endswith("_n") else "double" if c in ("core_pass", "gemini_faithfulness", "hybrid_faithfulness", "naturalness") or "_ci95_" in c else "string").alias(c) for c in raw.columns])


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of several lines."""
    return spark.read.option("multiLine", "true").json(path)


def write_report(reports: DataFrame, rows: DataFrame, folder: str, policy: str) -> None:
    """Aggregates and rows as tables, and the aggregates as one small JSON document beside them.

    Only the aggregates (methods x languages or domains) reach the driver.
    """
    rows.write.mode("overwrite").parquet(f"{folder}/per_sample")
    reports.write.mode("overwrite").parquet(f"{folder}/reports")
    kept = reports.sparkSession.read.parquet(f"{folder}/reports").orderBy("report", "method", "language", "domain")
    document: dict = {"evaluation_policy": policy, "overall": [], "by_language": [], "by_domain": []}
    for row in kept.toLocalIterator():
        item = {k: v for k, v in row.asDict().items() if v is not None}
        document[item.pop("report")].append(item)
    with open(f"{folder}/report.json", "w", encoding="utf-8") as out:
        json.dump(document, out, ensure_ascii=False, indent=2)
