"""Registered queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldproof.llm import answer_languages, grouped_split, languages, lookalikes, mixing, overlap, pairs, standins, stuffed, tokens
from fieldproof.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Answers and field specifications that hold stand-in text."""
    tasks, predictions = table(spark, folder, "tasks"), table(spark, folder, "predictions")
    answers = standins.standin_answers(predictions, tasks).select(F.lit("answer").alias("place"), F.col("pred_id").alias("row_key"), F.lit(-1).cast("bigint").alias("pos"))
    specs = standins.standin_specs(tasks).select(F.lit("field_specs").alias("place"), F.col("line_no").alias("row_key"), "pos")
    return answers.unionByName(specs)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training and an evaluation task that describe the same record."""
    return overlap.cross_split_pairs(table(spark, folder, "tasks"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and domain."""
    return overlap.overlap_report(table(spark, folder, "tasks"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every task with a readable result, the class of results equal to it, and how many tasks of the other side agree with it."""
    return overlap.result_links(table(spark, folder, "tasks"))


SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of groups of at least two, with their group."""
    return grouped_split.id_groups(table(spark, folder, "tasks")).filter("n_ids >= 2").select("id", "group_id")


def p4_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every id with the split its group was dealt to."""
    return grouped_split.assign_splits(table(spark, folder, "tasks"), SHARES)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares the splits reached."""
    return grouped_split.split_report(table(spark, folder, "tasks"), SHARES)


def fitted(spark: SparkSession, folder: str) -> languages.Profiles:
    """Language profiles of a bounded sample of the documents."""
    return languages.fit_on_documents(table(spark, folder, "documents"), table(spark, folder, "language_names"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions that are no proper reply, with their defect."""
    return pairs.defects(table(spark, folder, "predictions"), table(spark, folder, "tasks"), fitted(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of answers that aren't just in the language their task names."""
    names = table(spark, folder, "language_names")
    return answer_languages.mislabelled(table(spark, folder, "predictions"), table(spark, folder, "tasks"), names, fitted(spark, folder))


def p6_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The main language of every answer, with its confidence."""
    return answer_languages.main_languages(table(spark, folder, "predictions"), fitted(spark, folder))


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of every answer with its language and confidence."""
    return answer_languages.language_segments(table(spark, folder, "predictions"), fitted(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of one task, and values of one record, that look alike but are stored differently."""
    answers = lookalikes.look_alike_answers(table(spark, folder, "predictions")).select(F.lit("answer").alias("place"), "key_a", "key_b")
    values = lookalikes.look_alike_values(table(spark, folder, "tasks")).select(F.lit("tool_result").alias("place"), F.col("line_no").alias("key_a"), F.col("pos").alias("key_b"))
    return answers.unionByName(values)


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer with its class of look-alikes and how many of them are stored differently."""
    return lookalikes.look_classes(table(spark, folder, "predictions"))


def p7_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer with its consistent form."""
    return table(spark, folder, "predictions").select("pred_id", lookalikes.canonical_udf("answer").alias("form"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: documents with the number of their copies."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares the mixture reached."""
    return mixing.mixture_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents made of repeated keywords, links or tags."""
    return stuffed.stuffed_pages(table(spark, folder, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p3_links": p3_links, "p4_found": p4_found, "p4_assignment": p4_assignment, "p4_report": p4_report, "p5_found": p5_found, "p6_found": p6_found, "p6_languages": p6_languages, "p6_segments": p6_segments, "p7_found": p7_found, "p7_forms": p7_forms, "p7_classes": p7_classes, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found}
SQL: dict[str, str] = {}
