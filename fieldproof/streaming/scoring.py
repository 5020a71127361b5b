"""Scoring of predictions as they arrive.

Scoring is stateless: each prediction meets the static task table. Aggregates are kept per method
and window with a watermark, so that state is bounded and late rows have a defined end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldproof.operators.evaluation import METRICS, evaluate


def prediction_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of predictions as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scored_stream(predictions: DataFrame, tasks: DataFrame, policy: str = "strict") -> DataFrame:
    """The rows of evaluate() for a stream."""
    return evaluate(predictions, tasks, policy)


def arrivals(predictions: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, method, n, n_empty) by time of creation; rows later than the watermark are dropped."""
    return (
        predictions.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
        .groupBy(F.window("created_at", window).alias("w"), F.coalesce("method", F.lit("unknown")).alias("method"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull() | (F.trim("answer") == "")).alias("n_empty"))
        .select(F.col("w.start").alias("window_start"), "method", "n", "n_empty")
    )


def append_scores(scored: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes scored rows as they come; exactly once, by the file sink's log."""
    return scored.select("pred_id", "id", "method", "language", "domain", *METRICS).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
