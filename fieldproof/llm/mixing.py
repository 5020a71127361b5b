"""One mixture of sources to target shares (problem 9).

Sizes are tokens of a public tokenizer. The mixture is the largest one that meets all shares while
no source is repeated more often than allowed; that gives every document of a source the same number
of expected copies. Expected copies are summed up within the source along slices drawn by hash, in each by size, one random
offset is added, and a document is put out once for each whole number its interval crosses: floor or
ceiling of the expectation, never more than the allowed repeats. Prefix sums are taken in slices of
bounded size, so that a source of any size is never one task.

Defined cases: null, empty and blank texts have no tokens and take no part, nor do sources without
a target; a target source without tokens makes the shares unreachable and is left out, and the
shares of the others are scaled up; all this shows in the report.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window, functions as F

from fieldproof.llm.tokens import count_tokens
from fieldproof.session import checkpointed

SLICE_ROWS = 50_000


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document put out at least once."""
    sized = checkpointed(count_tokens(documents.filter(F.col("source").isNotNull() & F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")), ["doc_id", "source"], "text").filter("n_tokens > 0"))
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    # one row per target source: as many as mix_targets has
    wanted = targets.filter("target_share > 0").join(totals, "source").withColumn("share", F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(1))))
    most = F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(Window.partitionBy(F.lit(1)))
    rates = wanted.select("source", F.least(F.col("max_repeats").cast("double"), F.col("share") * most / F.col("tokens")).alias("rate"), F.ceil(F.col("docs") / SLICE_ROWS).alias("slices"), "max_repeats")
    order = F.xxhash64("doc_id", F.lit(seed))  # within a slice by size first, so that sizes are sampled evenly
    rows = sized.join(F.broadcast(rates), "source").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("slices")))
    slices = rows.groupBy("source", "slice").agg(F.count("*").alias("n"))
    before = slices.select("source", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).alias("before"))
    offset = random.Random(seed).random()
    place = F.col("before") + F.row_number().over(Window.partitionBy("source", "slice").orderBy("n_tokens", order, "doc_id"))
    # crossings of whole numbers between the prefix sums before and after the document
    copies = F.floor(F.col("place") * F.col("rate") + F.lit(offset) + 1e-9) - F.floor((F.col("place") - 1) * F.col("rate") + F.lit(offset) + 1e-9)
    return (
        rows.join(before, ["source", "slice"])
        .withColumn("place", place)
        .withColumn("copies", F.least(copies.cast("int"), F.col("max_repeats")))
        .filter("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )


def mixture_report(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Per target source: documents and tokens put out, highest repetition, share reached and target."""
    out = mixture(documents, targets, seed).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return targets.join(out, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / whole).alias("actual_share")
    )
