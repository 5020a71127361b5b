"""Aggregates of result tables: weighted means, differences, intervals and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# The two methods that are set against each other, and the normal quantile of 95 %.
BASELINE, COMPARISON = "extract_localize_verify", "protected_slot_realization"
Z95 = 1.959963984540054


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value times weight by the sum of weights; rows with a null in either don't count; null for no weight."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    total = F.sum(F.when(both, F.col(weight)))
    return F.when(total != 0, F.sum(F.when(both, F.col(value) * F.col(weight))) / total)


def pooled(results: DataFrame, *keys: str) -> DataFrame:
    """Per key the weighted means with their counts; each rate is weighted by the count it was measured on.

    The same operator pools a table by model, by language or by both.
    """
    return results.groupBy(*keys).agg(
        weighted_mean("core_pass", "core_n").alias("corepass"), F.sum("core_n").alias("core_n"),
        weighted_mean("hybrid_faithfulness", "gemini_n").alias("hybrid"), F.sum("gemini_n").alias("hybrid_n"),
        weighted_mean("naturalness", "naturalness_n").alias("naturalness"), F.sum("naturalness_n").alias("naturalness_n"),
    )


def method_summary(results: DataFrame) -> DataFrame:
    """The pooled values per method."""
    return pooled(results, "method")


def paired_deltas(results: DataFrame, key: str, metrics: list[str], baseline: str = BASELINE, comparison: str = COMPARISON) -> DataFrame:
    """(key, delta_<metric>, ...): by model or language, what the comparison method has over the baseline; null where one is missing."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return results.groupBy(key).agg(*[(pick(comparison, c) - pick(baseline, c)).alias(f"delta_{c}") for c in metrics])


def delta_interval(rate_a: Column, n_a: Column, rate_b: Column, n_b: Column) -> tuple[Column, Column]:
    """Bounds of the difference a - b of two independent rates: the outer differences of their score intervals."""
    (low_a, high_a), (low_b, high_b) = wilson(rate_a, n_a), wilson(rate_b, n_b)
    return low_a - high_b, high_a - low_b


def mcnemar(pairs: DataFrame, comparison: str, baseline: str) -> DataFrame:
    """(n, comparison_only, baseline_only, delta, p_value) of items judged twice; items with a null verdict are left out."""
    a, b = F.col(comparison), F.col(baseline)
    counts = pairs.filter(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("comparison_only"), F.count_if(b & ~a).alias("baseline_only"))
    delta = (F.col("comparison_only") - F.col("baseline_only")) / F.nullif(F.col("n"), F.lit(0))
    return counts.select("n", "comparison_only", "baseline_only", delta.alias("delta"), sign_test(F.col("comparison_only"), F.col("baseline_only")).alias("p_value"))


def headline(results: DataFrame, baseline: str = BASELINE, comparison: str = COMPARISON) -> DataFrame:
    """(name, value): both methods' means and their differences, rates in points."""
    s = method_summary(results)
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = s.agg(*[pick(m, c).alias(f"{c}_{n}") for c in ("corepass", "hybrid", "naturalness") for m, n in ((baseline, "elv"), (comparison, "protected"))])
    named = []
    for c, factor, suffix in (("corepass", 100.0, "_delta_pp"), ("hybrid", 100.0, "_delta_pp"), ("naturalness", 1.0, "_delta")):
        named += [(f"{c}_elv", F.col(f"{c}_elv")), (f"{c}_protected", F.col(f"{c}_protected")), (c + suffix, factor * (F.col(f"{c}_protected") - F.col(f"{c}_elv")))]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in named])).alias("x")).select("x.name", "x.value")


def compare(expected: DataFrame, computed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(name, expected, computed, agrees) for every expected name; a missing computed value doesn't agree."""
    return expected.select("name", F.col("value").alias("expected")).join(computed.select("name", F.col("value").alias("computed")), "name", "left").withColumn(
        "agrees", F.coalesce(F.abs(F.col("expected") - F.col("computed")) <= tolerance, F.lit(False))
    )


def wilson(rate: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The bounds of the score interval of a rate over n; null for no n."""
    n = F.nullif(n, F.lit(0)).cast("double")
    centre = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def with_wilson(df: DataFrame, rate: str, n: str, prefix: str) -> DataFrame:
    """The rows with the bounds of a rate."""
    low, high = wilson(F.col(rate), F.col(n))
    return df.withColumns({f"{prefix}_low": low, f"{prefix}_high": high})


def holm(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """The rows with p_holm, adjusted step-down within each family; null p-values stay null and don't count."""
    ranked = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    running = ranked.rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(p).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(ranked) + 1))
    return df.withColumn("__step", step).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("__step").over(running))).drop("__step")


def exact_binomial_two_sided(b: int, c: int) -> float:
    """2 * P(X <= min(b, c)) for X ~ Bin(b + c, 1/2), at most 1; in integers until the last division."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    tail, term = 0, 1
    for i in range(k + 1):
        tail += term
        term = term * (n - i) // (i + 1)
    return float(min(1.0, 2 * tail / 2**n)) if n < 1000 else min(1.0, math.exp(math.log(2 * tail) - n * math.log(2)))


def sign_test(positive: Column, negative: Column) -> Column:
    """The exact two-sided test of paired signs (also McNemar's test of discordant pairs)."""

    @F.pandas_udf(T.DoubleType())
    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else exact_binomial_two_sided(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")

    return run(positive.cast("bigint"), negative.cast("bigint"))


def two_proportion_z(rate_a: Column, n_a: Column, rate_b: Column, n_b: Column) -> Column:
    """The pooled two-sided z-test of two independent proportions."""

    @F.pandas_udf(T.DoubleType())
    def run(pa: pd.Series, na: pd.Series, pb: pd.Series, nb: pd.Series) -> pd.Series:
        pooled = (pa * na + pb * nb) / (na + nb)
        z = (pa - pb) / (pooled * (1 - pooled) * (1 / na + 1 / nb)) ** 0.5
        return (z.abs() / 2**0.5).map(math.erfc, na_action="ignore")

    return run(rate_a.cast("double"), n_a.cast("double"), rate_b.cast("double"), n_b.cast("double"))


def model_signs(results: DataFrame, metric: str, baseline: str = BASELINE, comparison: str = COMPARISON) -> DataFrame:
    """(metric, positive, negative, tied, p_value): the sign test over models of a metric's difference."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col(metric)))
    per = results.groupBy("model").agg((pick(comparison) - pick(baseline)).alias("d")).filter(F.col("d").isNotNull())
    signs = per.agg(F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") == 0).alias("tied"))
    return signs.select(F.lit(metric).alias("metric"), "positive", "negative", "tied", sign_test(F.col("positive"), F.col("negative")).alias("p_value"))
