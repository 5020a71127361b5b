"""Records that evaluation splits share with the training split (problem 3).

Every readable result becomes the set of hashes of its leaves (member path, value, how often seen
before in this result): word n-grams of one leaf, which don't depend on layout or member order.
Equal sets are one class, so copies are compared once. Sets that agree in three quarters of the
larger one must share one of their rarest quarter of leaves, so only these hashes of the evaluation
classes are partitioned and met with those of the training classes; rareness is counted over all
classes. Containment is then computed on the whole sets of each pair that met, which makes the
result exact: no bucket is capped.

Defined cases: null, unreadable and leafless results agree with nothing; null or unnamed record ids
equal nothing; rows without domain or split are left out; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fieldproof.functions.jsontext import UNREADABLE, leaves, read_json
from fieldproof.llm.canon import folded
from fieldproof.llm.records import source_key
from fieldproof.session import checkpointed

AGREE = 0.75


def leaf_hashes(text: str | None) -> list[int]:
    """The sorted hashes of a result's leaves; empty if it can't be read."""
    value = read_json(text)
    if value is UNREADABLE:
        return []
    seen: Counter = Counter()
    out = []
    for path, leaf in leaves(value, indexed=False):
        shown = folded(leaf) if isinstance(leaf, str) else format(leaf, ".12g") if isinstance(leaf, (int, float)) and not isinstance(leaf, bool) else str(leaf)
        key = f"{path.replace('[]', '')}\0{shown}"
        seen[key] += 1
        out.append(xxhash.xxh64_intdigest(f"{key}\0{seen[key]}") - (1 << 63))
    return sorted(out)


def with_leaves(tasks: DataFrame) -> DataFrame:
    """(line_no, domain, train, class, leaves) of the tasks with a readable result; class is 128 bits of the leaves."""
    picked = tasks.filter(F.col("tool_result").isNotNull() & F.col("domain").isNotNull() & F.col("split").isin("train", "dev", "test")).select(
        F.col("line_no").cast("bigint"), "domain", (F.col("split") == "train").alias("train"), "tool_result"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            found = []
            for text in batch.column(3).to_pylist():
                if text not in seen:
                    seen[text] = leaf_hashes(text)
                found.append(seen[text])
            kept = pa.array([bool(x) for x in found])
            sets = pa.array(found, pa.list_(pa.int64()))
            classes = pa.array([xxhash.xxh128_digest(np.array(x, dtype=np.int64).tobytes()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], classes, sets], names=["line_no", "domain", "train", "class", "leaves"]).filter(kept)

    return picked.mapInArrow(run, "line_no bigint, domain string, train boolean, class binary, leaves array<bigint>")


def agreeing_classes(members: DataFrame) -> DataFrame:
    """(domain, c_eval, c_train): classes of equal results, one with evaluation and one with training tasks, that agree; a class agrees with itself."""
    classes = members.groupBy("domain", "class").agg(F.first("leaves").alias("leaves"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    tokens = classes.select("class", "domain", "in_train", "in_eval", F.size("leaves").alias("n"), F.explode("leaves").alias("leaf"))
    rareness = tokens.groupBy("domain", "leaf").agg(F.count("*").alias("df"), F.max("in_train").alias("t"), F.max("in_eval").alias("e"))
    # n - ceil(0.75 n) + 1 rarest leaves; the order (df, leaf) is one order for all classes
    rarest = (
        tokens.join(rareness, ["domain", "leaf"])
        .groupBy("class", "domain", "in_train", "in_eval", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "leaf", "t", "e"))).alias("all"))
        .select("class", "domain", "in_train", "in_eval", F.explode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.lit(AGREE) * F.col("n")) + 1).cast("int"))).alias("x"))
        .filter("x.t AND x.e")
        .select("class", "domain", "in_train", "in_eval", "x.leaf")
    )
    rarest = checkpointed(rarest)
    met = (
        rarest.filter("in_eval").select("domain", "leaf", F.col("class").alias("c_eval"))
        .join(rarest.filter("in_train").select("domain", "leaf", F.col("class").alias("c_train")), ["domain", "leaf"])
        .select("domain", "c_eval", "c_train")
        .distinct()
    )
    sets = classes.select("domain", "class", "leaves")
    return (
        met.join(sets.select("domain", F.col("class").alias("c_eval"), F.col("leaves").alias("le")), ["domain", "c_eval"])
        .join(sets.select("domain", F.col("class").alias("c_train"), F.col("leaves").alias("lt")), ["domain", "c_train"])
        .filter(F.size(F.array_intersect("le", "lt")) >= F.lit(AGREE) * F.greatest(F.size("le"), F.size("lt")))
        .select("domain", "c_eval", "c_train")
    )


def same_results(tasks: DataFrame) -> DataFrame:
    """(line_a, line_b), unordered, of a training and an evaluation task whose results agree."""
    members = checkpointed(with_leaves(tasks))
    lines = members.select("domain", "class", "line_no", "train")
    return (
        agreeing_classes(members)
        .join(lines.filter("NOT train").select("domain", F.col("class").alias("c_eval"), F.col("line_no").alias("line_a")), ["domain", "c_eval"])
        .join(lines.filter("train").select("domain", F.col("class").alias("c_train"), F.col("line_no").alias("line_b")), ["domain", "c_train"])
        .select("line_a", "line_b")
    )


def result_links(tasks: DataFrame) -> DataFrame:
    """(line_no, class, n_links): each task with a readable result, its class, and how many tasks of the other side agree with it.

    The form for tables in which a record is copied very often: no pair of tasks is ever made, only
    pairs of classes, and links are sums of class sizes.
    """
    members = checkpointed(with_leaves(tasks))
    sizes = members.groupBy("domain", "class").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval"))
    agreeing = agreeing_classes(members)
    of_eval = agreeing.join(sizes.select("domain", F.col("class").alias("c_train"), "n_train"), ["domain", "c_train"]).groupBy("domain", F.col("c_eval").alias("class")).agg(F.sum("n_train").alias("eval_links"))
    of_train = agreeing.join(sizes.select("domain", F.col("class").alias("c_eval"), "n_eval"), ["domain", "c_eval"]).groupBy("domain", F.col("c_train").alias("class")).agg(F.sum("n_eval").alias("train_links"))
    counted = sizes.select("domain", "class").join(of_eval, ["domain", "class"], "left").join(of_train, ["domain", "class"], "left")
    links = F.coalesce(F.when(F.col("train"), F.col("train_links")).otherwise(F.col("eval_links")), F.lit(0))
    return members.select("line_no", "domain", "class", "train").join(counted, ["domain", "class"]).select("line_no", F.lower(F.hex("class")).alias("class"), links.alias("n_links"))


def same_source(tasks: DataFrame) -> DataFrame:
    """(line_a, line_b), unordered, of a training and an evaluation task with the same record id."""
    rows = tasks.select(F.col("line_no").cast("bigint").alias("line_no"), "domain", "split", source_key().alias("source")).filter(F.col("source").isNotNull() & F.col("domain").isNotNull())
    train = rows.filter("split = 'train'").select("domain", "source", F.col("line_no").alias("line_b"))
    held = rows.filter("split IN ('dev', 'test')").select("domain", "source", F.col("line_no").alias("line_a"))
    return held.join(train, ["domain", "source"]).select("line_a", "line_b")


def cross_split_pairs(tasks: DataFrame) -> DataFrame:
    """(line_a, line_b), smaller first, each pair once."""
    return same_source(tasks).unionByName(same_results(tasks)).select(F.least("line_a", "line_b").alias("line_a"), F.greatest("line_a", "line_b").alias("line_b")).distinct()


def overlap_report(tasks: DataFrame) -> DataFrame:
    """Per split and domain: evaluation tasks, those that share a record with training, and pairs."""
    held = tasks.filter(F.col("split").isin("dev", "test")).select("line_no", "split", "domain")
    pairs = cross_split_pairs(tasks)
    sides = pairs.select(F.col("line_a").alias("line_no")).unionByName(pairs.select(F.col("line_b").alias("line_no")))
    hits = sides.groupBy("line_no").agg(F.count("*").alias("pairs"))
    return (
        held.join(hits, "line_no", "left")
        .groupBy("split", "domain")
        .agg(F.count("*").alias("n_tasks"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )
