"""Splits that keep related records together (problem 4).

Relations are edges between an id and its keys. Every task first turns its edges into a local
union-find forest, which leaves at most one edge per node; the forests are merged by alternating
star rounds, in which every node is tied to the smallest node it knows, with local forests between
the rounds, until all trees are stars. Minima are pre-aggregated before each shuffle and the joins
may be split where a key is hot; no neighbourhood is collected.

Groups are then dealt to the splits largest first, each to the split furthest below its target.
Groups of one size are interchangeable, so the deal is computed on counts per size (fewer than
sqrt(2 x tasks) of them) and groups take their places by rank.

Defined cases: rows with a null id are left out; ids without number or record id stand alone; the
same id delivered often is one node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldproof.llm.records import id_number, source_key
from fieldproof.session import checkpointed, released

CHUNK = 1_000_000
SLICE_GROUPS = 50_000


def local_forest(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest node of a's tree, per chunk of the rows a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def forest() -> pa.RecordBatch:
            nodes = [x for x in parent if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > CHUNK:
                yield forest()
                parent.clear()
        yield forest()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def safe_seed(keys: DataFrame) -> int:
    """The first seed under which no two of the distinct texts `key` have one 64-bit hash, so that hashes may stand for them.

    Texts are told apart by a second hash; the aggregate keeps two numbers per hash.
    """
    for seed in range(8):
        nodes = keys.select(F.xxhash64("key", F.lit(seed)).alias("node"), F.xxhash64("key", F.lit(-1 - seed)).alias("second"))
        shared = nodes.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high")
        if shared.limit(1).count() == 0:
            return seed
    raise RuntimeError("no seed without collisions")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component, from edges (a, b) of long keys."""
    current, before = checkpointed(local_forest(edges)), None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = local_forest(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        after = checkpointed(small.distinct())
        released(current)
        current = after
        state = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before:
            return current.withColumnsRenamed({"a": "node", "b": "root"})
        before = tuple(state)
    raise RuntimeError("components did not settle")


def related_ids(tasks: DataFrame) -> DataFrame:
    """(id, root) of every distinct id; ids with one root are related, directly or through others."""
    rows = tasks.filter(F.col("id").isNotNull()).select("id", "domain", id_number().alias("number"), source_key().alias("source")).distinct()
    # what names a node: an id, or a number or record id within a domain; lengths keep the parts of a name apart
    name = lambda kind, *parts: F.concat_ws("\0", F.lit(kind), *[x for p in parts for x in (F.length(p).cast("string"), F.col(p))])
    names = rows.select("id", name("id", "id").alias("own"), F.when(F.col("number").isNotNull() & F.col("domain").isNotNull(), name("number", "domain", "number")).alias("by_number"), F.when(F.col("source").isNotNull() & F.col("domain").isNotNull(), name("source", "domain", "source")).alias("by_source"))
    seed = safe_seed(names.select(F.explode(F.array("own", "by_number", "by_source")).alias("key")).filter("key IS NOT NULL"))
    node = lambda c: F.xxhash64(c, F.lit(seed))
    edges = names.select(node("own").alias("a"), F.explode(F.array_compact(F.array("by_number", "by_source"))).alias("key")).select("a", node("key").alias("b"))
    roots = connected(edges)
    ids = tasks.filter(F.col("id").isNotNull()).select("id").distinct().withColumn("node", node(name("id", "id")))
    return ids.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))


def id_groups(tasks: DataFrame) -> DataFrame:
    """(id, group_id, n_ids): group_id is the smallest id of the group in code-point order."""
    ids = checkpointed(related_ids(tasks))
    groups = ids.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n_ids"))
    return ids.join(groups, "root").select("id", "group_id", "n_ids")


def deal(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """For each (size, groups), largest first, how many groups each split takes.

    Each group goes to the split furthest below its target; that is done for all groups of a size
    at once: the open amounts fall by the size with every group, and the largest amounts come first.
    """
    total = sum(s * n for s, n in sizes)
    names = list(shares)
    lacking = np.array([shares[x] * total for x in names], dtype=float)
    out: dict[int, list[tuple[str, int]]] = {}
    for size, n in sorted(sizes, reverse=True):
        low, high = lacking.min() - size * (n + 1), lacking.max()
        for _ in range(200):  # the level down to which amounts are taken
            level = (low + high) / 2
            if np.maximum(0, np.ceil((lacking - level) / size)).sum() > n:
                low = level
            else:
                high = level
        takes = np.maximum(0, np.ceil((lacking - high) / size)).astype(int)
        while takes.sum() < n:
            takes[int(np.argmax(lacking - takes * size))] += 1
        lacking -= takes * size
        out[size] = [(x, int(t)) for x, t in zip(names, takes)]
    return out


def assign_splits(tasks: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(id, group_id, split): every distinct id with the split of its group; sizes count rows of tasks."""
    spark = tasks.sparkSession
    groups = id_groups(tasks).select("id", "group_id")
    rows = tasks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("rows"))
    members = checkpointed(groups.join(rows, "id"))
    sized = members.groupBy("group_id").agg(F.sum("rows").alias("size"))
    # ranks within a size: a size is cut into as many slices as keep each of bounded length, and ranked within each
    per = sized.groupBy("size").agg(F.ceil(F.count("*") / SLICE_GROUPS).alias("slices"))
    sliced = sized.join(per, "size").withColumn("slice", F.pmod(F.xxhash64("group_id"), "slices")).drop("slices")
    counts = sliced.groupBy("size", "slice").agg(F.count("*").alias("n"))
    per_size = [(r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()]
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("size").orderBy("slice")) - F.col("n")).select("size", "slice", "start")
    ranked = sliced.join(starts, ["size", "slice"]).withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("size", "slice").orderBy("group_id")) - 1)
    bounds = []
    for size, takes in deal(per_size, shares).items():
        at = 0
        for name, n in takes:
            if n:
                bounds.append((size, at, at + n, name))
                at += n
    ranges = spark.createDataFrame(bounds, "size bigint, low bigint, high bigint, split string")
    placed = ranked.join(ranges, "size").filter("rank >= low AND rank < high").select("group_id", "split")
    return members.join(placed, "group_id").select("id", "group_id", "split")


def split_report(tasks: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Ids, groups and rows of each split, with the share reached and the target."""
    placed = assign_splits(tasks, shares)
    rows = tasks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("rows"))
    per = placed.join(rows, "id").groupBy("split").agg(F.count("*").alias("n_ids"), F.countDistinct("group_id").alias("n_groups"), F.sum("rows").alias("n_rows"))
    total = per.agg(F.sum("n_rows").alias("total"))
    target = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return per.join(F.broadcast(total)).select("split", "n_ids", "n_groups", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"), target[F.col("split")].alias("target"))
