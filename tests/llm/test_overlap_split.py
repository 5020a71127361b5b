import json
import random

from fieldproof.llm.grouped_split import assign_splits, connected, deal, id_groups, split_report
from fieldproof.llm.overlap import cross_split_pairs, leaf_hashes, overlap_report


def records(rng, n=160):
    rows, bases = [], [{"name": f"n{i}", "code": f"C{i}", "v": [i, i * 2, {"w": i * 3, "x": f"q{i}"}], "s": "closed", "t": "same"} for i in range(12)]
    for i in range(n):
        base = json.loads(json.dumps(rng.choice(bases)))
        kind = rng.randrange(6)
        if kind == 0:
            base["name"] = base["name"].upper()
        elif kind == 1:
            base = dict(reversed(list(base.items())))
        elif kind == 2:
            base["s"] = "open"
        elif kind == 3:
            base |= {"s": "open", "code": "other", "name": "else", "t": str(i)}
        text = json.dumps(base, indent=rng.choice([None, 1]))
        text = rng.choice([text, text, text, json.dumps(text), f"[{text}]", text[:30], None])
        source = rng.choice([None, "", "N/A", "r_1", "R-1 ", "tbd", f"s{i % 30}"])
        rows.append({"id": rng.choice([f"book_zh_{i % 50:06}", f" BOOK_ja_{i % 50} ", f"x{i}", f"book_zh_{i}"]), "domain": rng.choice(["book", "food"]), "source_record_id": source, "split": rng.choice(["train", "dev", "test", "train"]), "tool_result": text})
    return rows


STAND = {"", "unknown", "none", "n/a", "null", "tbd", "-", "0"}


def key(x):
    x = (x or "").strip().lower().replace("_", "-")
    return None if x in STAND else x


def test_overlaps_against_brute_force(spark, make):
    rows = records(random.Random(3))
    tasks = make.tasks(rows)
    sets = [set(leaf_hashes(r["tool_result"])) for r in rows]
    want = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a["split"] == "train" and b["split"] != "train" and a["domain"] == b["domain"]:
                same = key(a["source_record_id"]) and key(a["source_record_id"]) == key(b["source_record_id"])
                alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.75 * max(len(sets[i]), len(sets[j]))
                if same or alike:
                    want.add((min(i, j), max(i, j)))
    got = [tuple(r) for r in cross_split_pairs(tasks).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    report = overlap_report(tasks).collect()
    assert sum(r["n_pairs"] for r in report) == len(want) and sum(r["n_tasks"] for r in report) == sum(r["split"] != "train" for r in rows)
    assert cross_split_pairs(tasks.limit(0)).count() == 0


def test_groups_against_brute_force(spark, make):
    rows = records(random.Random(4), 220) + [{"id": None, "source_record_id": "r1"}, {"id": "", "source_record_id": "q"}]
    tasks = make.tasks(rows)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        if r["id"] is None:
            continue
        domain = r.get("domain", "book")
        last = r["id"].rsplit("_", 1)[-1].strip() if "_" in r["id"] else ""
        for k in ([("n", domain, int(last))] if last.isdigit() else []) + ([("s", domain, key(r["source_record_id"]))] if key(r["source_record_id"]) else []):
            parent[find(k)] = find(("i", r["id"]))
        find(("i", r["id"]))
    groups = {}
    for r in rows:
        if r["id"] is not None:
            groups.setdefault(find(("i", r["id"])), set()).add(r["id"])
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    assert {tuple(r) for r in id_groups(tasks).collect()} == want
    shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
    placed = assign_splits(tasks, shares).collect()
    assert {r["id"] for r in placed} == {i for i, _, _ in want} and len(placed) == len(want)
    per_group = {}
    for r in placed:
        per_group.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(x) == 1 for x in per_group.values())
    assert sum(r["n_rows"] for r in split_report(tasks, shares).collect()) == sum(r["id"] is not None for r in rows)
    assert id_groups(tasks.limit(0)).count() == 0 and assign_splits(tasks.limit(0), shares).count() == 0


def test_components_of_a_long_chain(spark):
    n = 120
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (7, 7)], "a bigint, b bigint").repartition(5)
    roots = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert roots == {i: 0 for i in range(1, n)} | {1001: 1000}


def greedy(sizes, shares):
    """The deal one group at a time."""
    total = sum(s * n for s, n in sizes)
    lacking = {k: v * total for k, v in shares.items()}
    out = {}
    for size, n in sorted(sizes, reverse=True):
        for _ in range(n):
            best = max(lacking, key=lambda k: lacking[k])
            lacking[best] -= size
            out.setdefault(size, dict.fromkeys(shares, 0))[best] += 1
    return out, lacking


def test_deal_is_greedy():
    rng = random.Random(6)
    shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
    for _ in range(50):
        sizes = [(s, rng.randrange(1, 40)) for s in rng.sample(range(1, 60), 8)]
        want, lacking = greedy(sizes, shares)
        got = deal(sizes, shares)
        assert {s: sum(n for _, n in x) for s, x in got.items()} == dict(sizes)
        total = sum(s * n for s, n in sizes)
        left = {k: shares[k] * total - sum(s * n for s, x in got.items() for name, n in x if name == k) for k in shares}
        assert sorted(round(x, 6) for x in left.values()) == sorted(round(x, 6) for x in lacking.values())


def test_links_count_what_pairs_name(spark, make):
    from fieldproof.llm import overlap

    a, b, c = ('{"a": 1, "b": 2, "c": 3, "d": %d}' % i for i in (4, 5, 6))
    rows = [("train", a), ("dev", a), ("test", b), ("train", b), ("dev", '{"x": 1}'), ("train", c), ("train", None), ("dev", a)]
    tasks = make.tasks([{"id": f"t_{i}", "domain": "book", "split": s, "tool_result": r} for i, (s, r) in enumerate(rows)])
    pairs = [tuple(sorted(r)) for r in overlap.same_results(tasks).distinct().collect()]
    links = {r["line_no"]: r["n_links"] for r in overlap.result_links(tasks).collect()}
    assert links == {i: sum(i in p for p in pairs) for i, (_, r) in enumerate(rows) if r} and sum(links.values()) > 0
    assert overlap.result_links(tasks.limit(0)).count() == 0


def test_seeds(spark):
    from fieldproof.llm.grouped_split import safe_seed

    assert safe_seed(spark.range(1000).selectExpr("cast(id % 10 AS string) AS key")) == 0
    assert safe_seed(spark.createDataFrame([], "key string")) == 0
