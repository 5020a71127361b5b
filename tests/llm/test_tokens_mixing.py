import os
import random

import pytest

from fieldproof.llm import tokens
from fieldproof.llm.mixing import mixture, mixture_report

needs_files = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)), reason="no tokenizer files")
TEXTS = ["", " ", "  a", "\n\n x\r\n", "😀👩‍👧", "a" * 5000, "<|endoftext|>", "١٢٣ ½㎏", " " * 1000, "it's I'LL we'd", "日本語のテキスト" * 300, "ཡིན། ᠨᠢ ئۇنىڭ ราคา", "x\x00y\x07", "́́", "http://a.b/c?d=1#e"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@needs_files
def test_ids_equal_the_library():
    rng = random.Random(7)
    words = ["low", "lower", "lowest", "new", "newer", "été", "数据", "data", "123", "-", "\n", "  ", "ing", "tion"]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(60)) for _ in range(300)]
    own = tokens.encoder()
    assert own.encode(texts) == reference_ids(texts)
    assert own.encode([None, ""]) == [[], []]
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=own.ranks, special_tokens={})
    assert own.encode(texts[:40]) == [library.encode_ordinary(t) for t in texts[:40]]


@needs_files
def test_corpus(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    want = reference_ids(TEXTS)
    assert got == dict(enumerate(want)) | {len(TEXTS): []}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@needs_files
def test_mixture(spark):
    rng = random.Random(8)
    size = {"big": 3000, "mid": 400, "small": 30, "none": 0, "extra": 50}
    rows = [(f"{s}", " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 60)))) for s, n in size.items() for _ in range(n)]
    rows += [("mid", None), ("mid", ""), ("mid", "   "), (None, "x y z")]
    docs = spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.35, 4), ("small", 0.1, 6), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    out = mixture(docs, targets).collect()
    most = {r["source"]: r["max_repeats"] for r in targets.collect()}
    assert len({r["doc_id"] for r in out}) == len(out) and all(1 <= r["copies"] <= most[r["source"]] for r in out)
    assert {r["source"] for r in out} == {"big", "mid", "small"}
    per = {}
    for r in out:
        per.setdefault(r["source"], set()).add(r["copies"])
    assert all(max(x) - min(x) <= 1 for x in per.values())
    shares = {r["source"]: r["actual_share"] for r in mixture_report(docs, targets).collect()}
    for source, want in (("big", 0.5 / 0.95), ("mid", 0.35 / 0.95), ("small", 0.1 / 0.95), ("none", 0.0)):
        assert abs(shares[source] - want) < 0.02, (source, shares)
    assert sorted(map(tuple, mixture(docs, targets).collect())) == sorted(map(tuple, out))
    assert mixture(docs.limit(0), targets).count() == 0
