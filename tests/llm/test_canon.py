import random
import unicodedata

from hypothesis import given, settings, strategies as st

from fieldproof.llm.canon import BLANK, IGNORABLE, SHAPES, canonical, fold_form, folded, is_empty
from fieldproof.llm.lookalikes import look_alike_answers, look_alike_values, value_at

SAMPLE = "Sinonê Rose 12,5 ガ行 ราคา ཡིན། ئۇنىڭ ᠨᠢ é"


def disguised(text, rng):
    """A text that looks the same, by the kinds of change that the form undoes."""
    back = {}
    for code, latin in SHAPES.items():
        back.setdefault(latin, []).append(chr(code))
    out = []
    for c in text:
        kind = rng.randrange(6)
        if kind == 0 and c == " ":
            c = rng.choice([" ", "　", " ", " "])
        elif kind == 1 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif kind == 2:
            c = unicodedata.normalize("NFD", c)
        elif kind == 3 and c in back:
            c = rng.choice(back[c])
        elif kind == 4:
            c = rng.choice(["​", "­", "⁠", "﻿"]) + c
        out.append(c)
    return "".join(out)


def test_disguises_are_undone():
    rng = random.Random(1)
    for _ in range(300):
        assert canonical(disguised(SAMPLE, rng)) == canonical(SAMPLE)


def test_what_counts_stays():
    for a, b in [("Rose", "rose"), ("a b", "a  b"), ("a.", "a"), ("word", "werd")]:
        assert canonical(a) != canonical(b)
    assert folded("ＲＯＳЕ  Straße") == "rose strasse"


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_form_is_settled(text):
    form = canonical(text)
    assert canonical(form) == form
    assert not IGNORABLE.search(form) and not BLANK.search(form)
    assert fold_form(form) == folded(text)


def test_empty():
    assert all(map(is_empty, [None, "", " 　\n", "…", "。", "​", "N/A", "null", "“None”", "-", '""', "…" * 500]))
    assert not any(map(is_empty, ["x", "No", "0", "中", "😀", "not N/A at all", "a" * 10_000, "." * 300 + "x"]))


def test_pairs_against_brute_force(spark, make):
    rng = random.Random(2)
    texts = ["Rose 1", "Rose 2", "rose 1", None, "", "…", "．．．"]
    rows = []
    for i in range(160):
        text = rng.choice(texts)
        rows.append({"id": rng.choice(["t1", "t2", "", None]), "sample_id": rng.choice(["t1", "t3", None]), "answer": disguised(text, rng) if text and rng.random() < 0.7 else text})
    rows += [{"id": "hot", "answer": "same"}] * 50 + [{"id": "hot", "answer": "ｓame"}]
    got = sorted(map(tuple, look_alike_answers(make.predictions(rows)).collect()))
    keyed = [(i, r["id"] or r.get("sample_id"), r["answer"]) for i, r in enumerate(rows)]
    want = [(a, b) for a, t, x in keyed for b, u, y in keyed if a < b and t and t == u and not is_empty(x) and not is_empty(y) and x != y and canonical(x) == canonical(y)]
    assert got == sorted(want) and len(got) > 60
    assert look_alike_answers(make.predictions(rows).limit(0)).count() == 0


def test_values(make):
    spec = lambda path, value: (path, "entity", value, None, True, False, None)
    specs = [spec("a.b[0].c", "Rоse"), spec("a.b[0].c", "Rose"), spec("n", "5"), spec("gone", "x"), spec(None, "x"), spec("a", None)]
    result = '{"a": {"b": [{"c": "Rose"}]}, "n": 5}'
    rows = [{"tool_result": result, "field_specs": specs}, {"tool_result": '"{\\"a\\": {\\"b\\": [{\\"c\\": \\"Rose\\"}]}}"', "field_specs": specs}, {"tool_result": f"[{result}]", "field_specs": specs}, {"tool_result": result[:20], "field_specs": specs}, {"tool_result": None, "field_specs": specs}, {"tool_result": result}]
    assert sorted(map(tuple, look_alike_values(make.tasks(rows)).collect())) == [(0, 0), (1, 0), (2, 0)]
    assert value_at([[None, {"x": [1, 2]}]], "x[1]") == 2


def test_empty_at_any_length():
    from fieldproof.llm.canon import is_empty

    for n in (1, 60, 61, 500):
        assert is_empty("\u3164" * n) and is_empty("\u200b" * n + "N/A" + " ." * n) and is_empty("- " * n)
        assert not is_empty("\u3164" * n + "Rose is the name") and not is_empty("." * n + "天気" * n)
