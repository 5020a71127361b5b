import json

from fieldproof.functions.jsontext import UNREADABLE, read_json
from fieldproof.operators.flatten import emit_nodes, read_table, table_schemas, write_tables


def expected(name, value):
    """Plain recursion over one value."""
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            out.append((path, parent))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent)

    walk(value, name, "")
    return out


VALUES = [
    {"a": [{"b": {}}, None, [{"c": 1}, []]], "d": "{}", "e": {"f": []}},
    [{"x": 1}, {"y": [{"z": None}]}],
    [[{"deep": {"er": [[[{"q": 1}]]]}}]],
    {},
    [],
    5,
    {"long": "x" * 100_000, "record_key": 1, "node_path": "n"},
]
SCHEMA = "line_no bigint, tool_result string, field_specs array<struct<path string, value string>>, k string, j0 string"


def test_nodes_against_recursion(spark):
    texts = [json.dumps(v) for v in VALUES] + [json.dumps(json.dumps(VALUES[0]))]
    bad = [None, "", "   ", '{"a": [1', '"just a string"', "[" * 5000, "null", '{"a":1,"a":{"b":2}}']
    specs = [("p", "v"), None, ("q", None)]
    rows = [(i, t, specs if i % 2 else None, "k", "j") for i, t in enumerate(texts + bad)] + [(0, texts[0], [], "k", "j")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["record_key"], r["node_path"], r["parent_path"]) for r in emit_nodes(df, "line_no", ["tool_result"], ["field_specs"]).collect())
    want = []
    for i, t, s, _, _ in rows:
        value = read_json(t)
        want += [(i, *x) for x in (expected("tool_result", value) if value is not UNREADABLE else [])]
        want += [(i, f"field_specs[{n}]", "") for n, x in enumerate(s or []) if x is not None]
    assert got == sorted(want)
    quick = emit_nodes(df, "line_no", ["tool_result"], ["field_specs"], payload=False)
    assert sorted((r["record_key"], r["node_path"], r["parent_path"]) for r in quick.collect()) == got
    assert emit_nodes(df.limit(0), "line_no", ["tool_result"], ["field_specs"]).count() == 0


def test_tables_keep_links(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps(VALUES[0]), None, "", ""), (7, json.dumps(VALUES[6]), None, "", "")], SCHEMA)
    nodes = emit_nodes(df, "line_no", ["tool_result"], [])
    write_tables(nodes, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == nodes.count()
    roots = read_table(back, "tool_result", "d string, long string, record_key int, node_path string").orderBy("record_key").collect()
    assert [(r["record_key"], r["d"], r["record_key_"]) for r in roots] == [(1, "{}", None), (7, None, 1)]
    assert roots[1]["node_path_"] == "n" and len(roots[1]["long"]) == 100_000
    c = read_table(back, "tool_result.a", "c int").filter("c = 1").first()
    assert (c["node_path"], c["parent_path"]) == ("tool_result.a[2][0]", "tool_result")


def test_flatten_command(spark, tmp_path, capsys):
    """The whole emission is written once and every table of it is read back with its schema."""
    from fieldproof import cli

    value = {"a": [{"n": 1}, {"n": 2.5}, {}], "b": {"big": 2**70, "ok": True, "none": None}, "c": {}, "s": "x"}
    rows = [(1, json.dumps(value), [("p", "v"), None], "", ""), (2, None, [("q", None)], "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in" / "tasks.parquet"))
    assert cli.main(["flatten", "--tables", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out) == {
        "field_specs": {"rows": 2, "path": 2, "value": 1}, "tool_result": {"rows": 1, "s": 1}, "tool_result.a": {"rows": 3, "n": 2},
        "tool_result.b": {"rows": 1, "big": 1, "none": 0, "ok": 1}, "tool_result.c": {"rows": 1},
    }
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["n"] for r in read_table(back, "tool_result.a", table_schemas(back)["tool_result.a"]).filter("n IS NOT NULL").collect()) == [1.0, 2.5]


def test_deep_texts():
    from fieldproof.functions.jsontext import _read_deep

    texts = ['{"a": [1, -2.5e3, "x\\n", null, true, {}, []], "b": {"c": [[[]]]}, "a": 2}', " [ ] ", "5", '"s"', "{}", "[1,]", '{"a" 1}', "{,}", "[1 2]", '{"a": 1} x', "", "[", '{"a": "cut', "[01]", '{1: 2}', '["\\q"]']
    for text in texts:
        try:
            want = json.loads(text)
        except ValueError:
            want = UNREADABLE
        assert _read_deep(text) == want, text
    depth = 30_000
    value = read_json('{"a":[' * depth + "7" + "]}" * depth)
    for _ in range(depth):
        value = value["a"][0]
    assert value == 7
    assert read_json("[" * depth + "]" * (depth - 1)) is UNREADABLE
