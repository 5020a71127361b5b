import json
import math
import subprocess

import pytest
from pyspark.sql import functions as F

from fieldproof.operators import audit, results, slots, validation
from fieldproof.sources import jsonl

SPEC = "struct<path string, role string, value string, accepted_values array<string>, required boolean, requires_localization boolean, description string>"
TASKS = (
    f"line_no bigint, id string, domain string, source_record_id string, user_language string, expected_answer_language string, user_query string, tool_name string, tool_result string, "
    f"field_specs array<{SPEC}>, required_fields array<string>, forbidden_hallucinations array<string>, preserve_exact_fields array<string>, localizable_fields array<string>, split string"
)


def task(line, id="weather_zh_001", record="r1", specs=None, required=("a",), result='{"a": "Tokyo", "b": 53, "c": true, "d": null, "e": [1, 2]}', split="dev", local=("z",)):
    specs = specs if specs is not None else [("a", "entity", "Tokyo", ["Tokyo", "东京"], True, False, "x")]
    return (line, id, "weather", record, "zh", "zh", "q?", "tool", result, specs, list(required), [], [], list(local) if local is not None else None, split)


def test_violations(spark):
    rows = [
        task(1),
        task(2),  # duplicate
        task(3, id=""),
        task(4, id="x_zh_002", specs=[("", "entity", "v", None, True, False, None)], required=()),
        task(5, id="x_zh_003", specs=[("a", "odd", "v", None, True, False, None), ("b", None, "v", None, True, False, None)]),
        task(6, id="x_zh_004", required=("a", "n", "m")),
        task(7, id="x_zh_005")[:8] + (None,) + task(7)[9:],
    ]
    df = spark.createDataFrame(rows, TASKS)
    got = {(r["line_no"], r["priority"]): r["message"] for r in validation.violations(df).collect()}
    assert got == {
        (2, 3): "duplicate id: weather_zh_001", (3, 2): "invalid id", (4, 4): "field specification without a path", (5, 5): "unsupported field role: odd",
        (6, 6): "required fields without specs: m, n", (7, 1): "missing required keys: tool_result",
    }
    assert validation.first_violation(df).first()["line_no"] == 2
    assert validation.violations(df.limit(0)).count() == 0
    assert [r[0] for r in validation.shape_problems(df.limit(0), None).collect()] == ["dataset is empty"]
    assert any("expected 1024 rows, found 7" in r[0] for r in validation.shape_problems(df).collect())
    assert validation.summary(df).first()["unique_ids"] == 6


def test_main_and_attribution(spark):
    rows = [task(i, f"d_zh_{i}") + (None,) for i in range(4)]
    df = spark.createDataFrame([(*r[:-1], "ab"[i % 2]) for i, r in enumerate(rows)], TASKS + ", attribution_condition string")
    problems = lambda out: [r["problem"] for r in out.collect()]
    assert problems(validation.main_problems(df, 4)) == [] == problems(validation.attribution_problems(df, expected_rows=4))
    assert problems(validation.main_problems(df, 5)) == ["expected 5 rows, found 4"]
    assert problems(validation.attribution_problems(df)) == ["expected 448 rows, found 4", "unexpected condition balance: a: 2, b: 2"]
    assert problems(validation.attribution_problems(df.withColumn("attribution_condition", F.lit(None).cast("string")), expected_rows=4)) == ["a row has no condition"]
    assert problems(validation.main_problems(df.limit(0), None)) == ["dataset is empty"]
    twice = df.select("id", F.lit("dev").alias("split")).unionByName(df.filter("id = 'd_zh_1'").select("id", F.lit("test").alias("split"))).unionByName(df.filter("id = 'd_zh_2'").select(F.lit("new").alias("id"), F.lit(None).cast("string").alias("split")))
    assert sorted(tuple(r) for r in validation.split_problems(twice).collect()) == [("d_zh_1", "in several splits"), ("new", "in no split")]


def test_splits_and_balance(spark):
    df = spark.createDataFrame([task(1), task(2, "w_zh_002", "r1"), task(3, "w_zh_003", "r2"), task(4, "w_zh_9", "r3"), task(5, "w_zh_004", None)], TASKS)
    split = validation.suffix_split(df)
    assert {r["line_no"]: r["split"] for r in split.collect()} == {1: "dev", 2: "test", 3: "dev", 4: None, 5: "test"}
    assert [r["source_record_id"] for r in validation.split_leaks(split).collect()] == ["r1"]
    assert [r["id"] for r in validation.split_ids(split, "dev").collect()] == ["w_zh_003", "weather_zh_001"]
    again = validation.split_ids(split, "dev")
    assert validation.split_differences(again, again).count() == 0
    assert validation.balanced(df, "domain", 1, 5).first()[0] and not validation.balanced(df, "source_record_id", 4, 1).first()[0]
    assert not validation.balanced(df.limit(0), "domain").first()[0]


def test_slots(spark):
    specs = [
        ("b", "semantic", "53", None, True, False, None), ("a", "entity", "Tokyo", ["Tokyo"], True, False, None), ("a", "semantic", "again", None, True, False, None),
        ("s", "status", "ok", None, True, True, None), ("z", "entity", "local", None, True, False, None), ("n", "entity", None, None, True, False, None), ("", "entity", "v", None, True, False, None), ("q", "immutable", "", None, True, False, None),
    ]
    rows = [task(1, "t1", specs=specs), task(2, "t2", specs=[]), task(3, "t3", specs=specs, result=None, local=None), task(4, "t4", specs=specs, result='{"b": "[[FIELD_a]]", "a": "X"}')]
    df = spark.createDataFrame(rows, TASKS)
    maps = {r["id"]: [tuple(s) for s in r["m"]] for r in df.select("id", slots.slot_map().alias("m")).collect()}
    assert maps["t1"] == [("b", "[[FIELD_b]]", "semantic"), ("a", "[[FIELD_a]]", "entity")] and maps["t2"] == [] and [s[0] for s in maps["t3"]] == ["b", "a", "z"]
    protected = {r["id"]: r for r in slots.protect(df).collect()}
    assert json.loads(protected["t1"]["tool_result"])["b"] == "[[FIELD_b]]" and protected["t3"]["tool_result"] is None
    assert [s["value"] for s in protected["t1"]["field_specs"]][:4] == ["[[FIELD_b]]", "[[FIELD_a]]", "[[FIELD_a]]", "ok"]
    assert protected["t1"]["field_specs"][2]["accepted_values"] == ["[[FIELD_a]]"] and protected["t2"]["tool_result"] == rows[1][8]
    answers = spark.createDataFrame([(1, "t1", "[[FIELD_a]]：代码[[FIELD_b]]。"), (2, "t1", "plain"), (3, "gone", "[[FIELD_a]]"), (4, "t4", "[[FIELD_b]]!"), (5, "t1", None), (6, "t3", "[[FIELD_a]]|")], "pred_id bigint, id string, answer string")
    assert {r["pred_id"]: r["answer"] for r in slots.restore_answers(answers, df).collect()} == {1: "Tokyo：代码53。", 2: "plain", 3: "[[FIELD_a]]", 4: "X!", 5: None, 6: "|"}
    valued = slots.protect(df.withColumn("evaluation_values", F.create_map(F.lit("a"), F.array(F.lit("Tokyo")), F.lit("s"), F.array(F.lit("ok")))))
    assert {r["id"]: r["evaluation_values"] for r in valued.collect()}["t1"] == {"a": ["[[FIELD_a]]"], "s": ["ok"]}
    assert slots.text_of(True) == "True" and slots.text_of(None) == "None"


def test_messages(spark):
    df = spark.createDataFrame([task(1, "t1"), task(2, "t2", specs=[], result="cut {")], TASKS)
    prompts = spark.createDataFrame([(m, f"do {m}") for m in slots.METHODS], "method string, text string")
    out = {(r["id"], r["method"]): r["messages"] for r in slots.render_messages(df, prompts).collect()}
    assert len(out) == 8
    system, user = out["t1", "protected_slot_realization"]
    assert (system["role"], system["content"], user["role"]) == ("system", "do protected_slot_realization", "user")
    head, _, body = user["content"].partition("\n")
    payload = json.loads(body)
    assert head.startswith("Generate the final") and body.startswith('{\n  "id": "t1"')
    assert payload["tool_result"]["a"] == "[[FIELD_a]]" and payload["protected_slots"][0]["role"] == "entity" and payload["field_policy"][0]["required"] is True
    plain = json.loads(out["t2", "naive"][1]["content"].partition("\n")[2])
    assert plain["tool_result"] == "cut {" and "field_policy" not in plain and "protected_slots" not in plain
    with pytest.raises(ValueError):
        slots.render_messages(df, prompts, ["other"])


def test_audit(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"clean.txt": "all fine 172.32.0.1 110.0.0.1", "path.txt": "see /home/" + "x/y", "net.md": "at 10.1.2.3 and 192.168.7.7", "key.cfg": "api_key = " + "abcd1234", "mail.txt": "A@b.org a@B.org anonymous@invalid.example", "sub/owner-x.txt": "by OWNER-X", "big.bin": "0" * 64}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "raw.bin").write_bytes(b"\xff\xfe /home/a")
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "c.txt").write_text("/home/x")
    got = {(r["label"], r["reason"]) for r in audit.tree_findings(spark, str(tmp_path), owner="owner-x", most=60).collect()}
    assert got == {
        ("path.txt", "local path"), ("net.md", "private network address"), ("key.cfg", "credential-like assignment"), ("mail.txt", "email address a@b.org"),
        ("sub/owner-x.txt", "repository owner appears in filename"), ("sub/owner-x.txt", "repository owner identity"), ("big.bin", "oversized file (64 bytes)"),
    }
    assert "unable" in audit.git_identities(spark, str(tmp_path)).first()["reason"]
    subprocess.run("git init -q . && git -c user.name=N -c user.email=n@x.org commit -q --allow-empty -m m", shell=True, cwd=tmp_path, check=True)
    assert "N <n@x.org>" in audit.git_identities(spark, str(tmp_path)).first()["reason"]
    nulls = spark.createDataFrame([(None, None), (1, "")], "label bigint, text string")
    assert audit.findings(nulls, "label", "text").count() == 0


def test_results(spark):
    rows = [("m1", "extract_localize_verify", 0.5, 0.25, 3.0, 100, 10, 10), ("m2", "extract_localize_verify", 0.75, None, 4.0, 300, 30, 0), ("m1", "protected_slot_realization", 0.7, 0.5, 2.0, 100, 10, 10), ("m2", "protected_slot_realization", 0.9, 0.75, 2.5, 300, None, 30)]
    df = spark.createDataFrame(rows, "model string, method string, core_pass double, hybrid_faithfulness double, naturalness double, core_n bigint, gemini_n bigint, naturalness_n bigint")
    s = {r["method"]: r for r in results.method_summary(df).collect()}
    assert math.isclose(s["extract_localize_verify"]["corepass"], 0.6875) and math.isclose(s["extract_localize_verify"]["hybrid"], 0.25) and math.isclose(s["protected_slot_realization"]["hybrid"], 0.5)
    h = {r["name"]: r["value"] for r in results.headline(df).collect()}
    assert math.isclose(h["corepass_delta_pp"], 100 * (0.85 - 0.6875)) and math.isclose(h["naturalness_delta"], 2.375 - 3.0)
    expected = spark.createDataFrame([("corepass_elv", 0.6875), ("absent", 1.0)], "name string, value double")
    assert {r["name"]: r["agrees"] for r in results.compare(expected, results.headline(df)).collect()} == {"corepass_elv": True, "absent": False}
    signs = results.model_signs(df, "core_pass").first()
    assert (signs["positive"], signs["negative"], signs["p_value"]) == (2, 0, 0.5)
    assert results.exact_binomial_two_sided(0, 8) == 0.0078125 and results.exact_binomial_two_sided(1, 7) == 0.0703125 and results.exact_binomial_two_sided(0, 0) == 1.0
    assert results.exact_binomial_two_sided(700, 2000) < 1e-100
    p = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None), ("g", 0.9)], "family string, p double")
    assert sorted((r["family"], r["p"], round(r["p_holm"], 9)) for r in results.holm(p, "p", ["family"]).filter("p IS NOT NULL").collect()) == [("f", 0.01, 0.03), ("f", 0.03, 0.06), ("f", 0.04, 0.06), ("g", 0.9, 0.9)]
    low, high = df.limit(1).select(*results.wilson(F.lit(0.459473), F.lit(4096))).first()
    assert abs(low - 0.444256) < 1e-5 and abs(high - 0.474765) < 1e-5
    low, high = df.limit(1).select(*results.delta_interval(F.lit(0.642045), F.lit(1232), F.lit(0.446429), F.lit(1232))).first()
    assert abs(low - 0.140561) < 1e-5 and abs(high - 0.249457) < 1e-5
    assert results.paired_deltas(df, "model", ["core_pass"]).filter("model = 'm1'").first()["delta_core_pass"] == pytest.approx(0.2)
    paired = spark.range(4096).selectExpr("id < 1366 OR id >= 3000 AS a", "id >= 1366 AND id < 1495 OR id >= 3000 AS b")
    m = results.mcnemar(paired, "a", "b").first()
    assert (m["n"], m["comparison_only"], m["baseline_only"]) == (4096, 1366, 129) and m["delta"] == 0.302001953125 and math.isclose(m["p_value"], 4.634225599765438e-261, rel_tol=1e-9)
    z = df.limit(1).select(results.two_proportion_z(F.lit(0.5), F.lit(100), F.lit(0.5), F.lit(50))).first()[0]
    assert z == 1.0


def test_jsonl(spark, tmp_path):
    records = [
        {"id": "a", "answer": "x"}, {"id": "", "sample_id": "b", "response": "y", "method": "naive"}, {"sample_id": "c", "output": "z", "method": None}, {"id": "d", "answer": None, "response": "r"},
    ]
    (tmp_path / "p.jsonl").write_text("\n\n".join(json.dumps(r) for r in records) + "\n   \n", encoding="utf-8")
    got = [tuple(r)[1:] for r in jsonl.read_predictions(spark, str(tmp_path / "p.jsonl")).orderBy("pred_id").collect()]
    assert got == [("a", None, "unknown", "x"), ("", "b", "naive", "y"), (None, "c", None, "z"), ("d", None, "unknown", None)]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n\n{"a": \n"s"\n')
    bad = jsonl.line_errors(spark, str(tmp_path / "bad.jsonl"))
    assert [(r["line"], r["problem"]) for r in bad.orderBy("line").collect()] == [(2, "not an object"), (4, "invalid JSON"), (5, "not an object")]
    assert all(r["file"].endswith("/bad.jsonl") for r in bad.collect())
    (tmp_path / "long.jsonl").write_text("".join('{"a": 1}\n\n' if i != 40_000 else "[\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    assert [(r["line"], r["problem"]) for r in jsonl.line_errors(spark, str(tmp_path / "long.jsonl")).collect()] == [(80_001, "invalid JSON")]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "t.jsonl").write_text(json.dumps({"id": "t", "tool_result": {"b": [1, {"c": 2}]}, "field_specs": [{"path": "b", "value": "1"}], "other": 5}))
    t = jsonl.read_tasks(spark, str(tmp_path / "t.jsonl")).first()
    assert json.loads(t["tool_result"]) == {"b": [1, {"c": 2}]} and t["field_specs"][0]["path"] == "b" and t["domain"] is None
    (tmp_path / "ids.txt").write_text(" b \n\na\n")
    ids = jsonl.read_ids(spark, str(tmp_path / "ids.txt"))
    assert [r["id"] for r in ids.orderBy("line_no").collect()] == ["b", "a"]
    jsonl.write_ids(ids, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "naive.md").write_text("Line 1\nLine 2\n")
    assert [tuple(r) for r in jsonl.read_prompts(spark, str(tmp_path / "prompts")).collect()] == [("naive", "Line 1\nLine 2\n")]
    (tmp_path / "r.csv").write_text("model,method,core_n,core_pass\nm,naive,10,0.5\n")
    r = jsonl.read_results(spark, str(tmp_path / "r.csv")).first()
    assert (r["core_n"], r["core_pass"]) == (10, 0.5)
    (tmp_path / "d.json").write_text('{\n "a": 1\n}')
    assert jsonl.read_document(spark, str(tmp_path / "d.json")).first()["a"] == 1
