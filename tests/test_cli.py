import json

from fieldproof import cli
from fieldproof.operators import results


def record(id, record="r", value="Tokyo"):
    keys = dict(domain="d", source_record_id=record, user_language="zh", expected_answer_language="zh", user_query="q", tool_name="t", tool_result={"a": value}, required_fields=["a"], forbidden_hallucinations=[], preserve_exact_fields=[], localizable_fields=[])
    return json.dumps({"id": id, **keys, "field_specs": [{"path": "a", "role": "entity", "value": value, "accepted_values": ["东京"], "required": True}]}, ensure_ascii=False)


def test_commands(spark, tmp_path, capsys):
    data, answers = tmp_path / "t.jsonl", tmp_path / "p.jsonl"
    data.write_text("\n".join([record("d_zh_001", "r1"), record("d_zh_002", "r2")]), encoding="utf-8")
    answers.write_text(json.dumps({"id": "d_zh_001", "method": "naive", "answer": "在东京"}, ensure_ascii=False) + "\n" + json.dumps({"id": "d_zh_002", "method": "naive", "response": "在"}, ensure_ascii=False), encoding="utf-8")
    assert cli.main(["evaluate", "--data", str(data), "--predictions", str(answers), "--output", str(tmp_path / "out")]) == 0
    overall = json.loads(capsys.readouterr().out)
    assert overall[0]["n"] == 2 and overall[0]["core_pass"] == 0.5
    answers.write_text(json.dumps({"id": "gone", "answer": "x"}))
    assert cli.main(["evaluate", "--data", str(data), "--predictions", str(answers), "--output", str(tmp_path / "out")]) == 1
    assert cli.main(["validate", "--data", str(data)]) == 0
    assert cli.main(["split", "--data", str(data), "--output", str(tmp_path / "s")]) == 0
    assert cli.main(["split", "--data", str(data), "--output", str(tmp_path / "s"), "--check"]) == 0
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "naive.md").write_text("P")
    capsys.readouterr()
    assert cli.main(["render", "--data", str(data), "--prompts", str(tmp_path / "prompts"), "--sample-id", "d_zh_001", "--method", "naive"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["content"] == "P"
    data.write_text(record("d_zh_001", "r1") + "\n" + record("d_zh_001", "r2"), encoding="utf-8")
    assert cli.main(["validate", "--data", str(data)]) == 1
    data.write_text(record("d_zh_001", "r1") + "\n\n{cut", encoding="utf-8")
    capsys.readouterr()
    assert cli.main(["validate", "--data", str(data)]) == 1 and "line 3: invalid JSON" in capsys.readouterr().out
    assert cli.main(["evaluate", "--data", str(data), "--predictions", str(data), "--output", str(tmp_path / "out")]) == 1
    data.write_text(record("d_zh_001", "r1") + "\n" + record("d_zh_002", "r1"), encoding="utf-8")
    assert cli.main(["split", "--data", str(data), "--output", str(tmp_path / "s")]) == 1
    assert cli.main(["audit", "--root", str(tmp_path / "prompts")]) == 0


# Published core rates of eight models for the two methods, to six decimals, n = 512 each.
CORE = {
    "extract_localize_verify": [0.441406, 0.552734, 0.484375, 0.386719, 0.359375, 0.759766, 0.664062, 0.550781],
    "protected_slot_realization": [0.591797, 0.832031, 0.855469, 0.748047, 0.607422, 0.810547, 0.857422, 0.789062],
}


def test_published_headline(spark):
    """The published rates give the published pooled values and their difference."""
    rows = [(f"m{i}", method, x, 512) for method, many in CORE.items() for i, x in enumerate(many)]
    table = spark.createDataFrame(rows, "model string, method string, core_pass double, core_n bigint").selectExpr("*", "core_pass AS hybrid_faithfulness", "core_n AS gemini_n", "core_pass AS naturalness", "core_n AS naturalness_n")
    got = {r["name"]: r["value"] for r in results.headline(table).collect()}
    assert abs(got["corepass_elv"] - 0.52490234375) < 1e-6 and abs(got["corepass_protected"] - 0.761474609375) < 1e-6
    assert abs(got["corepass_delta_pp"] - 23.6572265625) < 1e-4
    signs = results.model_signs(table, "core_pass").first()
    assert (signs["positive"], signs["negative"], signs["p_value"]) == (8, 0, 0.0078125)
