from datetime import datetime

from fieldproof.operators.evaluation import evaluate, reports
from fieldproof.sources.jsonl import write_report
from fieldproof.streaming import scoring

SPECS = "array<struct<path string, role string, value string, accepted_values array<string>, required boolean, requires_localization boolean, description string>>"


def tables(spark):
    tasks = spark.createDataFrame([(1, "t", "d", "zh", "zh", [("a", "entity", "Tokyo", ["东京"], True, False, None)], [])], f"line_no bigint, id string, domain string, user_language string, expected_answer_language string, field_specs {SPECS}, forbidden_hallucinations array<string>")
    rows = [(i, "t", None, None if i % 2 else "naive", "东京" if i % 3 else None, datetime(2024, 1, 1 + i % 2, 5), None) for i in range(12)]
    predictions = spark.createDataFrame(rows, "pred_id bigint, id string, sample_id string, method string, answer string, created_at timestamp_ntz, ingested_at timestamp_ntz")
    return tasks, predictions


def test_stream_equals_batch(spark, tmp_path):
    tasks, predictions = tables(spark)
    predictions.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.prediction_stream(spark, str(tmp_path / "in"), predictions.schema)
    scoring.append_scores(scoring.scored_stream(stream, tasks), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = evaluate(predictions, tasks)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["pred_id"] for r in got.collect()) == sorted(r["pred_id"] for r in batch.collect())
    assert got.filter("core_pass").count() == batch.filter("core_pass").count() > 0
    query = scoring.arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, spark.table("arrivals").collect()), key=key) == sorted(map(tuple, scoring.arrivals(predictions).collect()), key=key)


def test_report_document(spark, tmp_path):
    import json

    tasks, predictions = tables(spark)
    rows = evaluate(predictions, tasks)
    write_report(reports(rows), rows, str(tmp_path / "r"), "strict")
    document = json.loads((tmp_path / "r" / "report.json").read_text())
    assert [x["method"] for x in document["overall"]] == ["naive", "unknown"] and document["by_language"][0]["language"] == "zh"
    assert spark.read.parquet(str(tmp_path / "r" / "per_sample")).count() == rows.count()
