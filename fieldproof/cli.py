"""Command line: evaluate, validate, split, render, summarise, audit and flatten.

    python -m fieldproof.cli evaluate --data tasks.jsonl --predictions answers.jsonl --output folder [--evaluation-policy strict]
    python -m fieldproof.cli validate --data tasks.jsonl [--attribution] [--expected-rows N]
    python -m fieldproof.cli split --data tasks.jsonl --output folder [--check]
    python -m fieldproof.cli render --data tasks.jsonl --prompts folder --sample-id ID --method naive
    python -m fieldproof.cli summarise --results results.csv [--expected headline.json]
    python -m fieldproof.cli audit --root folder [--include-git]
    python -m fieldproof.cli flatten --tables folder --output folder
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from fieldproof.functions.dictionaries import METHODS, POLICIES
from fieldproof.operators import audit, evaluation, flatten, results, slots, validation
from fieldproof.sources import jsonl
from fieldproof.sources.tables import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate")
    for name in ("--data", "--predictions", "--output"):
        e.add_argument(name, required=True)
    e.add_argument("--evaluation-policy", choices=POLICIES, default="strict")
    v = sub.add_parser("validate")
    v.add_argument("--data", required=True)
    v.add_argument("--attribution", action="store_true", help="the rows carry an attribution_condition")
    v.add_argument("--expected-rows", type=int, help="rows the table must have; at the released sizes its languages, domains or conditions are checked too")
    s = sub.add_parser("split")
    s.add_argument("--data", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--check", action="store_true", help="compare with the lists in the output folder instead of writing them")
    r = sub.add_parser("render")
    for name in ("--data", "--prompts", "--sample-id"):
        r.add_argument(name, required=True)
    r.add_argument("--method", choices=METHODS, required=True)
    m = sub.add_parser("summarise")
    m.add_argument("--results", required=True)
    m.add_argument("--expected")
    a = sub.add_parser("audit")
    a.add_argument("--root", required=True)
    a.add_argument("--owner")
    a.add_argument("--include-git", action="store_true")
    f = sub.add_parser("flatten")
    f.add_argument("--tables", required=True, help="folder of tasks.parquet")
    f.add_argument("--output", required=True)
    return p


def show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2))


def malformed(spark: SparkSession, path: str) -> list[str]:
    """The first line of a file that holds no record, as a message; none if all do."""
    return [f"{r['file']}, line {r['line']}: {r['problem']}" for r in jsonl.line_errors(spark, path).orderBy("file", "line").limit(1).collect()]


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs a command; the result is the exit code."""
    if a.command == "evaluate":
        if broken := malformed(spark, a.data) or malformed(spark, a.predictions):
            print(broken[0], file=sys.stderr)
            return 1
        tasks, predictions = jsonl.read_tasks(spark, a.data), jsonl.read_predictions(spark, a.predictions)
        refused = evaluation.rejected(predictions).unionByName(evaluation.unknown_ids(predictions, tasks).selectExpr("pred_id", "concat('unknown id: ', id) AS reason")).orderBy("pred_id").limit(1).collect()
        if refused:
            print(f"prediction {refused[0]['pred_id']}: {refused[0]['reason']}", file=sys.stderr)
            return 1
        rows = evaluation.evaluate(predictions, tasks, a.evaluation_policy)
        rows.write.mode("overwrite").parquet(f"{a.output}/per_sample")
        kept = spark.read.parquet(f"{a.output}/per_sample")
        jsonl.write_report(evaluation.reports(kept), kept.limit(0), f"{a.output}/report", a.evaluation_policy)
        with open(f"{a.output}/report/report.json", encoding="utf-8") as f:
            show(json.load(f)["overall"])
        return 0
    if a.command == "validate":
        tasks = jsonl.read_tasks(spark, a.data)
        found = malformed(spark, a.data)
        if not found:
            problems = validation.attribution_problems(tasks, expected_rows=a.expected_rows) if a.attribution else validation.main_problems(tasks, a.expected_rows)
            found = [r["problem"] for r in problems.collect()]
        if found:
            show(found[0])
            return 1
        out = validation.summary(tasks).first().asDict()
        if a.attribution:
            out["condition_counts"] = {r["condition"]: r["n"] for r in validation.condition_counts(tasks, "attribution_condition").collect()}
        show(out)
        return 0
    if a.command == "split":
        split = validation.suffix_split(jsonl.read_tasks(spark, a.data))
        if validation.split_problems(split).limit(1).count() or validation.split_leaks(split).limit(1).count():
            print("an id has no split or several, or a record is in both splits", file=sys.stderr)
            return 1
        for name in ("dev", "test"):
            ids, folder = validation.split_ids(split, name), f"{a.output}/{name}_ids"
            if not a.check:
                jsonl.write_ids(ids, folder)
            elif validation.split_differences(jsonl.read_ids(spark, folder), ids).limit(1).count():
                print(f"{name} differs", file=sys.stderr)
                return 1
        return 0
    if a.command == "render":
        tasks = evaluation.latest_tasks(jsonl.read_tasks(spark, a.data)).filter(F.col("id") == a.sample_id)
        rows = slots.render_messages(tasks, jsonl.read_prompts(spark, a.prompts), [a.method]).collect()
        show([m.asDict() for r in rows for m in r["messages"]])
        return int(not rows)
    if a.command == "summarise":
        computed = results.headline(jsonl.read_results(spark, a.results))
        values = {r["name"]: r["value"] for r in computed.collect()}
        show(values)
        if a.expected:
            with open(a.expected, encoding="utf-8") as f:
                wanted = spark.createDataFrame([(k, float(v)) for k, v in json.load(f).items()], "name string, value double")
            return int(results.compare(wanted, computed).filter("NOT agrees").count() > 0)
        return 0
    if a.command == "flatten":
        flatten.write_tables(flatten.emit_nodes(table(spark, a.tables, "tasks"), "line_no", ["tool_result"], ["field_specs"]), a.output)
        show(flatten.table_report(spark.read.parquet(a.output)))
        return 0
    found = [f"{r['label']}: {r['reason']}" for r in audit.tree_findings(spark, a.root, a.owner, include_git=a.include_git).collect()]
    show(found)
    return int(bool(found))


def main(argv: list[str] | None = None) -> int:
    from fieldproof.session import local_session

    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session("cli")
    return run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
