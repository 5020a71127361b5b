import math

import pytest
from pyspark.sql import functions as F

from fieldproof.functions import matching as mt
from fieldproof.functions import text as tx
from fieldproof.operators import evaluation

SPECS = "array<struct<path string, role string, value string, accepted_values array<string>, required boolean, requires_localization boolean, description string>>"
TASKS = f"line_no bigint, id string, domain string, user_language string, expected_answer_language string, field_specs {SPECS}, forbidden_hallucinations array<string>"
PREDICTIONS = "pred_id bigint, id string, sample_id string, method string, answer string, extra string"
LISTS = ["missing_fields", "immutable_corruptions", "entity_mismatches", "semantic_mismatches", "underlocalized_fields", "forbidden_hits"]


def spec(path, role, value, accepted=None, required=True, localize=False):
    return (path, role, value, accepted, required, localize, None)


WEATHER = [
    spec("location_name", "entity", "Tokyo", ["Tokyo", "东京"]),
    spec("date", "semantic", "2025-07-01"),
    spec("temperature", "semantic", "33.9"),
    spec("weather_code", "semantic", "53"),
    spec("weather_condition", "status", "moderate drizzle", None, True, True),
    spec("station", "immutable", "AB-12"),
    spec("currency", "immutable", "usd"),
    spec("language", "immutable", "en", None, None),
    spec("extra", "semantic", "a, b and c", None, False),
]
ROWS = [
    (1, "t1", "weather", "zh", "zh", WEATHER, ["best city", "", None]),
    (2, "t2", "holiday", "th", "th", [spec("date", "semantic", "2025-07-01 09:30"), spec("kind", "status", "public", ["public"], True, True), spec("n", "semantic", "1,024")], None),
    (3, "t3", "book", "id", "id", [spec("list", "semantic", "red, green and blue"), spec("country_code", "immutable", "jp"), spec("nothing", "semantic", None), spec("blank", "immutable", "")], ["Dijamin"]),
    (4, "t4", "food", "en", "en", [], []),
    (5, "t5", "food", "kk-Arab", "kk-Arab", None, None),
    (6, "t6", "food", "ug", "wrong", [spec("a", "entity", "x")], None),
    (7, "t1", "weather", "zh", "zh", WEATHER, ["best city"]),
    (8, "t7", "weather", "en", "en", [spec("s", "status", "Active", None, True, True), spec("w", "entity", "ＡＢＣ、Tokyo")], None),
]
ANSWERS = {
    "t1": ["东京，2025年7月1日，33.9°C，代码53，中度毛毛雨，AB-12，usd，en", "Tokyo 339 1530 moderate drizzle AB-12 美元 英语 BEST CITY", "東京は2025/07/01", "", "ＡＢ-12 Ｔｏｋｙｏ ５３ 东京 1/7/2568", "tokyo " * 3000 + " 中 53"],
    "t2": ["วันที่ ๑/๗/๒๕๖๘ เวลา 09:30 สาธารณะ 1024", "2025-07-01T09:30:00Z public 1.024", "1 กรกฎาคม 2568 10:30 1,0245"],
    "t3": ["warna adalah blue, red, green; Jepang; None", "adalah red green jp", "dijamin BLUE GREEN RED Japan none"],
    "t4": ["three plain words here", "two words", "three words и кириллица", "word 中 word word"],
    "t5": ["اتاۋى بولسا x، سانى 5", "اتى", "اتاۋى سانى 中"],
    "t6": ["x بۇ"],
    "t7": ["The status is Active here, ABC and Tokyo", "All three words, 日本"],
}
# worked out by hand: for each answer in order, language accuracy and the fields named in each list (semantic ones before status ones), strict
EVERY = "location_name date temperature weather_code weather_condition station currency language"
EXPECTED = [
    (1, "", "", "", "", "", ""),
    (1, "date temperature weather_code currency language", "currency language", "", "date temperature weather_code", "weather_condition", "best city"),
    (0, EVERY.replace("date ", ""), "station currency language", "location_name", "temperature weather_code weather_condition", "", ""),
    (0, EVERY, "station currency language", "location_name", "date temperature weather_code weather_condition", "", ""),
    (1, "temperature weather_condition currency language", "station currency language", "", "temperature weather_condition", "", ""),
    (1, "date temperature weather_condition station currency language", "station currency language", "", "date temperature weather_condition", "", ""),
    (1, "", "", "", "", "", ""),
    (0, "", "", "", "", "kind", ""),
    (1, "kind n", "", "", "n kind", "", ""),
    (1, "country_code", "country_code", "", "", "", ""),
    (1, "list nothing", "", "", "list nothing", "", ""),
    (0, "country_code", "country_code", "", "", "", "Dijamin"),
    (1, "", "", "", "", "", ""),
    *[(0, "", "", "", "", "", "")] * 3,
    (1, "", "", "", "", "", ""),
    *[(0, "", "", "", "", "", "")] * 3,
    (1, "", "", "", "", "", ""),
    (0, "s w", "", "w", "s", "", ""),
]
# under the relaxed policy these fields are neither missing nor corrupted: their codes are named in words
NAMED_CODES = {2: {"currency", "language"}, 10: {"country_code"}, 12: {"country_code"}}


@pytest.fixture(scope="module")
def data(spark):
    tasks = spark.createDataFrame(ROWS, TASKS)
    rows, n = [], 0
    for task, answers in ANSWERS.items():
        for a in answers:
            n += 1
            rows.append((n, task if n % 2 else None, task, "naive" if n % 3 else None, a, "x"))
    rows += [(900, "gone", None, "naive", "x", None), (901, "", "", "naive", "x", None), (902, "t1", None, "naive", None, None), (903, "t4", None, "naive", "three plain words here", None)]
    return tasks, spark.createDataFrame(rows, PREDICTIONS), rows


@pytest.mark.parametrize("policy", ["strict", "relaxed"])
def test_worked_rows(data, policy):
    tasks, predictions, rows = data
    got = {r["pred_id"]: r for r in evaluation.evaluate(predictions, tasks, policy).collect()}
    assert set(got) == {*range(1, len(EXPECTED) + 1), 903}
    for n, (language, *lists) in enumerate(EXPECTED, 1):
        row = got[n]
        allowed = NAMED_CODES.get(n, set()) if policy == "relaxed" else set()
        for name, paths in zip(LISTS, lists):
            want = [paths] if name == "forbidden_hits" and paths else paths.split()
            assert list(row[name]) == [p for p in want if p not in allowed or name not in LISTS[:2]], (n, name)
        assert row["language_accuracy"] == language and row["method"] == ("naive" if n % 3 else "unknown")
        assert row["core_pass"] == (language == 1 and not any(row[x] for x in LISTS))
    assert got[2]["field_coverage"] == ((3 if policy == "strict" else 5) / 8) and got[5]["immutable_preservation"] == 0 and got[9]["semantic_fidelity"] == 1 / 3
    assert math.isclose(got[8]["faithful_localization_score"], 5 / 7) and got[14]["target_script_present"] == 1 and got[16]["wrong_script_free"] == 0


def test_properties(spark, data):
    """Text that is added can't take away a value, and what fails strictly may only pass relaxed, never the other way."""
    tasks, predictions, _ = data
    longer = predictions.withColumn("answer", F.concat(F.lit("「"), "answer", F.lit("」")))
    base, more, relaxed = (evaluation.evaluate(p, tasks, policy) for p, policy in ((predictions, "strict"), (longer, "strict"), (predictions, "relaxed")))
    key = ["pred_id", "field_coverage", "immutable_preservation", "entity_fidelity", "semantic_fidelity"]
    a, b, c = ({r["pred_id"]: tuple(r)[1:] for r in x.select(*key).collect()} for x in (base, more, relaxed))
    assert a == b and all(x <= y for k in a for x, y in zip(a[k], c[k]))


def test_codes_and_boundaries(spark):
    rows = [("aＢ.c(d", "x AB.C(D y", True), ("a.c", "abc", False), ("jp", "jpy", False), ("jp", "日本JP。", True), ("", "x", True), ("q\\e", "Q\\E!", True), ("é", "É", True)]
    df = spark.createDataFrame(rows, "code string, answer string, want boolean").select("want", tx.nfkc("code").alias("code"), tx.nfkc("answer").alias("answer"))
    assert all(r[0] == r[1] for r in df.select("want", mt.has_code(F.col("answer"), F.col("code"))).collect())
    words = spark.createDataFrame([("cafe\u0301 one two",), ("a_b c1 dd",), ("one two三",)], "t string")
    got = [r[0]["marker"] for r in words.select(mt.language_diagnostics(F.col("t"), F.col("t"), F.col("t"), F.col("t"), F.lit("en"))).collect()]
    assert got == [True, False, False]


def test_hot_task(spark, data):
    """A task that holds most predictions gives one row for each of them."""
    tasks, _, _ = data
    many = spark.range(3000).selectExpr("id AS pred_id", "'t1' AS id", "CAST(NULL AS string) AS sample_id", "'naive' AS method", "concat('东京 53 ', id) AS answer")
    assert evaluation.evaluate(many, tasks).count() == 3000


def test_reports_and_guards(data):
    tasks, predictions, _ = data
    out = evaluation.reports(evaluation.evaluate(predictions, tasks))
    n = {r["report"]: r["n"] for r in out.groupBy("report").agg(F.sum("n").alias("n")).collect()}
    assert len(set(n.values())) == 1 and set(n) == {"overall", "by_language", "by_domain"}
    assert [tuple(r) for r in evaluation.unknown_ids(predictions, tasks).collect()] == [(900, "gone")]
    assert {tuple(r) for r in evaluation.rejected(predictions).collect()} == {(901, "no id"), (902, "no answer")}
    assert evaluation.latest_tasks(tasks).filter("id = 't1'").first()["line_no"] == 7
    assert evaluation.evaluate(predictions.limit(0), tasks).count() == 0
    assert evaluation.evaluate(predictions, tasks.limit(0)).count() == 0
    with pytest.raises(ValueError):
        evaluation.evaluate(predictions, tasks, "loose")


FORMS = {  # text: match form, loose form, dates, date-times, parts
    "1,234,567.891 x": ("1234567891x", "1234567891x", [], [], ["1", "234", "567.891 x"]),
    "Ⅳ ２０２５年１２月３１日 ok": ("iv2025年12月31日ok", "iv2025年12月31日ok", ["2025-12-31"], [], []),
    "31/02/2025": ("31/02/2025", "31022025", ["2025-02-31"], [], []),
    "2025-13-01": ("2025-13-01", "20251301", [], [], []),
    "May 3rd, 2024 at 7:05": ("may3rd,2024at7:05", "may3rd2024at705", ["2024-05-03"], ["2024-05-03T07:05:00Z"], []),
    "3 mei 2567 7:05:09": ("3mei25677:05:09", "3mei256770509", ["2024-05-03"], ["2024-05-03T07:05:09Z"], []),
    "๒๕๖๘-๐๑-๐๒": ("2568-01-02", "25680102", ["2025-01-02"], [], []),
    "٣/٤/٢٠٢٤": ("٣/٤/٢٠٢٤", "٣٤٢٠٢٤", ["2024-04-03"], [], []),
    "": ("", "", [], [], []),
    "a,b": ("a,b", "ab", [], [], ["a", "b"]),
    "red, sandy and 青和白": ("red,sandyand青和白", "redsandyand青和白", [], [], ["red", "sandy", "青", "白"]),
    "2024-01-02 23:59:59": ("2024-01-0223:59:59", "20240102235959", ["2024-01-02"], ["2024-01-02T23:59:59Z"], []),
    "2024-01-02 and 5:61": ("2024-01-02and5:61", "20240102and561", ["2024-01-02"], ["2024-01-02T05:61:00Z"], []),
    "x\x1cy　z": ("xyz", "xyz", [], [], []),
}


def test_text_forms(spark):
    df = spark.createDataFrame([(t,) for t in FORMS], "t string").select("t", tx.nfkc("t").alias("n")).select("t", tx.ascii_thai_digits(F.col("n")).alias("p"))
    forms = df.select("t", mt.answer_forms(F.col("t"), F.col("p")).alias("f"))
    for r in forms.select("t", "f", tx.list_parts(F.col("t"), F.col("f.dates")).alias("parts")).collect():
        f = r["f"]
        assert (f["match"], f["loose"], sorted(f["dates"]), sorted(f["stamps"]), list(r["parts"])) == FORMS[r["t"]], r["t"]
