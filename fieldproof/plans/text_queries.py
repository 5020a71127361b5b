"""Queries over single steps of the evaluation: text forms, dates, enumerations, aliases, language rules and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldproof.functions import matching as mt
from fieldproof.functions import text as tx
from fieldproof.functions.dictionaries import KAZAKH_MARKERS, LANGUAGE_CODES, UYGHUR_MARKERS, VALUE_ALIASES
from fieldproof.functions.jsontext import outer_object, text_at
from fieldproof.operators import evaluation
from fieldproof.plans import evaluation_sql as es
from fieldproof.plans.evaluation_sql import LATEST, PRED
from fieldproof.plans.register import predictions_of, registry, tasks_of
from fieldproof.sources import jsonl
from fieldproof.sources.tables import table

QUERIES, SQL, query = registry()
ANSWERS = "SELECT DISTINCT answer AS text FROM predictions WHERE answer IS NOT NULL"


def forms_of_answers(spark: SparkSession, d: str) -> DataFrame:
    """(pred_id, f): the forms of every answer."""
    p = predictions_of(spark, d).filter("answer IS NOT NULL").select("pred_id", "answer", tx.nfkc("answer").alias("plain"))
    return p.select("pred_id", mt.answer_forms(F.col("answer"), tx.ascii_thai_digits(F.col("plain"))).alias("f"))


def joined(values: Column) -> Column:
    """Texts in code-point order as one text."""
    return F.array_join(F.array_sort(values), " ")


# --- text forms

@query("SELECT pred_id, translate(answer, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS answer FROM predictions")
def thai_digit_translate(spark: SparkSession, d: str) -> DataFrame:
    """Answers with Thai digits as ASCII digits."""
    return predictions_of(spark, d).select("pred_id", tx.ascii_thai_digits(F.col("answer")).alias("answer"))


@query(es.answers("plain"))
def nfkc_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Answers in compatibility-composed form with ASCII digits for Thai ones."""
    return forms_of_answers(spark, d).select("pred_id", "f.plain")


@query(es.answers("raw_lower, low AS lower, match, loose, array_to_string(list_sort(dates), ' ') AS dates, array_to_string(list_sort(stamps), ' ') AS stamps"))
def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    """The text forms answers are matched in."""
    return forms_of_answers(spark, d).select("pred_id", "f.raw_lower", "f.lower", "f.match", "f.loose", joined(F.col("f.dates")).alias("dates"), joined(F.col("f.stamps")).alias("stamps"))


@query(es.answers(f"{es.no_thousands('low')} AS plain, array_to_string(list_sort(list_distinct(numbers)), ' ') AS numbers"))
def thousands_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Answers without thousands separators, and the whole numbers they then hold."""
    return forms_of_answers(spark, d).select("pred_id", tx.no_thousands(F.col("f.lower")).alias("plain"), joined(F.array_distinct("f.numbers")).alias("numbers"))


@query(es.answers("array_to_string(list_sort(numeric_dates), ' ') AS dates") + " WHERE len(numeric_dates) > 0")
def extract_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that answers write in numbers."""
    numeric = tx.numeric_dates(tx.ascii_digits(F.col("f.lower")))
    return forms_of_answers(spark, d).select("pred_id", numeric.alias("x")).filter(F.size("x") > 0).select("pred_id", joined(F.col("x")).alias("dates"))


@query(es.answers("array_to_string(list_sort(named_dates), ' ') AS dates") + " WHERE len(named_dates) > 0")
def extract_named_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that answers write with the name of a month."""
    named = tx.named_dates(tx.ascii_digits(F.col("f.lower")))
    return forms_of_answers(spark, d).select("pred_id", named.alias("x")).filter(F.size("x") > 0).select("pred_id", joined(F.col("x")).alias("dates"))


# few answers state a time of day, so texts are made that begin with one
STAMPED = "SELECT pred_id, strftime(created_at, '%Y/%m/%d') || ' ' || strftime(ingested_at, '%H:%M:%S') || ' ' || COALESCE(answer, '') AS text FROM predictions WHERE created_at IS NOT NULL AND ingested_at IS NOT NULL"


@query(f"WITH s AS ({STAMPED}), {es.forms('f', 'SELECT DISTINCT text FROM s')} SELECT pred_id, array_to_string(list_sort(stamps), ' ') AS stamps FROM s JOIN f USING (text)")
def extract_datetimes(spark: SparkSession, d: str) -> DataFrame:
    """Date-times of texts that begin with the day a prediction was made and the time it came in."""
    p = predictions_of(spark, d).filter("created_at IS NOT NULL AND ingested_at IS NOT NULL")
    text = F.concat(F.date_format("created_at", "yyyy/MM/dd"), F.lit(" "), F.date_format("ingested_at", "HH:mm:ss"), F.lit(" "), F.coalesce("answer", F.lit("")))
    plain = p.select("pred_id", text.alias("text")).select("pred_id", tx.nfkc("text").alias("plain"))
    digits = plain.select("pred_id", tx.ascii_digits(F.lower(tx.ascii_thai_digits(F.col("plain")))).alias("text"))
    return digits.select("pred_id", joined(tx.bound(tx.dates(F.col("text")), lambda x: tx.datetimes(F.col("text"), x))).alias("stamps"))


@query(r"""
    WITH y AS (SELECT pred_id, CAST(unnest(regexp_extract_all(answer, '(?:^|[^0-9])([0-9]{4})', 1)) AS INTEGER) AS stored FROM predictions WHERE answer IS NOT NULL)
    SELECT pred_id, stored, CASE WHEN stored >= 2400 THEN stored - 543 ELSE stored END AS year, count(*) AS n FROM y GROUP BY ALL
""")
def buddhist_year_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that begin with four digits taken as years, those of the Buddhist era converted."""
    y = predictions_of(spark, d).select("pred_id", F.explode(F.regexp_extract_all("answer", F.lit("(?:^|[^0-9])([0-9]{4})"), F.lit(1))).alias("y")).select("pred_id", F.col("y").cast("int").alias("stored"))
    year = F.substring(tx.calendar_date(F.col("stored"), F.lit(1), F.lit(1)), 1, 4).cast("int")
    return y.groupBy("pred_id", "stored", year.alias("year")).agg(F.count("*").alias("n"))


# --- values

VALUES = "SELECT line_no, i - 1 AS pos, s.path AS path, s.value AS value, COALESCE(expected_answer_language, user_language) AS lang FROM (SELECT line_no, expected_answer_language, user_language, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM tasks) WHERE s.value IS NOT NULL"


def values_of(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, pos, path, value, lang) of the specifications that have a value."""
    rows = tasks_of(spark, d).select("line_no", F.coalesce("expected_answer_language", "user_language").alias("lang"), F.posexplode("field_specs").alias("pos", "s"))
    return rows.filter("s.value IS NOT NULL").select("line_no", F.col("pos").cast("bigint").alias("pos"), "s.path", "s.value", "lang")


@query(f"WITH v AS ({VALUES}), {es.forms('f', 'SELECT DISTINCT value AS text FROM v')} SELECT line_no, pos, letter, number, raw_lower AS lower FROM v JOIN f ON f.text = v.value")
def value_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of each value, whether it has a letter, whether it is a whole number, and its lower case."""
    plain = values_of(spark, d).select("line_no", "pos", "value", tx.nfkc("value").alias("plain"))
    return plain.select("line_no", "pos", mt.candidate_forms(F.col("value"), tx.ascii_thai_digits(F.col("plain"))).alias("f")).select("line_no", "pos", "f.letter", "f.number", "f.lower")


@query(f"""
    WITH e AS (SELECT line_no, 'all' AS kind, string_agg(value, ', ' ORDER BY pos) AS text FROM ({VALUES}) GROUP BY line_no
      UNION ALL SELECT line_no, 'wordy', string_agg(value, ' and ' ORDER BY pos) FROM ({VALUES}) WHERE NOT regexp_matches(value, '[0-9]') GROUP BY line_no),
    {es.forms('f', 'SELECT DISTINCT text FROM e')} SELECT line_no, kind, array_to_string(parts, ' | ') AS parts FROM e JOIN f USING (text)
""")
def list_candidate_split(spark: SparkSession, d: str) -> DataFrame:
    """The parts of enumerations made of a task's values; none where a date is among them."""
    def enumeration(values: DataFrame, kind: str, by: str) -> DataFrame:
        grouped = values.groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), by).alias("text"))
        return grouped.select("line_no", F.lit(kind).alias("kind"), "text")

    values = values_of(spark, d)
    both = enumeration(values, "all", ", ").unionByName(enumeration(values.filter(~F.col("value").rlike("[0-9]")), "wordy", " and "))
    plain = both.select("line_no", "kind", "text", tx.nfkc("text").alias("plain"))
    own_dates = tx.dates(tx.ascii_digits(F.lower(tx.ascii_thai_digits(F.col("plain")))))
    return plain.select("line_no", "kind", F.array_join(tx.list_parts(F.col("text"), own_dates), " | ").alias("parts"))


NAMED_VALUES = sorted({value for value, _ in VALUE_ALIASES})


@query(f"""
    WITH v AS ({VALUES}), every AS (SELECT line_no, -1 AS pos, 'holidayTypes' AS path, lang, unnest({es.listed(NAMED_VALUES)}) AS value FROM v WHERE pos = 0 UNION ALL SELECT line_no, pos, path, lang, value FROM v)
    SELECT line_no, pos, value, array_to_string(x, ' | ') AS aliases FROM (SELECT *, {es.aliases('value', 'lang', 'path')} AS x FROM every) WHERE len(x) > 0
""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Other names in the language of each task, of its own values and of every value that has some."""
    own = values_of(spark, d)
    each = own.filter("pos = 0").select("line_no", F.lit(-1).cast("bigint").alias("pos"), F.lit("holidayTypes").alias("path"), F.explode(F.array(*map(F.lit, NAMED_VALUES))).alias("value"), "lang")
    rows = each.unionByName(own).select("line_no", "pos", "value", mt.value_aliases(F.col("value"), F.col("lang"), F.col("path")).alias("x"))
    return rows.filter(F.size("x") > 0).select("line_no", "pos", "value", F.array_join("x", " | ").alias("aliases"))


@query(f"SELECT label, path, array_to_string(x, ' | ') AS aliases FROM (SELECT label, path, {es.codes('path', 'code')} AS x FROM language_names, (SELECT unnest(['language', 'countryCode', 'currency']) AS path)) WHERE len(x) > 0")
def code_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What the codes of the language list may be called at paths whose codes may be localised."""
    rows = table(spark, d, "language_names").select("label", "code", F.explode(F.array(F.lit("language"), F.lit("countryCode"), F.lit("currency"))).alias("path"))
    return rows.select("label", "path", mt.code_aliases(F.col("path"), F.col("code")).alias("x")).filter(F.size("x") > 0).select("label", "path", F.array_join("x", " | ").alias("aliases"))


# --- matching

@query(f"""
    WITH spec AS (SELECT id, unnest(field_specs).value AS value FROM ({LATEST})), {es.forms('f', ANSWERS)}, {es.forms('g', 'SELECT DISTINCT value AS text FROM spec WHERE value IS NOT NULL')}
    SELECT p.pred_id, count(*) AS n_numbers, sum(CASE WHEN list_contains(f.numbers, g.match) THEN 1 ELSE 0 END) AS n_found FROM ({PRED}) p JOIN f ON f.text = p.answer JOIN spec s ON s.id = p.id JOIN g ON g.text = s.value WHERE g.number GROUP BY p.pred_id
""")
def digit_boundary_match(spark: SparkSession, d: str) -> DataFrame:
    """Specified whole numbers, and how many stand in the answer with no digit beside them."""
    p = evaluation.normalised_predictions(predictions_of(spark, d)).select("pred_id", "id").join(forms_of_answers(spark, d), "pred_id")
    values = evaluation.latest_tasks(tasks_of(spark, d)).select("id", F.array_compact(F.transform("field_specs", lambda s: s["value"])).alias("x")).withColumn("plain", tx.nfkc_array("x"))
    own = F.filter(F.zip_with("x", "plain", lambda x, y: mt.candidate_forms(x, tx.ascii_thai_digits(y))), lambda c: c["number"])
    found = p.join(values.select("id", own.alias("own")).filter(F.size("own") > 0), "id")
    return found.select("pred_id", F.size("own").cast("bigint").alias("n_numbers"), F.size(F.filter("own", lambda c: mt.single_match(F.col("f"), c))).cast("bigint").alias("n_found"))


@query(f"""
    WITH spec AS (SELECT id, unnest(field_specs).value AS value FROM ({LATEST})), {es.forms('f', ANSWERS)}, {es.forms('g', 'SELECT DISTINCT value AS text FROM spec WHERE value IS NOT NULL')}
    SELECT p.pred_id, count(*) AS n_values, sum(CASE WHEN {es.matches('f', 'g')} THEN 1 ELSE 0 END) AS n_found FROM ({PRED}) p JOIN f ON f.text = p.answer JOIN spec s ON s.id = p.id JOIN g ON g.text = s.value GROUP BY p.pred_id
""")
def single_candidate_match(spark: SparkSession, d: str) -> DataFrame:
    """Specified values, and how many the answer expresses, taken one by one and whole."""
    p = evaluation.normalised_predictions(predictions_of(spark, d)).select("pred_id", "id").join(forms_of_answers(spark, d), "pred_id")
    values = evaluation.latest_tasks(tasks_of(spark, d)).select("id", F.array_compact(F.transform("field_specs", lambda s: s["value"])).alias("x")).withColumn("plain", tx.nfkc_array("x"))
    own = F.zip_with("x", "plain", lambda x, y: mt.candidate_forms(x, tx.ascii_thai_digits(y)))
    found = p.join(values.select("id", own.alias("own")).filter(F.size("own") > 0), "id")
    return found.select("pred_id", F.size("own").cast("bigint").alias("n_values"), F.size(F.filter("own", lambda c: mt.single_match(F.col("f"), c))).cast("bigint").alias("n_found"))


@query(f"""
    WITH {es.forms('a', ANSWERS)}, {es.forms('c', f"SELECT unnest({es.listed(LANGUAGE_CODES['en'])}) AS text")},
    n AS (SELECT a.text, bool_or({es.matches('a', 'c')}) AS named FROM a, c GROUP BY a.text)
    SELECT pred_id, regexp_matches(plain, '(?i)(^|[^A-Za-z0-9])en([^A-Za-z0-9]|$)') AS token, named FROM predictions p JOIN a ON a.text = p.answer JOIN n ON n.text = p.answer
""")
def relaxed_code_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer holds a language code by itself, or what the code may be called."""
    names = F.transform(mt.code_aliases(F.lit("language"), F.lit("en")), lambda x: mt.candidate_forms(x, x))
    return forms_of_answers(spark, d).select("pred_id", mt.has_code(F.col("f.plain"), F.lit("en")).alias("token"), F.exists(names, lambda c: mt.single_match(F.col("f"), c)).alias("named"))


@query(f"""
    SELECT pred_id, sum(CASE WHEN regexp_matches(answer, '(?i)(^|[^A-Za-z0-9])' || regexp_escape(code) || '([^A-Za-z0-9]|$)') THEN 1 ELSE 0 END) AS n_codes
    FROM (SELECT p.pred_id, p.answer, s.value AS code, s.role AS role FROM ({PRED}) p JOIN (SELECT id, unnest(field_specs) AS s FROM ({LATEST})) t ON t.id = p.id WHERE p.answer IS NOT NULL)
    WHERE role = 'immutable' AND code <> '' GROUP BY pred_id
""")
def code_token_match(spark: SparkSession, d: str) -> DataFrame:
    """Per prediction, how many of its exact-copy codes stand by themselves in the stored answer, in any case."""
    p = evaluation.normalised_predictions(predictions_of(spark, d)).filter("answer IS NOT NULL")
    t = evaluation.latest_tasks(tasks_of(spark, d)).select("id", F.filter(F.transform(F.filter("field_specs", lambda s: s["role"] == "immutable"), lambda s: s["value"]), lambda v: v != "").alias("codes")).filter(F.size("codes") > 0)
    return p.join(t, "id").select("pred_id", F.size(F.filter("codes", lambda c: mt.has_code(F.col("answer"), c))).cast("bigint").alias("n_codes"))


# --- languages

@query(f"""
    WITH {es.forms('f', ANSWERS)}, j AS (SELECT p.pred_id, p.answer, low, match, loose, t.expected_answer_language AS lang FROM ({PRED}) p JOIN ({LATEST}) t ON t.id = p.id JOIN f ON f.text = p.answer)
    SELECT pred_id, {es.TARGET} AS target, {es.WRONG} AS wrong, {es.MARKER} AS marker FROM j
""")
def language_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Per prediction, whether the script of the expected language is there, whether a wrong one is, and whether its markers are."""
    plain = evaluation.normalised_predictions(predictions_of(spark, d)).filter("answer IS NOT NULL").withColumn("plain", tx.nfkc("answer"))
    lower = plain.withColumn("lower", F.lower(tx.ascii_thai_digits(F.col("plain"))))
    p = lower.withColumn("match", tx.match_form(F.col("lower"))).withColumn("loose", tx.loose_form(F.col("match")))
    t = evaluation.latest_tasks(tasks_of(spark, d)).select("id", F.col("expected_answer_language").alias("lang"))
    x = mt.language_diagnostics(F.col("answer"), F.col("lower"), F.col("match"), F.col("loose"), F.col("lang"))
    return p.join(t, "id").select("pred_id", x.alias("x")).select("pred_id", "x.target", "x.wrong", "x.marker")


@query(f"SELECT pred_id, {es.TARGET} AS target, {es.WRONG} AS wrong, {es.MARKER} AS marker FROM (SELECT pred_id, answer, 'en' AS lang, '' AS low, '' AS match, '' AS loose FROM predictions WHERE answer IS NOT NULL)")
def language_diag_en(spark: SparkSession, d: str) -> DataFrame:
    """Every answer by the rule of English: scripts, and whole words of Latin letters."""
    a = F.col("answer")
    return predictions_of(spark, d).filter(a.isNotNull()).select("pred_id", mt.language_diagnostics(a, a, a, a, F.lit("en")).alias("x")).select("pred_id", "x.target", "x.wrong", "x.marker")


@query(f"SELECT pred_id, len(list_filter({es.listed(KAZAKH_MARKERS)}, lambda m: contains(answer, m))) AS n_kazakh, len(list_filter({es.listed(UYGHUR_MARKERS)}, lambda m: contains(answer, m))) AS n_uyghur FROM predictions WHERE answer IS NOT NULL")
def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct markers of two languages that each answer holds."""
    a = F.col("answer")
    return predictions_of(spark, d).filter(a.isNotNull()).select("pred_id", mt.marker_count(a, KAZAKH_MARKERS).cast("bigint").alias("n_kazakh"), mt.marker_count(a, UYGHUR_MARKERS).cast("bigint").alias("n_uyghur"))


# --- JSON texts

# a JSON text in a JSON text is unwrapped; what is no object then has no members
OUTER_OBJECT = """
    SELECT *, CASE WHEN json_valid(j2) AND json_type(j2) = 'OBJECT' THEN j2 END AS obj FROM (
    SELECT *, CASE WHEN json_valid(j1) AND json_type(j1) = 'VARCHAR' THEN j1 ->> '$' ELSE j1 END AS j2 FROM (
    SELECT *, CASE WHEN json_valid(tool_result) AND json_type(tool_result) = 'VARCHAR' THEN tool_result ->> '$' ELSE tool_result END AS j1 FROM tasks))
"""


@query(rf"""
    WITH o AS ({OUTER_OBJECT}), s AS (SELECT line_no, obj, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM o WHERE obj IS NOT NULL)
    SELECT line_no, i - 1 AS pos, s.path AS path, json_extract_string(obj, '$' || regexp_replace(s.path, '(^|\.)([^.\[\]]+)', '."\2"', 'g')) AS value FROM s WHERE s.path IS NOT NULL
""")
def path_values(spark: SparkSession, d: str) -> DataFrame:
    """What stands at each specified path of the result, as text; null where the path leads nowhere."""
    rows = tasks_of(spark, d).select("line_no", outer_object(F.col("tool_result")).alias("obj"), "field_specs").filter("obj IS NOT NULL").select("line_no", "obj", F.posexplode("field_specs").alias("pos", "s"))
    return rows.filter("s.path IS NOT NULL").select("line_no", F.col("pos").cast("bigint").alias("pos"), F.col("s.path").alias("path"), text_at(F.col("obj"), F.col("s.path")).alias("value"))


@query("""
    SELECT line_no, CASE WHEN NOT json_valid(tool_result) THEN 'invalid JSON' ELSE 'not an object' END AS problem FROM tasks
    WHERE tool_result IS NOT NULL AND (NOT json_valid(tool_result) OR json_type(tool_result) <> 'OBJECT')
""")
def strict_lines(spark: SparkSession, d: str) -> DataFrame:
    """The strict reader's judgement of every result taken as a line: those that hold no JSON or no object."""
    return tasks_of(spark, d).select("line_no", jsonl.line_problem(F.col("tool_result")).alias("problem")).filter("problem IS NOT NULL")
