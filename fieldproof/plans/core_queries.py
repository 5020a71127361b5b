"""Queries over whole operators: evaluation, validation, splits, placeholders, audit and result tables.

Each has independent SQL where SQL can express it. Without are those that need byte-exact JSON or
functions the SQL engine lacks; tests hold them against worked examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldproof.functions.dictionaries import ROLES
from fieldproof.operators import audit, evaluation, results, slots, validation
from fieldproof.plans import evaluation_sql as es
from fieldproof.plans.evaluation_sql import LATEST, PRED
from fieldproof.plans.register import predictions_of, registry, tasks_of
from fieldproof.plans.text_queries import OUTER_OBJECT
from fieldproof.sources.tables import table
from fieldproof.streaming import scoring

QUERIES, SQL, query = registry()


# --- evaluation

def _means() -> list[Column]:
    return [F.round(F.avg(F.col(m).cast("double")), 9).alias(m) for m in evaluation.METRICS]


def _scored(spark: SparkSession, d: str, policy: str = "strict") -> DataFrame:
    return evaluation.evaluate(predictions_of(spark, d), tasks_of(spark, d), policy)


def _reports(rows: DataFrame) -> DataFrame:
    return evaluation.reports(rows).withColumns({m: F.round(m, 9) for m in evaluation.METRICS})


def _flat(rows: DataFrame) -> DataFrame:
    """Rows with rounded metrics and lists as joined texts."""
    return rows.withColumns({m: F.round(m, 9) for m in evaluation.METRICS if m != "core_pass"} | {x: F.array_join(x, " | ") for x in es.LISTS})


@query(es.by_method())
def core_pass_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Strict evaluation, means by method: the flagship."""
    return _scored(spark, d).groupBy("method").agg(F.count("*").alias("n"), *_means())


@query(es.per_sample())
def eval_per_sample(spark: SparkSession, d: str) -> DataFrame:
    """Strict evaluation, one row per prediction."""
    return _flat(_scored(spark, d))


@query(es.per_sample("relaxed"))
def eval_per_sample_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """Relaxed evaluation, one row per prediction."""
    return _flat(_scored(spark, d, "relaxed"))


@query(es.reports())
def eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """The three strict reports."""
    return _reports(_scored(spark, d))


@query(es.reports("relaxed"))
def eval_relaxed_reports(spark: SparkSession, d: str) -> DataFrame:
    """The three relaxed reports."""
    return _reports(_scored(spark, d, "relaxed"))


@query(f"WITH {es.evaluated()} SELECT pred_id, round(field_coverage, 9) AS field_coverage FROM scored")
def field_coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of required fields that each answer covers; 1 where a task has none."""
    return _scored(spark, d).select("pred_id", F.round("field_coverage", 9).alias("field_coverage"))


@query(f"WITH {es.evaluated()}, x AS (SELECT unnest(missing_fields) AS path FROM scored) SELECT path, count(*) AS n FROM x GROUP BY path")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each required field is missing."""
    return _scored(spark, d).select(F.explode("missing_fields").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {es.evaluated()} SELECT pred_id, array_to_string(underlocalized_fields, ' | ') AS fields FROM scored WHERE len(underlocalized_fields) > 0")
def underlocalized_fields(spark: SparkSession, d: str) -> DataFrame:
    """Answers that hold a raw value where the task asks for a localised one."""
    return _scored(spark, d).filter(F.size("underlocalized_fields") > 0).select("pred_id", F.array_join("underlocalized_fields", " | ").alias("fields"))


CORRUPTED = "SELECT method, CAST(sum(len(immutable_corruptions)) AS BIGINT) AS n FROM scored GROUP BY method"


@query(f"SELECT s.method, s.n AS n_strict, r.n AS n_relaxed FROM (WITH {es.evaluated()} {CORRUPTED}) s JOIN (WITH {es.evaluated('relaxed')} {CORRUPTED}) r ON r.method = s.method")
def immutable_strict_vs_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """Corrupted exact-copy fields by method under both policies."""
    count = lambda policy, name: _scored(spark, d, policy).groupBy("method").agg(F.sum(F.size("immutable_corruptions")).alias(name))
    return count("strict", "n_strict").join(count("relaxed", "n_relaxed"), "method")


@query(PRED)
def pred_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with id and method resolved."""
    return evaluation.normalised_predictions(predictions_of(spark, d))


@query(f"SELECT pred_id, CASE WHEN id IS NULL THEN 'no id' ELSE 'no answer' END AS reason FROM ({PRED}) WHERE id IS NULL OR answer IS NULL")
def pred_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that can't be evaluated."""
    return evaluation.rejected(predictions_of(spark, d))


@query(f"SELECT pred_id, id FROM ({PRED}) p WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.id = p.id)")
def unknown_prediction_ids(spark: SparkSession, d: str) -> DataFrame:
    """Predictions whose task isn't there."""
    return evaluation.unknown_ids(predictions_of(spark, d), tasks_of(spark, d))


@query(f"SELECT id, line_no, domain FROM ({LATEST})")
def task_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last delivered line of each id."""
    return evaluation.latest_tasks(tasks_of(spark, d)).select("id", "line_no", "domain")


@query("SELECT id, count(*) AS n FROM tasks WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_task_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids delivered more than once."""
    return evaluation.duplicate_ids(tasks_of(spark, d))


@query("SELECT DISTINCT id, expected_answer_language AS label FROM tasks WHERE expected_answer_language IS NULL OR expected_answer_language NOT IN ('bo','id','ja','kk-Arab','mn-Mong','th','ug','zh','en')")
def unsupported_language_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose expected language has no rule."""
    return evaluation.unsupported_languages(tasks_of(spark, d))


@query(f"""
    SELECT method, count(*) AS n_fields, sum(CASE WHEN raw = '' OR contains(answer, raw) THEN 1 ELSE 0 END) AS n_copied
    FROM (SELECT p.method, p.answer, COALESCE(s.value, '') AS raw, s.role AS role, COALESCE(s.required, TRUE) AS required
          FROM ({PRED}) p JOIN (SELECT id, unnest(field_specs) AS s FROM ({LATEST})) t ON t.id = p.id WHERE p.answer IS NOT NULL)
    WHERE role = 'immutable' AND required GROUP BY method
""")
def immutable_copies(spark: SparkSession, d: str) -> DataFrame:
    """By method, required exact-copy fields and how many of them answers hold literally."""
    p = evaluation.normalised_predictions(predictions_of(spark, d)).filter("answer IS NOT NULL")
    kept = F.transform(F.filter("field_specs", lambda s: (s["role"] == "immutable") & F.coalesce(s["required"], F.lit(True))), lambda s: F.coalesce(s["value"], F.lit("")))
    fields = evaluation.latest_tasks(tasks_of(spark, d)).select("id", kept.alias("raws"))
    counted = p.join(fields, "id").select("method", F.size("raws").alias("n"), F.size(F.filter("raws", lambda r: (r == "") | F.contains(F.col("answer"), r))).alias("ok")).filter("n > 0")
    return counted.groupBy("method").agg(F.sum("n").cast("bigint").alias("n_fields"), F.sum("ok").cast("bigint").alias("n_copied"))


@query(f"""
    SELECT pred_id, count(*) AS n_hits
    FROM (SELECT p.pred_id, p.answer, unnest(list_concat(COALESCE(t.forbidden_hallucinations, []), list_transform(COALESCE(t.field_specs, []), lambda s: upper(s.value)))) AS phrase
          FROM ({PRED}) p JOIN ({LATEST}) t ON t.id = p.id WHERE p.answer IS NOT NULL)
    WHERE phrase IS NOT NULL AND phrase <> '' AND contains(lower(answer), lower(phrase)) GROUP BY pred_id
""")
def forbidden_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many of the phrases of its task an answer holds: those forbidden, and each specified value in capitals as a further phrase."""
    p = evaluation.normalised_predictions(predictions_of(spark, d)).filter("answer IS NOT NULL")
    none = F.array().cast("array<string>")
    phrases = F.concat(F.coalesce("forbidden_hallucinations", none), F.coalesce(F.transform("field_specs", lambda s: F.upper(s["value"])), none))
    t = evaluation.latest_tasks(tasks_of(spark, d)).select("id", phrases.alias("phrases"))
    hits = F.size(evaluation.phrase_hits(F.lower("answer"), F.col("phrases")))
    return p.join(t, "id").select("pred_id", hits.cast("bigint").alias("n_hits")).filter("n_hits > 0")


# --- field specifications

@query("""
    SELECT domain, s.role AS role, count(*) AS n, sum(CASE WHEN COALESCE(s.required, TRUE) THEN 1 ELSE 0 END) AS n_required
    FROM (SELECT domain, unnest(field_specs) AS s FROM tasks) WHERE s IS NOT NULL GROUP BY domain, s.role
""")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    """Specifications by domain and role, and how many are required."""
    s = tasks_of(spark, d).select("domain", F.explode("field_specs").alias("s")).filter("s IS NOT NULL")
    return s.groupBy("domain", F.col("s.role").alias("role")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("s.required", F.lit(True))).alias("n_required"))


@query("""
    WITH f AS (SELECT line_no, unnest(required_fields) AS path FROM tasks), s AS (SELECT line_no, unnest(field_specs).path AS path FROM tasks)
    SELECT line_no, string_agg(path, ',' ORDER BY path) AS uncovered FROM (SELECT line_no, path FROM f WHERE path IS NOT NULL EXCEPT SELECT line_no, path FROM s) GROUP BY line_no
""")
def uncovered_required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Required fields without specification, per line."""
    left = F.array_sort(F.array_except(F.array_compact("required_fields"), F.coalesce(F.transform("field_specs", lambda s: s["path"]), F.array().cast("array<string>"))))
    return tasks_of(spark, d).select("line_no", left.alias("x")).filter(F.size("x") > 0).select("line_no", F.array_join("x", ",").alias("uncovered"))


@query("""
    SELECT line_no, count(DISTINCT v) AS n_values FROM (SELECT line_no, unnest(list_concat(COALESCE(s.accepted_values, []), [s.value])) AS v FROM (SELECT line_no, unnest(field_specs) AS s FROM tasks) WHERE s IS NOT NULL)
    WHERE v IS NOT NULL GROUP BY line_no
""")
def unique_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values and accepted values of each line's specifications."""
    values = F.array_distinct(F.array_compact(F.flatten(F.transform(F.array_compact("field_specs"), lambda s: F.concat(F.coalesce(s["accepted_values"], F.array().cast("array<string>")), F.array(s["value"]))))))
    return tasks_of(spark, d).select("line_no", F.size(values).cast("bigint").alias("n_values")).filter("n_values > 0")


ALL_VALUES = "SELECT line_no, i - 1 AS pos, s.path AS path, s.value AS value, COALESCE(expected_answer_language, user_language) AS lang FROM (SELECT line_no, expected_answer_language, user_language, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM tasks) WHERE s.value IS NOT NULL"


# a JSON text in JSON texts is unwrapped; what is then no object has no members
OBJECT_SQL = """
    SELECT *, CASE WHEN json_valid(j2) AND json_type(j2) = 'OBJECT' THEN j2 END AS obj FROM (
    SELECT *, CASE WHEN json_valid(j1) AND json_type(j1) = 'VARCHAR' THEN j1 ->> '$' ELSE j1 END AS j2 FROM (
    SELECT *, CASE WHEN json_valid(tool_result) AND json_type(tool_result) = 'VARCHAR' THEN tool_result ->> '$' ELSE tool_result END AS j1 FROM tasks))
"""


# --- validation and splits

REQUIRED_SQL = " || ".join(f"CASE WHEN {c} IS NULL THEN ', {c}' ELSE '' END" for c in validation.REQUIRED)


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS nth FROM tasks),
    specs AS (SELECT line_no, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM tasks),
    bad AS (SELECT line_no, arg_min(COALESCE(s.role, 'None'), i) AS role FROM specs WHERE COALESCE(s.role, 'None') NOT IN ({", ".join(f"'{x}'" for x in ROLES)}) GROUP BY line_no),
    unc AS (SELECT line_no, string_agg(path, ', ' ORDER BY path) AS paths FROM (SELECT line_no, unnest(required_fields) AS path FROM tasks EXCEPT SELECT line_no, s.path FROM specs) WHERE path IS NOT NULL GROUP BY line_no)
    SELECT line_no, 1 AS priority, id, 'missing required keys: ' || substr({REQUIRED_SQL}, 3) AS message FROM tasks WHERE ({REQUIRED_SQL}) <> ''
    UNION ALL SELECT line_no, 2, id, 'invalid id' FROM tasks WHERE id = ''
    UNION ALL SELECT line_no, 3, id, 'duplicate id: ' || id FROM r WHERE nth > 1 AND id IS NOT NULL
    UNION ALL SELECT DISTINCT t.line_no, 4, t.id, 'field specification without a path' FROM tasks t JOIN specs USING (line_no) WHERE s.path IS NULL OR s.path = ''
    UNION ALL SELECT t.line_no, 5, t.id, 'unsupported field role: ' || role FROM tasks t JOIN bad USING (line_no)
    UNION ALL SELECT t.line_no, 6, t.id, 'required fields without specs: ' || paths FROM tasks t JOIN unc USING (line_no)
""")
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every failed check of every line."""
    return validation.violations(tasks_of(spark, d))


@query("SELECT count(*) AS rows, count(DISTINCT id) AS unique_ids, count(DISTINCT domain) AS domains, string_agg(DISTINCT user_language, ',' ORDER BY user_language) AS languages FROM tasks")
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Size and variety of the task table."""
    return validation.summary(tasks_of(spark, d))


@query("SELECT split AS condition, count(*) AS n FROM tasks GROUP BY split")
def condition_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows per condition, over the split column."""
    return validation.condition_counts(tasks_of(spark, d), "split")


@query("SELECT line_no, id, source_record_id, CASE WHEN regexp_extract(id, '[^_]*$') IN ('001', '003') THEN 'dev' WHEN regexp_extract(id, '[^_]*$') IN ('002', '004') THEN 'test' END AS split FROM tasks")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    """The split that the suffix of each id names."""
    return validation.suffix_split(tasks_of(spark, d))


@query("SELECT source_record_id, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM tasks WHERE source_record_id IS NOT NULL AND split IS NOT NULL GROUP BY source_record_id HAVING count(DISTINCT split) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Record ids, as stored, that are in more than one split."""
    return validation.split_leaks(tasks_of(spark, d))


@query("""
    SELECT id, 'committed' AS side FROM (SELECT id FROM tasks WHERE split = 'dev' EXCEPT ALL SELECT id FROM tasks WHERE regexp_extract(id, '[^_]*$') IN ('001', '003'))
    UNION ALL SELECT id, 'regenerated' FROM (SELECT id FROM tasks WHERE regexp_extract(id, '[^_]*$') IN ('001', '003') EXCEPT ALL SELECT id FROM tasks WHERE split = 'dev')
""")
def split_verify(spark: SparkSession, d: str) -> DataFrame:
    """Where the stored dev split and the one by suffix differ."""
    tasks = tasks_of(spark, d)
    return validation.split_differences(tasks.filter("split = 'dev'"), validation.suffix_split(tasks).filter("split = 'dev'"))


SUFFIX_SQL = "CASE WHEN regexp_extract(id, '[^_]*$') IN ('001', '003') THEN 'dev' WHEN regexp_extract(id, '[^_]*$') IN ('002', '004') THEN 'test' END"


@query(f"SELECT id, CASE WHEN count(DISTINCT split) = 0 THEN 'in no split' ELSE 'in several splits' END AS problem FROM (SELECT id, COALESCE({SUFFIX_SQL}, split) AS split FROM tasks) GROUP BY id HAVING count(DISTINCT split) <> 1")
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Ids that no split or several splits take, where the suffix decides first and the stored split otherwise."""
    tasks = tasks_of(spark, d)
    return validation.split_problems(validation.suffix_split(tasks).withColumnRenamed("split", "by_suffix").join(tasks.select("line_no", "split"), "line_no").select("id", F.coalesce("by_suffix", "split").alias("split")))


@query("SELECT split, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT domain) AS n_domains, count(DISTINCT user_language) AS n_languages FROM tasks GROUP BY split")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    """What each split holds."""
    return validation.split_balance(tasks_of(spark, d))


FIRST_SQL = "SELECT message FROM ({violations}) ORDER BY line_no, priority LIMIT 1"


def _shape_sql(rows: int, released: bool) -> str:
    languages = "(SELECT string_agg(DISTINCT user_language, ',' ORDER BY user_language) FROM tasks)"
    checks = [f"SELECT 'expected {rows} rows, found ' || count(*) AS problem FROM tasks HAVING count(*) <> {rows}"]
    if released:
        checks += [
            f"SELECT 'unexpected languages: ' || {languages} WHERE {languages} <> '{','.join(validation.TASK_LANGUAGES)}'",
            "SELECT 'expected 32 domains, found ' || count(DISTINCT domain) FROM tasks HAVING count(DISTINCT domain) <> 32",
        ]
    return " UNION ALL ".join([*checks, f"SELECT * FROM ({FIRST_SQL.format(violations=SQL['validate_violations'])})"])


@query(_shape_sql(1024, True))
def validate_main(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the tasks from being a main table of the released size."""
    return validation.main_problems(tasks_of(spark, d))


@query(_shape_sql(448, False) + """
    UNION ALL SELECT 'a row has no condition' FROM tasks WHERE split IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'unexpected condition balance: ' || string_agg(c, ', ' ORDER BY c) FROM (SELECT concat_ws(': ', split, count(*)) AS c FROM tasks GROUP BY split) HAVING count(*) <> 7
""")
def validate_attribution(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the tasks, with their split as condition, from being an attribution table of the released size."""
    return validation.attribution_problems(tasks_of(spark, d), "split")


# --- placeholders and messages

SLOTS_SQL = """
    SELECT line_no, path, '[[FIELD_' || path || ']]' AS placeholder, role FROM (
      SELECT line_no, s.path AS path, arg_min(s.role, i) AS role, bool_or(s.value IS NOT NULL AND s.value <> '' AND s.role IN ('immutable', 'semantic', 'entity')) AS kept, any_value(local) AS local
      FROM (SELECT line_no, COALESCE(localizable_fields, []) AS local, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM tasks) WHERE s.path IS NOT NULL AND s.path <> '' GROUP BY line_no, s.path)
    WHERE kept AND NOT list_contains(local, path)
"""


@query(SLOTS_SQL)
def slot_map(spark: SparkSession, d: str) -> DataFrame:
    """The slots of every line."""
    return tasks_of(spark, d).select("line_no", F.explode(slots.slot_map()).alias("s")).select("line_no", "s.path", "s.placeholder", "s.role")


@query(f"""
    WITH o AS ({OUTER_OBJECT})
    SELECT f.line_no, f.i - 1 AS pos, f.s.path AS path, COALESCE(m.placeholder, f.s.value) AS value,
      CASE WHEN m.placeholder IS NOT NULL AND obj IS NOT NULL AND list_contains(json_keys(obj), f.s.path) THEN m.placeholder END AS in_result
    FROM (SELECT line_no, obj, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM o) f LEFT JOIN ({SLOTS_SQL}) m ON m.line_no = f.line_no AND m.path = f.s.path
""")
def slot_protect(spark: SparkSession, d: str) -> DataFrame:
    """Specifications with placeholders in place of protected values, and the placeholder that their member of the rewritten result has."""
    rows = slots.protect(tasks_of(spark, d)).select("line_no", "tool_result", F.posexplode("field_specs").alias("pos", "s"))
    member = F.call_function("get_json_object", "tool_result", F.concat(F.lit("$['"), F.col("s.path"), F.lit("']")))
    return rows.select("line_no", F.col("pos").cast("bigint").alias("pos"), "s.path", "s.value", F.when(member == slots.placeholder(F.col("s.path")), member).alias("in_result"))


@query(f"""
    WITH o AS ({OUTER_OBJECT}), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS rn FROM o WHERE id IS NOT NULL) WHERE rn = 1),
    v AS (SELECT t.id, m.path, json_type(obj, '$."' || m.path || '"') AS kind, json_extract_string(obj, '$."' || m.path || '"') AS value FROM t JOIN ({SLOTS_SQL}) m USING (line_no)),
    w AS (SELECT id, path, CASE WHEN kind IS NULL THEN '' WHEN kind = 'NULL' THEN 'None' WHEN kind = 'BOOLEAN' THEN upper(value[1]) || value[2:] ELSE value END AS value FROM v)
    SELECT id, string_agg(path || '=' || value, '; ' ORDER BY path) AS answer FROM w GROUP BY id
""")
def slot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """For each task an answer written with the placeholders of its protected form, and restored: every value must be back."""
    tasks = evaluation.latest_tasks(tasks_of(spark, d))
    own = F.array_sort(F.transform("protected_slots", lambda s: F.struct(s["path"].alias("path"), s["placeholder"].alias("placeholder"))))
    written = F.array_join(F.transform(own, lambda s: F.concat(s["path"], F.lit("="), s["placeholder"])), "; ")
    answers = slots.protect(tasks).filter(F.size("protected_slots") > 0).select(F.xxhash64("id").alias("pred_id"), "id", written.alias("answer"))
    return slots.restore_answers(answers, tasks).select("id", "answer")


@query()
def render_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of every task for every method; the prompt of a method is its name here."""
    prompts = spark.createDataFrame([(m, f"Method: {m}") for m in slots.METHODS], "method string, text string")
    return slots.render_messages(evaluation.latest_tasks(tasks_of(spark, d)), prompts)


# --- audit

@query(r"""
    SELECT CAST(doc_id AS VARCHAR) AS label, 'email address ' || e AS reason
    FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))) AS e FROM documents) WHERE e <> 'anonymous@invalid.example'
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'local path' FROM documents WHERE regexp_matches(text, '/(Users|home)/|[A-Za-z]:\\Users\\')
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'private network address' FROM documents WHERE regexp_matches(text, '(^|[^0-9])(10(\.[0-9]{1,3}){3}|192\.168(\.[0-9]{1,3}){2}|172\.(1[6-9]|2[0-9]|3[01])(\.[0-9]{1,3}){2})([^0-9]|$)')
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'credential-like assignment' FROM documents WHERE regexp_matches(text, '(?i)(^|[^\pL\pN_])(api[_-]?key|access[_-]?token|secret|password)\s*[:=]\s*["'']?[A-Za-z0-9][A-Za-z0-9._-]{3,}')
""")
def audit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the documents."""
    return audit.findings(table(spark, d, "documents"), "doc_id", "text")


COMPOSED = "SELECT run_id, concat_ws(' ', lower(method) || '@' || model || '.org', '/home/' || run_id || '/x', 'api_key=' || run_id, 'at 10.0.' || length(model) || '.7', 'to Anonymous@invalid.example') AS text FROM runs"


@query(r"""
    SELECT label, reason FROM (
      SELECT run_id AS label, 'email address ' || e AS reason FROM (SELECT run_id, lower(unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))) AS e FROM (COMPOSED)) WHERE e <> 'anonymous@invalid.example'
      UNION ALL SELECT run_id, unnest(['local path', 'credential-like assignment', 'private network address']) FROM (COMPOSED) WHERE contains(text, '/home/') AND contains(text, 'api_key=') AND contains(text, ' 10.0.'))
""".replace("COMPOSED", COMPOSED))
def audit_composed(spark: SparkSession, d: str) -> DataFrame:
    """Findings in texts made of the runs so that each holds an address, a path, a key, a network address and a neutral address."""
    parts = [F.concat(F.lower("method"), F.lit("@"), F.col("model"), F.lit(".org")), F.concat(F.lit("/home/"), F.col("run_id"), F.lit("/x")), F.concat(F.lit("api_key="), F.col("run_id"))]
    text = F.concat_ws(" ", *parts, F.concat(F.lit("at 10.0."), F.length("model"), F.lit(".7")), F.lit("to Anonymous@invalid.example"))
    return audit.findings(table(spark, d, "runs").select("run_id", text.alias("text")), "run_id", "text")


# --- result tables

@query("""
    SELECT method, round(sum(core_pass * core_n) / sum(CASE WHEN core_pass IS NOT NULL THEN core_n END), 10) AS corepass, sum(core_n) AS core_n,
      round(sum(hybrid_faithfulness * gemini_n) / sum(CASE WHEN hybrid_faithfulness IS NOT NULL THEN gemini_n END), 10) AS hybrid, sum(gemini_n) AS hybrid_n,
      round(sum(naturalness * naturalness_n) / sum(CASE WHEN naturalness IS NOT NULL THEN naturalness_n END), 10) AS naturalness, sum(naturalness_n) AS naturalness_n
    FROM model_results GROUP BY method
""")
def weighted_summary(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means per method."""
    s = results.method_summary(table(spark, d, "model_results"))
    return s.withColumns({c: F.round(c, 10) for c in ("corepass", "hybrid", "naturalness")})


def _headline_sql() -> str:
    def mean(value: str, weight: str, method: str) -> str:
        return f"(SELECT sum({value} * {weight}) / sum({weight}) FROM model_results WHERE method = '{method}' AND {value} IS NOT NULL AND {weight} IS NOT NULL)"

    parts = []
    for name, value, weight, factor, suffix in (("corepass", "core_pass", "core_n", 100, "_delta_pp"), ("hybrid", "hybrid_faithfulness", "gemini_n", 100, "_delta_pp"), ("naturalness", "naturalness", "naturalness_n", 1, "_delta")):
        a, b = mean(value, weight, results.BASELINE), mean(value, weight, results.COMPARISON)
        parts += [f"SELECT '{name}_elv' AS name, round({a}, 9) AS value", f"SELECT '{name}_protected', round({b}, 9)", f"SELECT '{name}{suffix}', round({factor} * ({b} - {a}), 9)"]
    return " UNION ALL ".join(parts)


@query(_headline_sql())
def headline_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Two methods' means and their differences."""
    return results.headline(table(spark, d, "model_results")).withColumn("value", F.round("value", 9))


@query("""
    WITH z AS (SELECT 1.959963984540054 AS z), r AS (SELECT model, method, core_pass AS p, CAST(NULLIF(core_n, 0) AS DOUBLE) AS n FROM model_results)
    SELECT model, method, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low,
      round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM r, z
""")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    """Score intervals of the core rate."""
    low, high = results.wilson(F.col("core_pass"), F.col("core_n"))
    return table(spark, d, "model_results").select("model", "method", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"SELECT name, round(value, 2) AS expected, abs(value - round(value, 2)) <= 0.002 AS agrees FROM ({_headline_sql()})")
def tolerance_check(spark: SparkSession, d: str) -> DataFrame:
    """Which headline values are within 0.002 of what two decimals say."""
    computed = results.headline(table(spark, d, "model_results")).withColumn("value", F.round("value", 9))
    return results.compare(computed.select("name", F.round("value", 2).alias("value")), computed, 0.002).select("name", "expected", "agrees")


def _signs_sql() -> str:
    parts = [
        f"SELECT '{m}' AS metric, max(CASE WHEN method = '{results.COMPARISON}' THEN {m} END) - max(CASE WHEN method = '{results.BASELINE}' THEN {m} END) AS d FROM model_results GROUP BY model"
        for m in ("core_pass", "hybrid_faithfulness", "naturalness")
    ]
    return f"""
    WITH d AS ({" UNION ALL ".join(parts)}), s AS (SELECT metric, count(*) FILTER (WHERE d > 0) AS positive, count(*) FILTER (WHERE d < 0) AS negative, count(*) FILTER (WHERE d = 0) AS tied FROM d WHERE d IS NOT NULL GROUP BY metric),
    p AS (SELECT *, least(1.0, 2.0 * list_sum(list_transform(range(0, least(positive, negative) + 1), lambda i: factorial(CAST(positive + negative AS INT)) / factorial(CAST(i AS INT)) / factorial(CAST(positive + negative - i AS INT)))) / 2.0 ** (positive + negative)) AS p_value FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY p_value, metric) AS rk, count(*) OVER () AS m FROM p)
    SELECT a.metric, a.positive, a.negative, a.tied, round(a.p_value, 9) AS p_value, round(max(least(1, b.p_value * (b.m - b.rk + 1))), 9) AS p_holm FROM r a JOIN r b ON b.rk <= a.rk GROUP BY a.metric, a.positive, a.negative, a.tied, a.p_value
    """


@query(_signs_sql())
def sign_tests(spark: SparkSession, d: str) -> DataFrame:
    """Exact sign tests over models, Holm-adjusted over the metrics."""
    r = table(spark, d, "model_results")
    parts = [results.model_signs(r, m) for m in ("core_pass", "hybrid_faithfulness", "naturalness")]
    tested = results.holm(parts[0].unionByName(parts[1]).unionByName(parts[2]), "p_value", [])
    return tested.withColumns({"p_value": F.round("p_value", 9), "p_holm": F.round("p_holm", 9)})


DELTA = "round(max(CASE WHEN method = '{b}' THEN {c} END) - max(CASE WHEN method = '{a}' THEN {c} END), 9) AS delta_{c}"


@query("SELECT model, " + ", ".join(DELTA.format(a=results.BASELINE, b=results.COMPARISON, c=c) for c in ("core_pass", "hybrid_faithfulness", "naturalness")) + " FROM model_results GROUP BY model")
def model_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What one method has over the other, by model; the operator takes a language column alike."""
    out = results.paired_deltas(table(spark, d, "model_results"), "model", ["core_pass", "hybrid_faithfulness", "naturalness"])
    return out.select("model", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("""
    SELECT model, round(sum(core_pass * core_n) / sum(CASE WHEN core_pass IS NOT NULL THEN core_n END), 9) AS corepass, sum(core_n) AS core_n,
      round(sum(hybrid_faithfulness * gemini_n) / sum(CASE WHEN hybrid_faithfulness IS NOT NULL THEN gemini_n END), 9) AS hybrid, sum(gemini_n) AS hybrid_n,
      round(sum(naturalness * naturalness_n) / sum(CASE WHEN naturalness IS NOT NULL THEN naturalness_n END), 9) AS naturalness, sum(naturalness_n) AS naturalness_n
    FROM model_results GROUP BY model
""")
def pooled_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means by model, pooled over methods."""
    return results.pooled(table(spark, d, "model_results"), "model").withColumns({c: F.round(c, 9) for c in ("corepass", "hybrid", "naturalness")})


@query(f"""
    WITH w AS ({SQL["wilson_interval"]}), a AS (SELECT * FROM w WHERE method = '{results.COMPARISON}'), b AS (SELECT * FROM w WHERE method = '{results.BASELINE}')
    SELECT a.model, round(a.low - b.high, 6) AS low, round(a.high - b.low, 6) AS high FROM a JOIN b ON a.model = b.model
""")
def delta_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference of the core rates of two methods, by model."""
    r = table(spark, d, "model_results")
    side = lambda method, p: r.filter(F.col("method") == method).select("model", F.col("core_pass").alias(f"{p}_rate"), F.col("core_n").alias(f"{p}_n"))
    low, high = results.delta_interval(F.col("a_rate"), F.col("a_n"), F.col("b_rate"), F.col("b_n"))
    return side(results.COMPARISON, "a").join(side(results.BASELINE, "b"), "model").select("model", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""
    WITH v AS (SELECT id, bool_or(answer IS NOT NULL AND length(answer) > 100) FILTER (WHERE method = '{results.COMPARISON}') AS a, bool_or(answer IS NOT NULL AND length(answer) > 100) FILTER (WHERE method = '{results.BASELINE}') AS b FROM ({PRED}) GROUP BY id),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE b AND NOT a) AS y FROM v WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT n, x AS comparison_only, y AS baseline_only, round((x - y) / n, 9) AS delta,
      round(least(1.0, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))))), 6) AS p_value FROM c
""")
def mcnemar_long_answers(spark: SparkSession, d: str) -> DataFrame:
    """Exact test, over tasks answered by both methods, of which of them has an answer of over 100 characters."""
    p = evaluation.normalised_predictions(predictions_of(spark, d))
    long = F.col("answer").isNotNull() & (F.length("answer") > 100)
    by = p.groupBy("id").agg(*[F.max(F.when(F.col("method") == m, long)).alias(n) for m, n in ((results.COMPARISON, "a"), (results.BASELINE, "b"))])
    out = results.mcnemar(by, "a", "b")
    return out.withColumns({"delta": F.round("delta", 9), "p_value": F.round("p_value", 6)})


@query("""
    SELECT a.method, round(sum(b.core_pass * b.core_n) / sum(CASE WHEN b.core_pass IS NOT NULL THEN b.core_n END), 9) AS core_pass, count(*) AS n_runs
    FROM runs a LEFT JOIN model_results b ON a.model = b.model AND a.method = b.method GROUP BY a.method
""")
def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the published rate of their model and method."""
    joined = table(spark, d, "runs").join(table(spark, d, "model_results").select("model", "method", "core_pass", "core_n"), ["model", "method"], "left")
    return joined.groupBy("method").agg(F.round(results.weighted_mean("core_pass", "core_n"), 9).alias("core_pass"), F.count("*").alias("n_runs"))


@query("SELECT s.provider, d.domain, count(t.line_no) AS n_tasks FROM tool_sources s, unnest(s.tool_domains) AS d(domain) LEFT JOIN tasks t ON t.domain = d.domain GROUP BY s.provider, d.domain")
def source_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Tasks per provider and domain of the inventory."""
    listed = table(spark, d, "tool_sources").select("provider", F.explode("tool_domains").alias("domain"))
    counts = tasks_of(spark, d).groupBy("domain").agg(F.count("*").alias("n"))
    return listed.join(counts, "domain", "left").groupBy("provider", "domain").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tasks"))


@query("""
    SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, COALESCE(method, 'unknown') AS method, count(*) AS n, count(*) FILTER (WHERE answer IS NULL OR trim(answer, ' ') = '') AS n_empty
    FROM predictions WHERE created_at IS NOT NULL GROUP BY 1, 2
""")
def arrivals_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The windowed aggregate of the stream, over the whole table."""
    return scoring.arrivals(predictions_of(spark, d)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "method", "n", "n_empty")
