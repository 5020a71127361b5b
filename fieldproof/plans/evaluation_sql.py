"""The evaluation restated in SQL that shares nothing with the operators but the fixed values.

The SQL engine has no look-around, so every run of digits is put between two marks first: a run
that is whole is then one that has both. It has no compatibility normalisation either; that is
restated as a translation of characters one for one (by rule, from the character database), a few
that become several, and canonical composition.
"""

from __future__ import annotations

import unicodedata

from fieldproof.functions.dictionaries import (
    BUDDHIST_FROM, BUDDHIST_OFFSET, COUNTRY_CODES, COUNTRY_PATHS, CURRENCY_CODES, CURRENCY_PATH, ENGLISH_LEAST_WORDS, INDONESIAN_MARKERS, KAZAKH_LEAST, KAZAKH_MARKERS,
    LANGUAGE_CODES, LANGUAGE_PATH, MONTHS, OTHER_DIGITS, PATH_ALIASES, THAI_DIGITS, UYGHUR_MARKERS, VALUE_ALIASES,
)

PRED = "SELECT pred_id, COALESCE(NULLIF(id, ''), NULLIF(sample_id, '')) AS id, COALESCE(method, 'unknown') AS method, answer FROM predictions"
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS rn FROM tasks WHERE id IS NOT NULL) WHERE rn = 1"

OPEN, CLOSE, THREE = "\ue000", "\ue001", "\ue002"  # before and after a run of digits, and before one of three
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SCRIPT_CLASSES = {
    "han": r"[\x{4e00}-\x{9fff}]", "kana": r"[\x{3040}-\x{30ff}]", "thai": r"[\x{0e00}-\x{0e7f}]", "tibetan": r"[\x{0f00}-\x{0fff}]",
    "arabic": r"[\x{0600}-\x{06ff}]", "mongolian": r"[\x{1800}-\x{18af}]", "cyrillic": r"[\x{0400}-\x{052f}]",
}
SIX = ("han", "kana", "thai", "tibetan", "arabic", "mongolian")


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def listed(texts: list[str]) -> str:
    """Texts as an SQL list."""
    return "[" + ", ".join(map(quoted, texts)) + "]"


def has(*names: str) -> str:
    """Whether the answer has a character of one of the scripts."""
    return "(" + " OR ".join(f"regexp_matches(answer, '{SCRIPT_CLASSES[n]}')" for n in names) + ")"


def compatible(text: str) -> str:
    """The compatibility-composed form, for characters of the basic plane that become one, and the expansions below."""
    single = {chr(c): n for c in range(0xA0, 0xFFFF) if not 0xAC00 <= c <= 0xDFFF and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)}
    # Characters that become several and occur in texts.
    for c in "…ำຳﬀﬁﬂﬃﬄ½¼¾℃™№":
        text = f"replace({text}, {quoted(c)}, {quoted(unicodedata.normalize('NFKC', c))})"
    return f"nfc_normalize(translate({text}, {quoted(''.join(single))}, {quoted(''.join(single.values()))}))"


def no_thousands(text: str) -> str:
    """Without separators before groups of three digits."""
    runs = rf"regexp_replace({text}, '(\p{{Nd}}+)', '{OPEN}\1{CLOSE}', 'g')"
    three = rf"regexp_replace({runs}, '{OPEN}(\p{{Nd}}\p{{Nd}}\p{{Nd}}{CLOSE})', '{THREE}\1', 'g')"
    joined = f"replace(replace({three}, '{CLOSE},{THREE}', ''), '{CLOSE}.{THREE}', '')"
    return f"regexp_replace({joined}, '[{OPEN}{CLOSE}{THREE}]', '', 'g')"


def _date(year: str, month: str, day: str) -> str:
    return f"CASE WHEN {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', CASE WHEN {year} >= {BUDDHIST_FROM} THEN {year} - {BUDDHIST_OFFSET} ELSE {year} END, {month}, {day}) END"


def _all(pattern: str, build) -> str:
    """The list of what `build` makes of every match in `runs`; build gets a function from a group's number to its text."""
    return f"list_filter(list_transform(regexp_extract_all(runs, {quoted(pattern)}, 0), lambda m: {build(lambda i: f'regexp_extract(m, {quoted(pattern)}, {i})')}), lambda d: d IS NOT NULL)"


def _run(pattern: str) -> str:
    """A pattern in which N(...) is a whole run of digits."""
    return pattern.replace("<", OPEN).replace(">", CLOSE)


MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
MONTH_MAP = "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in MONTHS.items()) + "}"
YMD = _run(r"<(\d{4})>\s*[-/.年]\s*<(\d{1,2})>\s*[-/.月]\s*<(\d{1,2})")
DMY = _run(r"<(\d{1,2})>\s*[/-]\s*<(\d{1,2})>\s*[/-]\s*<(\d{4})>")
D_MONTH_Y = _run(rf"<(\d{{1,2}})>(?:st|nd|rd|th)?\s+({MONTH})\.?\s+<(\d{{4}})>")
MONTH_D_Y = _run(rf"({MONTH})\.?\s+<(\d{{1,2}})>(?:st|nd|rd|th)?,?\s+<(\d{{4}})>")
STAMP = _run(r"<(\d{4})>[-/]<(\d{1,2})>[-/]<(\d{1,2})>(?:t|\s+| เวลา | pukul )<(\d{1,2})>:<(\d{2})(?:>:<(\d{2}))?")
CLOCK = _run(r"<(\d{1,2})>:<(\d{2})>(?::<(\d{2})>)?")


def _whole(text: str) -> str:
    return f"CAST({text} AS INTEGER)"


def _time(g, i: int) -> str:
    return f"printf('%02d:%02d:%02dZ', {_whole(g(i))}, {_whole(g(i + 1))}, COALESCE(TRY_CAST(NULLIF({g(i + 2)}, '') AS INTEGER), 0))"


NUMERIC_DATES = f"list_concat({_all(YMD, lambda g: _date(_whole(g(1)), _whole(g(2)), _whole(g(3))))}, {_all(DMY, lambda g: _date(_whole(g(3)), _whole(g(2)), _whole(g(1))))})"
NAMED_DATES = f"list_concat({_all(D_MONTH_Y, lambda g: _date(_whole(g(3)), f'{MONTH_MAP}[{g(2)}]', _whole(g(1))))}, {_all(MONTH_D_Y, lambda g: _date(_whole(g(3)), f'{MONTH_MAP}[{g(1)}]', _whole(g(2))))})"
STAMPS = _all(STAMP, lambda g: f"({_date(_whole(g(1)), _whole(g(2)), _whole(g(3)))}) || 'T' || {_time(g, 4)}")
CLOCKS = _all(CLOCK, lambda g: _time(g, 1))
PARTS = rf"list_filter(list_transform(string_split_regex(text, '(?i)\s*(?:,|，|、|;|；|\band\b|和|及|以及)\s*'), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '')"


def forms(name: str, source: str) -> str:
    """CTEs that end in `name`: the forms of each text of `source`, a query with a column text."""
    digits = "0123456789"
    other = "translate(low, " + quoted(OTHER_DIGITS) + ", '" + digits * (len(OTHER_DIGITS) // 10) + "')"
    return f"""
    {name}1 AS (SELECT text, translate({compatible("text")}, '{THAI_DIGITS}', '{digits}') AS plain FROM ({source})),
    {name}2 AS (SELECT *, lower(plain) AS low FROM {name}1),
    {name}3 AS (SELECT *, {no_thousands(f"replace(regexp_replace(low, '{BLANK}+', '', 'g'), '／', '/')")} AS match, regexp_extract_all({no_thousands("low")}, '\\p{{Nd}}+') AS numbers,
        regexp_replace({other}, '([0-9]+)', '{OPEN}\\1{CLOSE}', 'g') AS runs FROM {name}2),
    {name}4 AS (SELECT *, regexp_replace(match, '[\\s,，、;；:：.!?。．、"''`“”‘’()\\[\\]{{}}<>|/\\\\\\-]+', '', 'g') AS loose,
        list_distinct({NUMERIC_DATES}) AS numeric_dates, list_distinct({NAMED_DATES}) AS named_dates, {STAMPS} AS own_stamps, {CLOCKS} AS clocks FROM {name}3),
    {name}5 AS (SELECT *, list_distinct(list_concat(numeric_dates, named_dates)) AS dates FROM {name}4),
    {name} AS (SELECT text, lower(text) AS raw_lower, plain, low, match, loose, numbers, numeric_dates, named_dates, dates,
        list_distinct(list_concat(own_stamps, flatten(list_transform(dates, lambda d: list_transform(clocks, lambda c: d || 'T' || c))))) AS stamps,
        regexp_matches(plain, '\\pL') AS letter, regexp_full_match(match, '\\p{{Nd}}+') AS number, CASE WHEN len(dates) = 0 AND len({PARTS}) >= 2 THEN {PARTS} ELSE [] END AS parts FROM {name}5)"""


def matches(a: str, c: str) -> str:
    """Whether the candidate with the forms `c` is in the answer with the forms `a`."""
    return (
        f"({c}.text = '' OR list_has_any({c}.stamps, {a}.stamps) OR list_has_any({c}.dates, {a}.dates) OR CASE WHEN {c}.number THEN list_contains({a}.numbers, {c}.match) "
        f"ELSE contains({a}.low, {c}.raw_lower) OR contains({a}.match, {c}.match) OR ({c}.letter AND length({c}.loose) >= 3 AND contains({a}.loose, {c}.loose)) END)"
    )


def aliases(value: str, language: str, path: str) -> str:
    """What a value may be called in a language, as a list."""
    by_value: dict[str, str] = {}
    for (v, lang), names in VALUE_ALIASES.items():
        by_value[v] = by_value.get(v, "") + f" WHEN {quoted(lang)} THEN {listed(names)}"
    of = {v: f"CASE {language}{cases} ELSE [] END" for v, cases in by_value.items()}
    own = f"CASE lower({value})" + "".join(f" WHEN {quoted(v)} THEN {x}" for v, x in of.items()) + " ELSE [] END"
    other = "CASE" + "".join(f" WHEN lower({value}) = {quoted(v)} AND {path} = {quoted(at)} THEN {of[o]}" for (v, at), o in PATH_ALIASES.items()) + " ELSE [] END"
    return f"list_concat({own}, {other})"


def codes(path: str, value: str) -> str:
    """What a code may be called at the paths whose codes may be localised, as a list."""
    def table(key: str, of: dict[str, list[str]]) -> str:
        return f"CASE {key}" + "".join(f" WHEN {quoted(k)} THEN {listed(names)}" for k, names in of.items()) + " ELSE [] END"

    return f"CASE WHEN {path} IN ({', '.join(map(quoted, COUNTRY_PATHS))}) THEN {table(f'upper({value})', COUNTRY_CODES)} WHEN {path} = '{CURRENCY_PATH}' THEN {table(f'lower({value})', CURRENCY_CODES)} WHEN {path} = '{LANGUAGE_PATH}' THEN {table(f'lower({value})', LANGUAGE_CODES)} ELSE [] END"


WORDS = r"len(list_filter(regexp_extract_all(answer, '[\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{2,}')))"
TARGET = f"""CASE lang WHEN 'en' THEN {WORDS} > 0 AND NOT {has(*SIX)} WHEN 'zh' THEN {has("han")} WHEN 'ja' THEN {has("kana")} WHEN 'th' THEN {has("thai")} WHEN 'bo' THEN {has("tibetan")}
    WHEN 'ug' THEN {has("arabic")} WHEN 'kk-Arab' THEN {has("arabic")} WHEN 'mn-Mong' THEN {has("mongolian")} WHEN 'id' THEN NOT {has(*SIX)} ELSE FALSE END"""
WRONG = f"""CASE lang WHEN 'en' THEN {has(*SIX)} WHEN 'zh' THEN {has("kana")} WHEN 'id' THEN {has(*SIX)} WHEN 'mn-Mong' THEN {has("arabic", "han", "cyrillic", "kana", "thai", "tibetan")}
    WHEN 'kk-Arab' THEN {has("han", "cyrillic", "kana", "mongolian", "thai", "tibetan")} ELSE FALSE END"""
MARKER = f"""CASE WHEN lang = 'en' THEN {WORDS} >= {ENGLISH_LEAST_WORDS} WHEN lang IN ('zh', 'ja', 'th', 'bo', 'mn-Mong') THEN TRUE
    WHEN lang = 'ug' THEN len(list_filter({listed(UYGHUR_MARKERS)}, lambda m: contains(answer, m))) > 0
    WHEN lang = 'kk-Arab' THEN len(list_filter({listed(KAZAKH_MARKERS)}, lambda m: contains(answer, m))) >= {KAZAKH_LEAST}
    WHEN lang = 'id' THEN len(list_filter({listed(INDONESIAN_MARKERS)}, lambda m: contains(low, m) OR contains(match, m) OR contains(loose, m))) > 0 ELSE FALSE END"""

METRICS = (
    "language_accuracy target_script_present wrong_script_free language_marker_present field_coverage immutable_preservation entity_fidelity semantic_fidelity "
    "localization_quality hallucination_free faithful_localization_score core_pass"
).split()
LISTS = "missing_fields immutable_corruptions entity_mismatches semantic_mismatches underlocalized_fields forbidden_hits".split()


def evaluated(policy: str = "strict") -> str:
    """CTEs that end in `scored`: a row per prediction with a task and an answer, with its metrics and lists of fields."""
    def passed(kind: str, verdict: str, of: str) -> str:
        return f"list(path ORDER BY rank, i) FILTER (WHERE {of}) AS {kind}_all, list(path ORDER BY rank, i) FILTER (WHERE {of} AND {verdict}) AS {kind}_ok"

    def ratio(kind: str) -> str:
        return f"CASE WHEN COALESCE(len({kind}_all), 0) = 0 THEN 1.0 ELSE COALESCE(len({kind}_ok), 0) / CAST(len({kind}_all) AS DOUBLE) END"

    def missing(kind: str) -> str:
        return f"list_filter(COALESCE({kind}_all, []), lambda p: NOT list_contains(COALESCE({kind}_ok, []), p))"

    token = "(raw = '' OR regexp_matches(a.plain, '(?i)(^|[^A-Za-z0-9])' || regexp_escape(r.plain) || '([^A-Za-z0-9]|$)'))"
    coded = f"(code AND ({token} OR COALESCE(code_met, FALSE)))" if policy == "relaxed" else "FALSE"
    return f"""
    pred AS (SELECT * FROM ({PRED}) WHERE id IS NOT NULL AND answer IS NOT NULL),
    latest AS ({LATEST}),
    spec0 AS (SELECT id, COALESCE(expected_answer_language, user_language) AS named, expected_answer_language AS lang, unnest(field_specs) AS s, generate_subscripts(field_specs, 1) AS i FROM latest),
    spec AS (SELECT id, lang, i, s.path AS path, s.role AS role, COALESCE(s.requires_localization, FALSE) AS localize, COALESCE(s.value, '') AS raw, {codes("s.path", "COALESCE(s.value, '')")} AS codes,
        list_concat(list_transform(COALESCE(s.accepted_values, []), lambda v: COALESCE(v, 'None')), [COALESCE(s.value, 'None')], {aliases("COALESCE(s.value, 'None')", "named", "s.path")}) AS texts
        FROM spec0 WHERE s IS NOT NULL AND COALESCE(s.required, TRUE)),
    candidate AS (SELECT DISTINCT id, i, unnest(texts) AS text, FALSE AS code FROM spec UNION SELECT id, i, unnest(codes), TRUE FROM spec),
    whole_text AS (SELECT DISTINCT text FROM candidate UNION SELECT raw FROM spec),
    {forms("listing", "SELECT text FROM whole_text")},
    {forms("part", "SELECT DISTINCT unnest(parts) AS text FROM listing")},
    {forms("said", "SELECT DISTINCT answer AS text FROM pred")},
    met AS (SELECT p.pred_id, c.i, c.code, c.text, {matches("a", "f")} OR (len(f.parts) > 0 AND (SELECT bool_and({matches("a", "q")}) FROM part q WHERE list_contains(f.parts, q.text))) AS met
        FROM pred p JOIN candidate c ON c.id = p.id JOIN said a ON a.text = p.answer JOIN listing f ON f.text = c.text),
    per AS (SELECT m.pred_id, m.i, bool_or(met) FILTER (WHERE NOT code) AS spec_met, bool_or(met) FILTER (WHERE code) AS code_met, max(code) AS code,
        COALESCE(bool_or(met) FILTER (WHERE NOT code AND lower(m.text) <> lower(s.raw)), FALSE) AS other_met
        FROM met m JOIN pred p ON p.pred_id = m.pred_id JOIN spec s ON s.id = p.id AND s.i = m.i GROUP BY m.pred_id, m.i),
    seen AS (SELECT p.pred_id, s.i, s.path, s.role, CASE WHEN s.role = 'status' THEN 1 ELSE 0 END AS rank, spec_met OR {coded} AS present, raw = '' OR contains(p.answer, raw) OR {coded} AS copied,
        localize AND COALESCE(lang <> 'en', TRUE) AND regexp_matches(lower(raw), '\\pL') AND contains(a.low, lower(raw)) AND NOT other_met AS under
        FROM per JOIN pred p USING (pred_id) JOIN spec s ON s.id = p.id AND s.i = per.i JOIN said a ON a.text = p.answer JOIN listing r ON r.text = s.raw),
    fields AS (SELECT pred_id, list(path ORDER BY i) AS every_all, list(path ORDER BY i) FILTER (WHERE present) AS every_ok, {passed("immutable", "copied", "role = 'immutable'")},
        {passed("entity", "present", "role = 'entity'")}, {passed("semantic", "present", "role IN ('semantic', 'status')")}, list(path ORDER BY i) FILTER (WHERE under) AS under FROM seen GROUP BY pred_id),
    shown AS (SELECT p.pred_id, p.id, p.method, p.answer, t.user_language AS language, t.domain, t.expected_answer_language AS lang, a.low, a.match, a.loose,
        list_filter(COALESCE(t.forbidden_hallucinations, []), lambda x: x IS NOT NULL AND x <> '' AND contains(lower(p.answer), lower(x))) AS hits
        FROM pred p JOIN latest t ON t.id = p.id JOIN said a ON a.text = p.answer),
    judged AS (SELECT *, {TARGET} AS target, {WRONG} AS wrong, {MARKER} AS marker FROM shown),
    rated AS (SELECT j.pred_id, id, method, language, domain, CAST(target AND marker AND NOT wrong AS DOUBLE) AS language_accuracy, CAST(target AS DOUBLE) AS target_script_present, CAST(NOT wrong AS DOUBLE) AS wrong_script_free,
        CAST(marker AS DOUBLE) AS language_marker_present, {ratio("every")} AS field_coverage, {ratio("immutable")} AS immutable_preservation, {ratio("entity")} AS entity_fidelity, {ratio("semantic")} AS semantic_fidelity,
        CAST(COALESCE(len(under), 0) = 0 AS DOUBLE) AS localization_quality, CAST(len(hits) = 0 AS DOUBLE) AS hallucination_free,
        {missing("every")} AS missing_fields, {missing("immutable")} AS immutable_corruptions, {missing("entity")} AS entity_mismatches, {missing("semantic")} AS semantic_mismatches, COALESCE(under, []) AS underlocalized_fields, hits AS forbidden_hits
        FROM judged j LEFT JOIN fields f ON f.pred_id = j.pred_id),
    scored AS (SELECT *, (language_accuracy + field_coverage + immutable_preservation + entity_fidelity + semantic_fidelity + localization_quality + hallucination_free) / 7 AS faithful_localization_score,
        least(language_accuracy, field_coverage, immutable_preservation, entity_fidelity, semantic_fidelity, localization_quality, hallucination_free) = 1 AS core_pass FROM rated)"""


MEANS = ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 9) AS {m}" for m in METRICS)


def by_method(policy: str = "strict") -> str:
    """Means by method."""
    return f"WITH {evaluated(policy)} SELECT method, count(*) AS n, {MEANS} FROM scored GROUP BY method"


def per_sample(policy: str = "strict") -> str:
    """A row per prediction; lists are joined."""
    lists = ", ".join(f"array_to_string({x}, ' | ') AS {x}" for x in LISTS)
    return f"WITH {evaluated(policy)} SELECT pred_id, id, method, '{policy}' AS evaluation_policy, language, domain, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS if m != 'core_pass')}, core_pass, {lists} FROM scored"


def reports(policy: str = "strict") -> str:
    """The three reports, one after the other."""
    parts = [("overall", "method", "NULL", "NULL"), ("by_language", "method, language", "language", "NULL"), ("by_domain", "method, domain", "NULL", "domain")]
    return f"WITH {evaluated(policy)} " + " UNION ALL ".join(f"SELECT '{name}' AS report, method, {lang} AS language, {dom} AS domain, count(*) AS n, {MEANS} FROM scored GROUP BY {keys}" for name, keys, lang, dom in parts)


def answers(select: str) -> str:
    """A selection from answers with their forms."""
    return f"WITH {forms('f', 'SELECT DISTINCT answer AS text FROM predictions WHERE answer IS NOT NULL')} SELECT pred_id, {select} FROM predictions p JOIN f ON f.text = p.answer"
