"""Whether an answer expresses a value: predicates over precomputed text forms.

The forms of candidates are made once per task and those of an answer once per answer; the
predicates run inside array functions of one row, so no shuffle and no global containment join
is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldproof.functions import text as tx
from fieldproof.functions.dictionaries import (
    ARABIC, COUNTRY_CODES, COUNTRY_PATHS, CURRENCY_CODES, CURRENCY_PATH, CYRILLIC, ENGLISH_LEAST_WORDS, HAN, INDONESIAN_MARKERS, KANA, KAZAKH_LEAST,
    KAZAKH_MARKERS, LANGUAGE_CODES, LANGUAGE_PATH, MONGOLIAN, PATH_ALIASES, THAI, TIBETAN, UYGHUR_MARKERS, VALUE_ALIASES,
)

def none() -> Column:
    """An empty array of texts."""
    return tx.texts_none()


def texts(values: list[str]) -> Column:
    """An array of literals."""
    return F.expr(tx.sql_texts(values))


def candidate_forms(raw: Column, plain: Column) -> Column:
    """The forms of one candidate from its text and its normalised text (Thai digits as ASCII)."""
    def forms(lower: Column, match: Column, digits: Column, dates: Column) -> Column:
        return F.struct(
            raw.alias("text"), F.lower(raw).alias("lower"), match.alias("match"), tx.loose_form(match).alias("loose"), plain.rlike(r"\p{L}").alias("letter"),
            match.rlike(r"^(?U)\d+$").alias("number"), dates.alias("dates"), tx.datetimes(digits, dates).alias("stamps"),
        )

    return _with_forms(plain, forms)


def answer_forms(raw: Column, plain: Column) -> Column:
    """The forms of an answer from its text and its normalised text (Thai digits as ASCII)."""
    def forms(lower: Column, match: Column, digits: Column, dates: Column) -> Column:
        return F.struct(
            raw.alias("text"), F.lower(raw).alias("raw_lower"), lower.alias("lower"), plain.alias("plain"), match.alias("match"), tx.loose_form(match).alias("loose"),
            F.regexp_extract_all(tx.no_thousands(lower), F.lit(r"(?U)\d+"), F.lit(0)).alias("numbers"), dates.alias("dates"), tx.datetimes(digits, dates).alias("stamps"),
        )

    return _with_forms(plain, forms)


def _with_forms(plain: Column, build) -> Column:
    """build(lower, match form, lower with ASCII digits, dates) of a normalised text, each computed once."""
    return tx.bound(
        F.lower(plain), lambda lower: tx.bound(tx.match_form(lower), lambda match: tx.bound(tx.ascii_digits(lower), lambda digits: tx.bound(tx.dates(digits), lambda dates: build(lower, match, digits, dates))))
    )


def single_match(a: Column, c: Column) -> Column:
    """One candidate against an answer, the rules in their order."""
    return (
        F.when(c["text"] == "", True)
        .when(F.arrays_overlap(c["stamps"], a["stamps"]), True)
        .when(F.arrays_overlap(c["dates"], a["dates"]), True)
        .when(c["number"], F.array_contains(a["numbers"], c["match"]))
        .otherwise(F.contains(a["lower"], c["lower"]) | F.contains(a["match"], c["match"]) | (c["letter"] & (F.length(c["loose"]) >= 3) & F.contains(a["loose"], c["loose"])))
    )


def any_match(a: Column, candidates: Column) -> Column:
    """Whether any candidate (struct of `one` and its list `parts`) matches."""
    return F.exists(candidates, lambda c: single_match(a, c["one"]) | ((F.size(c["parts"]) > 0) & F.forall(c["parts"], lambda p: single_match(a, p))))


def value_aliases(raw: Column, language: Column, path: Column) -> Column:
    """What a raw value may be called in a language."""
    table = F.expr("map(" + ", ".join(f"{tx.sql_text(f'{value}|{lang}')}, {tx.sql_texts(names)}" for (value, lang), names in VALUE_ALIASES.items()) + ")")
    extra = none()
    for (value, at), other in PATH_ALIASES.items():
        extra = F.when((F.lower(raw) == value) & (path == at), F.coalesce(F.try_element_at(table, F.concat(F.lit(other + "|"), language)), none())).otherwise(extra)
    return F.concat(F.coalesce(F.try_element_at(table, F.concat_ws("|", F.lower(raw), language)), none()), extra)


def code_aliases(path: Column, raw: Column) -> Column:
    """What a code at one of the copy-or-localise paths may be called; none elsewhere."""
    def table(codes: dict[str, list[str]]) -> Column:
        return F.expr("map(" + ", ".join(f"{tx.sql_text(code)}, {tx.sql_texts(names)}" for code, names in codes.items()) + ")")

    return F.coalesce(
        F.when(path.isin(COUNTRY_PATHS), F.try_element_at(table(COUNTRY_CODES), F.upper(raw)))
        .when(path == CURRENCY_PATH, F.try_element_at(table(CURRENCY_CODES), F.lower(raw)))
        .when(path == LANGUAGE_PATH, F.try_element_at(table(LANGUAGE_CODES), F.lower(raw))),
        none(),
    )


def quoted(text: Column) -> Column:
    """A text as a pattern that matches just it."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", r"\\$0")


def has_code(plain_answer: Column, plain_code: Column) -> Column:
    """Whether a code stands in an answer without ASCII letters or digits beside it, in any case; both normalised."""
    return (plain_code == "") | F.regexp_like(plain_answer, F.concat(F.lit("(?iu)(?<![A-Za-z0-9])"), quoted(plain_code), F.lit("(?![A-Za-z0-9])")))


def _in(answer: Column, *ranges: str) -> Column:
    return answer.rlike("[" + "".join(ranges) + "]")


def _any_of(answer: Column, markers: list[str]) -> Column:
    return F.exists(texts(markers), lambda m: F.contains(answer, m))


def marker_count(answer: Column, markers: list[str]) -> Column:
    """How many of the distinct markers an answer holds; one inside another counts too."""
    return F.size(F.filter(texts(markers), lambda m: F.contains(answer, m)))


def indonesian_marker(lower: Column, match: Column, loose: Column) -> Column:
    """Whether an Indonesian marker is in any form of the answer."""
    return F.exists(texts(INDONESIAN_MARKERS), lambda m: F.contains(lower, m) | F.contains(match, m) | F.contains(loose, m))


def language_diagnostics(answer: Column, lower: Column, match: Column, loose: Column, language: Column) -> Column:
    """struct(target, wrong, marker, match) by the rule of the expected language; all false for a language without rule."""
    scripts = (HAN, KANA, THAI, TIBETAN, ARABIC, MONGOLIAN)
    words = F.size(F.regexp_extract_all(answer, F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z]{2,}(?![\p{L}\p{N}_])"), F.lit(0)))
    yes, no = F.lit(True), F.lit(False)

    def verdict(target: Column, wrong: Column, marker: Column) -> Column:
        return F.struct(target.alias("target"), wrong.alias("wrong"), marker.alias("marker"), (target & marker & ~wrong).alias("match"))

    foreign = _in(answer, *scripts)
    return (
        F.when(language == "en", verdict((words > 0) & ~foreign, foreign, words >= ENGLISH_LEAST_WORDS))
        .when(language == "zh", verdict(_in(answer, HAN), _in(answer, KANA), yes))
        .when(language == "ja", verdict(_in(answer, KANA), no, yes))
        .when(language == "th", verdict(_in(answer, THAI), no, yes))
        .when(language == "bo", verdict(_in(answer, TIBETAN), no, yes))
        .when(language == "ug", verdict(_in(answer, ARABIC), no, _any_of(answer, UYGHUR_MARKERS)))
        .when(language == "mn-Mong", verdict(_in(answer, MONGOLIAN), _in(answer, ARABIC, HAN, CYRILLIC, KANA, THAI, TIBETAN), yes))
        .when(language == "kk-Arab", verdict(_in(answer, ARABIC), _in(answer, HAN, CYRILLIC, KANA, MONGOLIAN, THAI, TIBETAN), marker_count(answer, KAZAKH_MARKERS) >= KAZAKH_LEAST))
        .when(language == "id", verdict(~foreign, foreign, indonesian_marker(lower, match, loose)))
        .otherwise(verdict(no, no, no))
    )
