"""Text forms that values and answers are compared in, as column expressions.

Only compatibility normalisation needs Python; it runs as one vectorised UDF over whole batches,
with ASCII values passed through. Everything else stays in the JVM. A form that others are made of
is bound once (`bound`), since array functions don't share what they have in common. Nulls stay null
throughout, empty texts stay empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from fieldproof.functions.dictionaries import BUDDHIST_FROM, BUDDHIST_OFFSET, MONTHS, OTHER_DIGITS, THAI_DIGITS

MONTH = "|".join(sorted(map(re.escape, MONTHS), key=len, reverse=True))
# Blanks, the marks that loose forms leave out, and the separators of enumerations.
SPACE = r"(?U)[\s\x1c-\x1f]"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LOOSE_MARKS = r"""[\s,，、;；:：.!?。．、"'`“”‘’()\[\]{}<>|/\\\-]+"""
SEPARATORS = r"(?i)\s*(?:,|，|、|;|；|\band\b|和|及|以及)\s*"
# The ways in which dates and times of day are written, after digits have become ASCII digits.
YMD = r"(?<!\d)(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*(?:日)?"
DMY = r"(?<!\d)(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{4})(?!\d)"
D_MONTH_Y = rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?\s+(\d{{4}})(?!\d)"
MONTH_D_Y = rf"({MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?[,]?\s+(\d{{4}})(?!\d)"
STAMP = r"(?<!\d)(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:t|\s+| เวลา | pukul )(\d{1,2}):(\d{2})(?::(\d{2}))?"
CLOCK = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?(?!\d)"
# what a text must hold for the search above to be begun
YEAR = r"\d{4}"
DAY_YEAR = r"\s\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}"
MONTH_YEAR = r"\.?\s+\d{4}(?!\d)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _plain(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)


def nfkc(column: Column | str) -> Column:
    """Compatibility-composed form."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_plain, na_action="ignore")

    return run(column)


def nfkc_array(column: Column | str) -> Column:
    """Compatibility-composed form of each element."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [_plain(y) for y in x])

    return run(column)


def ascii_thai_digits(column: Column) -> Column:
    """Thai digits as ASCII digits."""
    return F.translate(column, THAI_DIGITS, "0123456789")


def ascii_digits(column: Column) -> Column:
    """The further decimal digits that dates may be written in as ASCII digits."""
    return F.translate(column, OTHER_DIGITS, "0123456789" * (len(OTHER_DIGITS) // 10))


def no_thousands(column: Column) -> Column:
    """Without a comma or dot between a digit and a group of exactly three digits."""
    return F.regexp_replace(column, r"(?U)(?<=\d)[,.](?=\d{3}(?!\d))", "")


def match_form(lower: Column) -> Column:
    """From the normalised lower-case text: no blanks, no thousands separators."""
    return no_thousands(F.replace(F.regexp_replace(lower, SPACE + "+", ""), F.lit("／"), F.lit("/")))


def loose_form(match: Column) -> Column:
    """From the match form: without punctuation."""
    return F.regexp_replace(match, LOOSE_MARKS, "")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD from integers, null beyond 1-12 and 1-31; Buddhist years are converted. 31 February stays."""
    y = F.when(year >= BUDDHIST_FROM, year - BUDDHIST_OFFSET).otherwise(year)
    return F.when(month.between(1, 12) & day.between(1, 31), F.format_string("%04d-%02d-%02d", y, month, day))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def sql_text(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_texts(texts: list[str]) -> str:
    """Texts as an array literal of Spark SQL; a long one is one expression, not a call for every text."""
    return f"array({', '.join(map(sql_text, texts))})" if texts else "cast(array() AS array<string>)"


def _month(name: Column) -> Column:
    return F.element_at(F.expr("map(" + ", ".join(f"{sql_text(k)}, {v}" for k, v in MONTHS.items()) + ")"), name)


def texts_none() -> Column:
    """An empty array of texts."""
    return F.expr(sql_texts([]))


def _found(text: Column, pattern: str, build: Callable[[Callable[[int], Column]], Column]) -> Column:
    """What `build` makes of the groups of every match, nulls left out."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(hits, lambda m: build(lambda i: F.regexp_extract(m, pattern, i))), lambda x: x.isNotNull())


def numeric_dates(text: Column) -> Column:
    """The distinct dates that a normalised lower-case text with ASCII digits writes in numbers, year first or year last."""
    def date(g: Callable[[int], Column], year: int, month: int, day: int) -> Column:
        return calendar_date(_int(g(year)), _int(g(month)), _int(g(day)))

    return F.array_union(_found(text, YMD, lambda g: date(g, 1, 2, 3)), _found(text, DMY, lambda g: date(g, 3, 2, 1)))


def named_dates(text: Column) -> Column:
    """The distinct dates that such a text writes with the name of a month, before or after the day."""
    def date(g: Callable[[int], Column], year: int, month: int, day: int) -> Column:
        return calendar_date(_int(g(year)), _month(g(month)), _int(g(day)))

    return F.array_union(
        F.when(text.rlike(MONTH_YEAR), _found(text, D_MONTH_Y, lambda g: date(g, 3, 2, 1))).otherwise(texts_none()),
        F.when(text.rlike(DAY_YEAR), _found(text, MONTH_D_Y, lambda g: date(g, 3, 1, 2))).otherwise(texts_none()),
    )


def dates(text: Column) -> Column:
    """All distinct dates of a normalised lower-case text with ASCII digits."""
    return F.when(text.rlike(YEAR), F.array_union(numeric_dates(text), named_dates(text))).otherwise(texts_none())


def _clock(hour: Column, minute: Column, second: Column) -> Column:
    return F.format_string("%02d:%02d:%02dZ", _int(hour), _int(minute), F.coalesce(_int(second), F.lit(0)))


def datetimes(text: Column, own_dates: Column) -> Column:
    """The distinct date-times of a text as in dates(): dates followed by a time, and each of its dates with every time of day."""
    stamps = _found(text, STAMP, lambda g: F.concat(calendar_date(_int(g(1)), _int(g(2)), _int(g(3))), F.lit("T"), _clock(g(4), g(5), g(6))))
    clocks = _found(text, CLOCK, lambda g: _clock(g(1), g(2), g(3)))
    pairs = bound(clocks, lambda times: F.flatten(F.transform(own_dates, lambda d: F.transform(times, lambda c: F.concat(d, F.lit("T"), c)))))
    return F.when(F.contains(text, F.lit(":")), F.array_union(stamps, pairs)).otherwise(texts_none())


def parts_of(text: Column) -> Column:
    """What the separators of enumerations leave of a text, without outer blanks; empty parts are left out."""
    return F.filter(F.transform(F.split(text, SEPARATORS), lambda x: F.regexp_replace(x, OUTER_SPACE, "")), lambda x: x != "")


def list_parts(text: Column, own_dates: Column) -> Column:
    """The parts of an enumeration, or none if there are fewer than two or the text has a date."""
    return bound(parts_of(text), lambda parts: F.when((F.size(own_dates) == 0) & (F.size(parts) >= 2), parts).otherwise(texts_none()))
