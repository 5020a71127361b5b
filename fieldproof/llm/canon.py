"""One consistent form for text that looks the same (problem 7).

Default-ignorable characters are removed, the text is brought to compatibility-composed form,
every kind of blank becomes a space one for one, and letters of other scripts that have the shape
of a Latin letter become that letter. Case is kept unless full folding is asked for, because the
look-alike comparison tells cases apart. Work is done once per distinct value of a batch.

Defined cases: null stays null, an empty text stays empty, a text of ignorable characters only
becomes empty. Wording, punctuation and the number of blanks are never changed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import islice

# Characters that are not shown (Unicode property Default_Ignorable_Code_Point).
IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ"
    "︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
# Blanks.
BLANK = re.compile("[\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
# Letters of other scripts and the Latin letters of the same shape.
SAME_SHAPE = {
    # Cyrillic
    "АВСЕНІЈКМОРЅТХҮԚԜаеіјорсѕухһԛԝԁӏѵ": "ABCEHIJKMOPSTXYQWaeijopcsyxhqwdlv",
    "У": "Y",
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινϲϳ": "ABEZHIKMNOPTYXoivcj",
    # Armenian
    "ՕՍօսոհցԼ": "OUounhgL",
    # Cherokee
    "ᎪᎠᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᏔᏃᎥ": "ADBCEHJKLMPSTVWZi",
}
SHAPES = {ord(a): b for many, latin in SAME_SHAPE.items() for a, b in zip(many, latin)}
FOREIGN = re.compile("[Ͱ-֏ᲀ-᲏ἀ-῿Ꭰ-᏿]")


def canonical(text: str) -> str:
    """The form in which texts that look alike are equal strings; case is kept."""
    if text.isascii():
        return BLANK.sub(" ", text)
    text = unicodedata.normalize("NFKC", IGNORABLE.sub("", text))
    text = BLANK.sub(" ", text)
    if FOREIGN.search(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(SHAPES))
    return text


def folded(text: str) -> str:
    """canonical() with full case folding and runs of blanks as one; for comparisons without case."""
    return fold_form(canonical(text))


def fold_form(form: str) -> str:
    """folded() of a text that is in canonical form already."""
    low = form.casefold()
    return " ".join((low if low.isascii() else unicodedata.normalize("NFKC", low)).split())


def per_distinct(values: Iterable, function: Callable) -> list:
    """function of each value, computed once per distinct value; None stays None."""
    seen: dict = {None: None}
    out = []
    for value in values:
        if value not in seen:
            seen[value] = function(value)
        out.append(seen[value])
    return out


# Words that stand for no value.
NO_VALUE = frozenset({"n/a", "na", "null", "none", "nil", "nan", "undefined", "unknown", "tbd", "no value", "no answer", "not available"})
# letters and digits that are shown: no fillers, which count as letters
SHOWN = re.compile(r"[^\W_\u115f\u1160\u17b4\u17b5\u3164\uffa0]")
ENOUGH = 40  # letters that make more than any no-value word, even if three of them compose to one


def is_empty(text: str | None) -> bool:
    """Null, or nothing but blanks, invisible characters, punctuation or a no-value word."""
    if text is None:
        return True
    # a text that shows this many letters anywhere can be no word that stands for nothing
    return False if len(text) >= ENOUGH and next(islice(SHOWN.finditer(text), ENOUGH - 1, None), None) else _is_empty(text)


@lru_cache(maxsize=65_536)
def _is_empty(text: str) -> bool:
    form = canonical(text)
    if not any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "So" for c in form):
        return True
    return form.casefold().strip(" .,;:!?\"'`()[]<>{}-_*|~\u3002\u3001\u2026\u201c\u201d\u2018\u2019\u00ab\u00bb\u300c\u300d") in NO_VALUE
