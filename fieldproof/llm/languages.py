"""Languages of texts and of their segments by rank-order profiles (problem 6).

A text is cut into sentences and stretches of one script. Running words are what is left without
names (capitalised Latin words), codes, numbers and raw status words. Each stretch is compared with
the profiles of the languages written in its script by the out-of-place distance: the ranks of its
most frequent character n-grams against their ranks in the profile. The confidence is the margin
to the next best language, or the closeness to the profile where the script has one language.

The profiles are fitted on a bounded sample of labelled documents (SAMPLE_DOCUMENTS, by hash of the
key); wrongly labelled ones are dropped by a second pass over the sample. Everything else covers
whole texts of all rows.

Defined cases: null, empty and letterless texts have no language; look-alike letters count as the
letters they look like; stretches in scripts without a profile, and long ones far from every profile
of a script that several languages share, are `und`.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from fieldproof.llm.canon import canonical

SAMPLE_DOCUMENTS = 3000
PROFILE_SIZE = 400  # n-grams of a profile
TEXT_GRAMS = 120  # most frequent n-grams of a stretch that are compared
ORDERS = (1, 2, 3)

# Languages by script.
BY_SCRIPT = {"cjk": ("zh", "ja"), "thai": ("th",), "tibetan": ("bo",), "mongolian": ("mn-Mong",), "arabic": ("ug", "kk-Arab"), "latin": ("id", "en")}
LANGUAGES = tuple(x for many in BY_SCRIPT.values() for x in many)
# Status words that records hold and answers may repeat raw.
STATUS_WORDS = frozenset({"active", "closed", "confirmed", "pending", "provisional"})

# how words of each script are told
WORDS = {
    "cjk": r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3005-\u3007]+",
    "thai": r"[\u0e00-\u0e7f]+",
    "tibetan": r"[\u0f00-\u0fff]+",
    "mongolian": r"[\u1820-\u18aa]+",
    "arabic": r"[\u0620-\u065f\u066e-\u06ff\u0750-\u077f]+",
    "latin": r"(?<![A-Za-z\u00c0-\u024f\d_])[A-Za-z\u00c0-\u024f]+(?:['\u2019][a-z]+)?(?![\w$@#/{}\[\]](?<![\u0e00-\uffff]))",
}
STRETCH = re.compile("|".join(f"(?P<{script}>{word})" for script, word in WORDS.items()))
ONE_SCRIPT = [(script, re.compile(word).findall) for script, word in WORDS.items()]
# letters of scripts that no profile is for, in the canonical form: Greek, Cyrillic, Armenian, Hebrew, those of India and south-east Asia, Georgian, Hangul, Ethiopic and others
OTHER = re.compile(r"[\u0370-\u05ff\u0700-\u074f\u0780-\u0dff\u0e80-\u0eff\u1000-\u17ff\u1900-\u1cff\u2c80-\u2dff\ua000-\uabff\uac00-\ud7af]")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)|[\u3002!?\u061f\u0f0d\u1803\n]|(?<=[\u3040-\u9fff])\s(?=[\u3040-\u9fff])")
UNKNOWN = "und"
# a stretch of this many letters that is further than this from every profile of its script is in none of their languages
FAR, FAR_LETTERS = 0.58, 80


class Stretch(NamedTuple):
    """A stretch of running words of one language."""

    start: int
    end: int
    lang: str
    confidence: float
    letters: int


@lru_cache(maxsize=100_000)
def grams(word: str) -> tuple[str, ...]:
    """The n-grams of a padded word."""
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in ORDERS for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")


def ranked(words: list[str], most: int) -> list[str]:
    """The most frequent n-grams by falling frequency, ties in the order of the words."""
    counts: Counter = Counter()
    for w in words:
        counts.update(grams(w))
    return sorted(counts, key=counts.__getitem__, reverse=True)[:most]


Profiles = dict[str, dict[str, int]]


def out_of_place(order: list[str], profile: dict[str, int]) -> float:
    """The mean distance of ranks, 0 to 1; n-grams that the profile lacks count as the whole size."""
    total, rank = 0, profile.get
    for i, g in enumerate(order):
        at = rank(g, -1)
        total += PROFILE_SIZE if at < 0 else at - i if at > i else i - at
    return total / (PROFILE_SIZE * max(1, len(order)))


def running_words(words: list[str]) -> list[str]:
    """The words of Latin letters that aren't names, codes or raw status words; words in capitals count where they prevail."""
    running = [w for w in words if w.islower() and len(w) > 1 and w not in STATUS_WORDS]
    capitals = [w for w in words if w.isupper() and len(w) > 1 and w.lower() not in STATUS_WORDS]
    return running + capitals if len(capitals) > 2 and len(capitals) > len(running) else running


class Identifier:
    """Names the languages of texts by profiles."""

    def __init__(self, profiles: Profiles) -> None:
        self.profiles = profiles
        self.named: dict[tuple, tuple[str, float]] = {}

    def name(self, script: str, words: list[str]) -> tuple[str, float]:
        """(language, confidence) of running words of one script."""
        words = sorted(words)
        key = (script, *words)
        known = self.named.get(key)
        if known is None:
            order = ranked(words, TEXT_GRAMS)
            found = sorted((out_of_place(order, self.profiles.get(x, {})), x) for x in BY_SCRIPT[script])
            if len(found) > 1 and found[0][0] > FAR and sum(map(len, words)) >= FAR_LETTERS:
                known = (UNKNOWN, round(found[0][0], 4))
            elif len(found) == 1:
                known = (found[0][1], round(1 - found[0][0], 4))
            else:
                (first, lang), (second, _) = found[:2]
                known = (lang, round(min(1.0, 0.5 + (second - first) / max(second, 1e-9)), 4))
            if len(self.named) > 200_000:
                self.named.clear()
            self.named[key] = known
        return known

    def stretches(self, text: str) -> list[Stretch]:
        """Per sentence and script with running words: its place, language and confidence; text in canonical form."""
        out = []
        start = 0
        foreign = OTHER.search(text) is not None
        for end, then in [m.span() for m in SENTENCE_END.finditer(text)] + [(len(text), len(text))]:
            if end > start:
                by: dict[str, list] = defaultdict(list)
                for m in STRETCH.finditer(text, start, end):
                    by[m.lastgroup].append(m)
                if foreign and (words_of_others := [m for m in LETTERS.finditer(text, start, end) if OTHER.search(m.group())]):
                    size = sum(len(m.group()) for m in words_of_others)
                    # where other letters prevail, Latin ones are those of words whose letters all look Latin
                    if size >= sum(len(m.group()) for m in by.get("latin", ())):
                        by.pop("latin", None)
                        out.append(Stretch(words_of_others[0].start(), words_of_others[-1].end(), UNKNOWN, 1.0, size))
                for script, found in by.items():
                    words = [m.group() for m in found]
                    if script == "latin":
                        picked = set(running_words(words))
                        found = [m for m in found if m.group() in picked]
                        if not found:
                            continue
                        words = [m.group().lower() for m in found]
                    lang, confidence = self.name(script, words)
                    out.append(Stretch(found[0].start(), found[-1].end(), lang, confidence, len(words) if script == "latin" else sum(map(len, words))))
            start = then
        return out

    def spoken(self, text: str) -> Iterator[tuple[str, float, int]]:
        """(language, confidence, letters) of stretches() in known languages; without places, which cost most, where all scripts are known."""
        if OTHER.search(text):
            yield from ((s.lang, s.confidence, s.letters) for s in self.stretches(text) if s.lang != UNKNOWN)
            return
        for sentence in SENTENCE_END.split(text):
            for script, find in ONE_SCRIPT:
                words = find(sentence) if sentence else ()
                if words and script == "latin":
                    words = [w.lower() for w in running_words(words)]
                if words:
                    lang, confidence = self.name(script, words)
                    if lang != UNKNOWN:
                        yield lang, confidence, len(words) if script == "latin" else sum(map(len, words))

    def languages(self, text: str | None) -> dict[str, tuple[int, float]]:
        """{language: (letters, confidence)} of the running words of a text, the largest part first.

        Beside other languages, a few Latin words or letters of another script are a name or a
        status word, not running words.
        """
        if not text:
            return {}
        return self.form_languages(canonical_lines(text))

    def form_languages(self, form: str) -> dict[str, tuple[int, float]]:
        """languages() of a text that is in canonical form already; stretches in no known language don't count."""
        size: Counter = Counter()
        sure: dict[str, float] = defaultdict(float)
        for lang, confidence, letters in self.spoken(form):
            size[lang] += letters
            sure[lang] = max(sure[lang], confidence)
        kept = {x: n for x, n in size.items() if len(size) == 1 or n >= FEWEST.get(x, 8)}
        return {x: (n, sure[x]) for x, n in sorted(kept.items(), key=lambda x: (-x[1], x[0]))}


FEWEST = {"en": 3, "id": 3, "zh": 4, "ja": 4}


def canonical_lines(text: str) -> str:
    """canonical() that keeps line ends."""
    return "\n".join(map(canonical, text.split("\n"))) if "\n" in text else canonical(text)


def fit(labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles of (text, language) pairs; a second pass leaves out texts that another profile fits better."""
    profiles: Profiles = {}
    for final in (False, True):
        words: dict[str, list[str]] = defaultdict(list)
        identifier = Identifier(profiles) if final else None
        for text, lang in labelled:
            if lang not in LANGUAGES:
                continue
            script = next(k for k, v in BY_SCRIPT.items() if lang in v)
            form = canonical_lines(text)
            found = [m.group() for m in STRETCH.finditer(form) if m.lastgroup == script and (script != "latin" or m.group().islower() and m.group() not in STATUS_WORDS)]
            if not found or final and identifier.name(script, found)[0] != lang:
                continue
            words[lang] += found
        profiles = {lang: {g: i for i, g in enumerate(ranked(many, PROFILE_SIZE))} for lang, many in words.items()}
    return profiles


def fit_on_documents(documents: DataFrame, names: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Profiles:
    """Profiles of a bounded sample of labelled documents; the rows with the smallest hashes are taken."""
    picked = (
        documents.filter(F.col("lang").isNotNull() & (F.length("text") > 20))
        .select("doc_id", "text", F.col("lang").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .join(F.broadcast(names.select("label", "code")), "label", "left")
        .select("text", F.coalesce("code", "label").alias("code"))
    )
    return fit([(r["text"], r["code"]) for r in picked.collect()])
