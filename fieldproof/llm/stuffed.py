"""Pages of repeated keywords, links or tags in place of sentences (problem 10).

Every line is reduced to a shape: buckets of its words, capitals, separators and links, and the
kind of line these make (sentence, link, tag, offer, keyword list, fragment). Repetition is tested
before a stop makes a line a sentence, so key phrases closed by stops are keywords. Equal shapes of a
page are grouped, and a page is flagged when groups of non-sentence shapes hold most of its text
and few shapes make up that part. One pass over the rows, no shuffle, whole texts.

Defined cases: null, empty and blank texts and JSON are never flagged; copies of a page are flagged
alike; a page of one word is no stuffed page.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldproof.llm.canon import canonical

LINK = re.compile(r"<a\s[^<>]*+>[^<]*+(?:<(?!/?a[\s>])[^<]*+)*+</a>|\[[^\[\]]*+\]\((?:https?://|www\.)[^)\s]*+\)|(?:https?://|www\.)\S+", re.I)
TAG = re.compile(r"(?<!\w)#[^\s#]{2,}|\[[^\[\]\n]++\](?!\()")
# Words and marks of product offers, and one of which each offer holds in lower case.
OFFER = re.compile(
    r"\d+\s?% off\b|\bbuy now\b|\bSKU\b|\bfree shipping\b|\badd to cart\b|\bin stock\b|\border now\b|[$€£¥]\s?\d|\bdiscount\b|\bcheap\b"
    r"|立即购买|加入购物车|包邮|今すぐ購入|送料無料|カートに入れる|สั่งซื้อเลย|ส่งฟรี|\bbeli sekarang\b|\bgratis ongkir\b",
    re.I,
)
OFFER_HINTS = ("% off", "buy now", "sku", "free shipping", "add to cart", "in stock", "order now", "discount", "cheap", "$", "€", "£", "¥", "立即购买", "加入购物车", "包邮", "今すぐ購入", "送料無料", "カートに入れる", "สั่งซื้อเลย", "ส่งฟรี", "beli sekarang", "gratis ongkir")
SEPARATORS = "•·、;,/،᠂"
SPACED = re.compile(r"\s[-–—@]\s")
STOP = re.compile(r"[.!?](?=[\s\"')\]]|$)|[。!?؟།᠃]")
NUMBER = re.compile(r"\d[\d.,:/-]*\d")
OBJECT = re.compile(r"^[\[{].*[\"}\]][,:]?\s*[\[\]{}\d\w\"]", re.S)
FEW_WORDS = 16  # distinct words of a line of key phrases, however long it is
LINK_LENGTH = 25  # a link counts like a few words, however long its address is
WORD = re.compile(r"[^\W\d_](?:[\w'’་-]*\w)?")
THAI = re.compile(r"[\u0e00-\u0e7f]")


class Shape(NamedTuple):
    """What is kept of a line."""

    kind: str
    words: int
    capitals: int
    separators: int
    links: int


def bucket(n: int) -> int:
    """0, 1, 2, 3-4, 5-8, 9-16, ... as 0, 1, 2, 3, 4, 5, ..."""
    return n if n < 3 else (n - 1).bit_length() + 1


def separated(text: str) -> list[str]:
    """What the separators leave of a text, blank parts left out."""
    for mark in (*SEPARATORS, ">>"):
        if mark in text:
            text = text.replace(mark, "|")
    if SPACED.search(text):
        text = SPACED.sub("|", text)
    return [x for x in text.split("|") if x and not x.isspace()]


def repetitive(text: str) -> bool:
    """Whether a text without links is short phrases, split at stops and separators, of the same few words again and again.

    Numbers count as words, so fields whose values differ aren't repetition.
    """
    low = text.casefold()
    plain = WORD.findall(low)
    if len(set(plain)) > 0.75 * len(plain):  # most lines end here, cheaply
        return False
    phrases = [p.split() for x in separated(low) for p in STOP.split(x) if p.strip()]
    words = [w for p in phrases for w in p]
    known = set(words)
    if len(phrases) < 6 or len(words) < 12 or len(words) > 6 * len(phrases) or len(known) > 0.5 * len(words):
        return False
    if len(known) <= FEW_WORDS:
        return True
    # more words are no prose either where one key word is in nearly every phrase
    if len(known) > 0.2 * len(words) or len(words) > 4 * len(phrases):
        return False
    held = Counter(w for p in phrases for w in set(p))
    return held.most_common(1)[0][1] >= 0.9 * len(phrases)


def without_links(line: str) -> tuple[str, int]:
    """A line with a blank in place of each link, and their number."""
    low = line.lower()
    return LINK.subn(" ", line) if "://" in low or "www." in low or "</a>" in low else (line, 0)


def line_shape(line: str) -> Shape:
    """The shape of one line, which isn't blank."""
    if line[0] in "{[" and OBJECT.match(line) and '":' in line:
        return Shape("object", 0, 0, 0, 0)
    linkless, links = without_links(line)
    rest = NUMBER.sub("0", linkless)
    words = WORD.findall(rest)
    items = separated(rest)
    tags = TAG.findall(rest) if "#" in rest or "[" in rest else []
    low = rest.lower()
    offers = len(OFFER.findall(rest)) if any(x in low for x in OFFER_HINTS) else 0
    letters = sum(map(len, words))
    mean = letters / max(1, len(items))
    stops = len(STOP.findall(rest.rstrip()))
    # a sentence closes with a stop and has running words between its separators
    running = len(words) >= 4 or letters >= 12
    if tags and sum(map(len, tags)) >= 0.5 * len(rest.strip()) and len(tags) >= 3:
        kind = "tag"
    elif offers >= 2 or offers and len(items) >= 3 and not stops:
        kind = "offer"
    elif stops and repetitive(linkless):
        kind = "keywords"
    elif stops and running and (mean >= 8 or len(items) < 4) and letters > 8 * max(0, len(items) - 6 * stops - 6):
        kind = "sentence"
    elif links and letters < 60:
        kind = "link"
    elif len(items) >= 6 and not stops and len(set(words)) <= 0.75 * len(words):
        kind = "keywords"
    elif len(items) >= 4 and not stops and mean < 25:
        kind = "keywords"
    elif THAI.search(rest) and letters >= 30 and len(words) >= 3:
        kind = "sentence"  # Thai closes sentences without a mark
    elif len(words) >= 6 and len(set(words)) <= 0.4 * len(words):
        kind = "keywords"
    elif len(words) <= 6 and not stops:
        kind = "fragment"
    else:
        kind = "sentence"
    return Shape(kind, bucket(len(words)), bucket(sum(w[0].isupper() for w in words) if rest != low else 0), bucket(len(items) - 1), bucket(links))


FEW_SHAPES = 12
SHORT = 4  # bucket of 5 to 8 words
MOST = 0.5


def stuffing(text: str) -> tuple[float, int, int]:
    """(share of the text in lines of spam kinds, lines of these kinds, distinct shapes among them)."""
    lines = [x for x in (canonical(line).strip() for line in re.split(r"[\r\n\u2028\u2029]+", text)) if x]
    shapes: Counter[Shape] = Counter()
    mass: Counter[Shape] = Counter()
    fragments: list[str] = []
    shaped = [line_shape(line) for line in lines]
    # short lines that each close with a stop are judged together
    short = [i for i, s in enumerate(shaped) if s.kind == "sentence" and s.words <= SHORT]
    if len(short) >= 6 and repetitive("\n".join(f"{without_links(lines[i])[0]} |" for i in short)):
        for i in short:
            shaped[i] = shaped[i]._replace(kind="keywords")
    for line, shape in zip(lines, shaped):
        shapes[shape] += 1
        linkless, links = without_links(line)
        mass[shape] += len(linkless) + links * (LINK_LENGTH - 1)
        if shape.kind == "fragment":
            fragments.append(line)
    whole = sum(mass.values())
    # fragments are spam where they repeat a keyword line after line
    repeated = False
    if len(fragments) >= 4:
        counts = Counter(w for line in fragments for w in set(WORD.findall(line.casefold())))
        repeated = len(set(fragments)) <= 0.6 * len(fragments) or bool(counts) and counts.most_common(1)[0][1] >= 0.4 * len(fragments)
    spam = [s for s in shapes if s.kind in ("link", "tag", "offer", "keywords") or s.kind == "fragment" and repeated]
    return (sum(mass[s] for s in spam) / whole if whole else 0.0), sum(shapes[s] for s in spam), len(spam)


def is_stuffed(text: str | None) -> bool:
    """Whether a page is for the most part keywords, links or tags."""
    if text is None or not text.strip():
        return False
    head = text.lstrip()[:1]
    if head in "{[":
        try:
            json.loads(text)
            return False
        except (ValueError, RecursionError):
            pass
    share, lines, shapes = stuffing(text)
    return share > MOST and shapes <= max(FEW_SHAPES, lines // 2)


def stuffed_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of every stuffed page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            if len(seen) > 50_000:
                seen.clear()
            for t in b["text"]:
                if t not in seen:
                    seen[t] = is_stuffed(t)
            yield pd.DataFrame({"key": b["key"][[seen[t] for t in b["text"]]]})

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, "key bigint").withColumnRenamed("key", key)
