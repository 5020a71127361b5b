"""Broken prompt and response pairs (problem 5).

Each answer is looked at once beside its task: is it empty, a stand-in, a copy of the query, does it
hold a value of the task, in which languages is it, how does it begin and how does it end. Two
statistics over all answers then decide what one answer can't tell:

* Openings, with names and numbers masked, are clustered by MinHash bands with verified Jaccard
  similarity. A cluster that recurs across unrelated tasks, holds no value of them, and whose head
  doesn't lead into answers that do, is a refusal template. Clusters too small to recur are taken
  where they decline in so many words.
* Endings of answers that close with a full stop tell which endings close a sentence in a language.
  An answer without a full stop is truncated unless it ends in one of them or in a whole value of
  its task.

Defined cases: null is empty; a prediction without a task is only tested for empty and refusal;
repeated answers are each labelled; an answer gets the first defect of empty, copy, refusal,
other_language, truncated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from fieldproof.functions.jsontext import UNREADABLE, leaves, read_json
from fieldproof.llm.answer_languages import identifier
from fieldproof.llm.canon import BLANK, fold_form, folded, is_empty
from fieldproof.llm.grouped_split import connected, safe_seed
from fieldproof.llm.languages import Profiles, canonical_lines
from fieldproof.llm.standins import holds_standin, own_texts, task_key
from fieldproof.session import checkpointed

OPENING = 32  # characters of an opening
HEAD = 12  # characters of an opening that tell what it leads into
TAIL = 6  # characters of an ending
SHINGLE = 3
BANDS, ROWS = 16, 4
SIMILAR = 0.8
BLOCK = 500  # openings of a band that one key compares with as many others
RECURS_TASKS, RECURS_DOMAINS = 5, 3
CLOSING_SHARE, CLOSING_LEAST = 2e-5, 3

WORD = r"(?:[A-ZÀ-Þ][\wÀ-ɏ'-]*|(?<![\w-])[\w-]*\d[\w.,:/-]*)"
VALUE = re.compile(rf"{WORD}(?:\s+{WORD})*", re.ASCII)
# Marks and words that close a sentence.
CLOSED = re.compile(r"(?:[.!?。！？؟།᠃]|ครับ|ค่ะ|คะ)[\s\"'”»」』)\]]*$")
CUT = re.compile(r"(?:\.\.+|…|[,，、،᠂:：;；(（\[“«「‐–—-])[\s\"']*$")
# Phrases that decline, in the languages of the data.
DECLINES = re.compile(
    r"\bi (?:cannot|can't|can not|am unable|must decline|won't)\b|\bunable to (?:provide|answer|help|assist)|\bcan't help with\b|as a language model"
    r"|无法(?:回答|提供|协助)|不能(?:提供|回答)|没有办法协助|超出了我的能力|作为一个语言模型"
    r"|お答えできません|対応いたしかね|提供することはできません|言語モデルとして"
    r"|ไม่สามารถ(?:ตอบ|ช่วย|ให้)|tidak (?:dapat membantu|bisa menjawab|diizinkan memberikan)"
    r"|ལན་འདེབས་མི་ཐུབ|རོགས་རམ་བྱེད་ཐབས་མི|جاۋاب بېرەلمەيمەن|ياردەم قىلالمايمەن|جاۋاپ بەرە المايمىن|كومەكتەسە المايمىن"
    r"|ᠬᠠᠷᠢᠭᠤᠯᠵᠤ ᠴᠢᠳᠠᠬᠤ ᠦᠭᠡᠢ|ᠲᠤᠰᠠᠯᠠᠵᠤ ᠴᠢᠳᠠᠬᠤ ᠦᠭᠡᠢ"
)
MONTHS = (
    "january februari february maret march april mei may juni june juli july agustus august september oktober october november desember december januari"
).split()


def letters(text: str) -> str:
    """Letters and digits only, folded."""
    return re.sub(r"[\W_]+", "", folded(text))


@lru_cache(maxsize=50_000)
def query_letters(text: str) -> str:
    """letters() of a query, which many answers share."""
    return letters(text)


LEAD_IN = 20
SAID = re.compile(r"[^\W_]+")


def copies_query(low: str, query: str) -> bool:
    """Whether an answer, in folded form, is the query and nothing more, up to a lead-in, marks and repetition."""
    asked = query_letters(query)
    if not asked:
        return False
    said = "".join(SAID.findall(low))
    return asked in said and len(said.replace(asked, "")) <= LEAD_IN


def masked(form: str) -> str:
    """A text in canonical form with names, codes and numbers as N; one all in capitals is lowered first."""
    if form.isupper() and len(re.findall("[A-Z]", form)) >= 12:
        form = form.lower()
    return " ".join(VALUE.sub("N", form).casefold().split())


def value_forms(values: list[str]) -> set[str]:
    """The ways in which a whole value may be written at the end of an answer, folded."""
    out: set[str] = set()
    for value in values:
        v = folded(value)
        out.add(v)
        if re.fullmatch(r"-?\d{4,}(?:\.\d+)?", v):
            whole, dot, rest = v.partition(".")
            out.add(f"{int(whole):,}{dot}{rest}")
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", v):
            y, mo, d = map(int, m.groups())
            out |= {f"{d}/{mo}/{y + 543}", f"{d}/{mo}/{y}", f"{d:02}/{mo:02}/{y + 543}", f"{y}/{mo:02}/{d:02}", f"{y}.{mo:02}.{d:02}"}
            out |= {f"{d} {name} {y}" for name in MONTHS} | {f"{name} {d}, {y}" for name in MONTHS}
    return out


def endings(low: str, forms: set[str]) -> Iterator[str]:
    """The forms of whole values that a folded text ends in."""
    for v in forms:
        if v and low.endswith(v) and not (len(low) > len(v) and v[0].isalnum() and v[0].isascii() and low[-len(v) - 1].isascii() and (low[-len(v) - 1].isalnum() or low[-len(v) - 1] in ".-/" and v[0].isdigit())):
            yield v


def ends_in_value(low: str, forms: set[str], nested: set[str]) -> bool:
    """Whether a folded text ends in a whole value; a nested one isn't whole where it may be the beginning of another value."""
    return any(True for _ in endings(low, forms)) or any(not any(w.startswith(v) and w != v for w in forms) for v in endings(low, nested))


MEMBER_TEXT = re.compile(r':\s*"((?:[^"\\]|\\.)*)"\s*[,}\]]')  # of members, not their names


def task_facts(tasks: DataFrame) -> DataFrame:
    """(task_id, domain, query, values, nested, own), one row per id: what an answer is held against.

    nested are the values below the outermost object, which an answer may end in. Copies of a
    task agree in their query; values are united over them, of any length.
    """
    picked = tasks.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("task_id"),
        "domain",
        "user_query",
        "tool_result",
        F.transform("field_specs", lambda s: s["value"]).alias("spec_values"),
        F.flatten(F.transform("field_specs", lambda s: F.coalesce(s["accepted_values"], F.array().cast("array<string>")))).alias("accepted"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for task, domain, query, result, specs, accepted in b.itertuples(index=False, name=None):
                specs = [x for x in specs if x] if specs is not None else []
                found = [*specs, *(x for x in (accepted if accepted is not None else ()) if x)]
                value = read_json(result)
                nested: list[str] = []
                if value is not UNREADABLE:
                    nested = [x if isinstance(x, str) else repr(x) for _, x in leaves(value) if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
                    while isinstance(value, list) and value:
                        value = value[0]
                    if isinstance(value, dict):
                        found += [x if isinstance(x, str) else repr(x) for x in value.values() if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
                elif result:
                    found += [m.group(1) for m in re.finditer(r":\s*(-?\d+(?:\.\d+)?)\s*[,}]", result)] + [x for x in MEMBER_TEXT.findall(result) if "\\" not in x]
                found = list(dict.fromkeys(x for x in found if x.strip()))
                known = set(found)
                rows.append((task, domain, query, found, list(dict.fromkeys(x for x in nested if x.strip() and x not in known)), own_texts(result, query, specs)))
            if rows:
                yield pd.DataFrame(rows, columns=["task_id", "domain", "query", "values", "nested", "own"])

    facts = picked.mapInPandas(run, "task_id string, domain string, query string, values array<string>, nested array<string>, own array<string>")
    united = [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("values", "nested", "own")]
    return facts.groupBy("task_id").agg(F.min("domain").alias("domain"), F.min("query").alias("query"), *united)


LOOKS = "pred_id bigint, task_id string, domain string, defect string, declines boolean, grounded boolean, opening string, closed boolean, lang string, tail string, whole boolean"


def looks(predictions: DataFrame, tasks: DataFrame, profiles: Profiles) -> DataFrame:
    """One row per prediction that isn't a stand-in, with what its text alone and beside its task shows.

    defect: empty, copy, other_language or null; tail: the masked ending; whole: whether it ends in
    a whole value of the task.
    """
    picked = predictions.select("pred_id", task_key().alias("task_id"), "answer")
    joined = picked.join(task_facts(tasks), "task_id", "left").select("pred_id", "task_id", "answer", "domain", "query", "values", "nested", "own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = identifier(profiles)
        asked_in: dict[str, str | None] = {}
        of_task: str | None = ""
        plain_values: list[str] = []
        task_values: list[str] = []
        ending_forms: tuple[set[str], set[str]] | None = None
        for b in batches:
            rows = []
            for pred, task, answer, domain, query, values, nested, own in b.itertuples(index=False, name=None):
                if is_empty(answer):
                    rows.append((pred, task, domain, "empty", False, False, None, False, None, None, False))
                    continue
                has_task = values is not None
                lines = canonical_lines(answer)
                form = BLANK.sub(" ", lines).strip()
                low = fold_form(form)
                if holds_standin(form, low) and not (has_task and len(own) and not holds_standin(form, low, sorted(own, key=len, reverse=True))):
                    continue
                if has_task and query and copies_query(low, query):
                    rows.append((pred, task, domain, "copy", False, True, None, False, None, None, False))
                    continue
                if task != of_task:  # answers of a task come together
                    of_task, values = task, [x for x in values if len(x) > 1] if has_task else []
                    plain_values = [folded(v) for v in values]
                    task_values = values
                    ending_forms = None
                values = task_values
                grounded = any(v in low for v in plain_values if len(v) > 2) or sum(map(str.isdigit, low)) >= 3
                langs = named.form_languages(lines)
                lang = next(iter(langs), None)
                defect = None
                if has_task and query and langs:
                    if query not in asked_in:
                        if len(asked_in) > 50_000:
                            asked_in.clear()
                        asked_in[query] = next(iter(named.languages(query)), None)
                    if asked_in[query] and asked_in[query] not in langs:
                        defect = "other_language"
                end = form[-80:]
                cut = CUT.search(end)
                closed = CLOSED.search(end)
                at = len(form) - len(end) + (closed.start() if closed else 0)
                body = (form[:at] if closed and not cut else form).rstrip()
                mask = masked(form)
                tail = masked(body)[-TAIL:]
                value_end = bool(re.search(r"[A-Za-zÀ-ɏ0-9]$", body))
                whole = False
                if has_task and value_end:
                    if ending_forms is None:
                        ending_forms = value_forms(values), value_forms([x for x in nested if len(x) > 1])
                    whole = ends_in_value(folded(body), *ending_forms)
                # a full stop after a digit may be the point of a number that was cut
                if closed and body and body[-1].isdigit() and form[at] == "." and has_task and not whole and re.search(r"\d$", body):
                    closed = None if any(v.startswith(re.search(r"[\d.,]+$", body).group() + ".") for v in plain_values) else closed
                rows.append((pred, task, domain, defect, not grounded and bool(DECLINES.search(low)), grounded, mask[:OPENING], bool(closed) and not cut, lang, None if cut else tail, whole))
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in LOOKS.split(", ")])

    return joined.mapInPandas(run, LOOKS)


def minhash(text: str) -> list[int]:
    """The band hashes of a text's character shingles."""
    shingles = {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in shingles], dtype=np.uint64)
    odd = np.arange(1, 2 * BANDS * ROWS + 1, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lowest = ((hashes[:, None] ^ odd[None, :]) * np.uint64(0xC2B2AE3D27D4EB4F)).min(axis=0)
    return [xxhash.xxh64_intdigest(lowest[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - (1 << 63) for i in range(BANDS)]


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster) of distinct openings; clusters join openings of verified similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"opening": b["opening"], "bands": [minhash(x) for x in b["opening"]]})

    shingled = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (SHINGLE - 1))), lambda i: F.substring(c, i, F.lit(SHINGLE))))
    seed = safe_seed(openings.select(F.col("opening").alias("key")))
    keyed = checkpointed(openings.select("opening").mapInPandas(run, "opening string, bands array<bigint>").withColumn("node", F.xxhash64("opening", F.lit(seed))))
    bands = keyed.select("node", shingled(F.col("opening")).alias("shingles"), F.explode("bands").alias("band"))
    # all pairs of a band are compared: large bands are cut into blocks, and every two blocks meet under a key of their own
    blocks = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    placed = bands.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = placed.select("band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "shingles")
    right = met.select("band", "low", "high", F.col("block").alias("other_block"), F.col("node").alias("b"), F.col("shingles").alias("others"))
    pairs = met.join(right, ["band", "low", "high"]).filter("node < b AND (block <> other_block OR low = high)")
    alike = F.size(F.array_intersect("shingles", "others")) >= F.lit(SIMILAR) * F.size(F.array_union("shingles", "others"))
    near = F.least(F.size("shingles"), F.size("others")) >= F.lit(SIMILAR) * F.greatest(F.size("shingles"), F.size("others"))
    linked = pairs.filter(near & alike).select(F.col("node").alias("a"), "b").distinct()
    roots = connected(linked)
    return keyed.select("node", "opening").join(roots, "node", "left").select("opening", F.coalesce("root", "node").alias("cluster"))


def refusal_openings(rows: DataFrame) -> DataFrame:
    """(opening, recurs) of the refusal templates: those found by recurrence, and small clusters that decline in so many words."""
    said = rows.filter(F.col("opening").isNotNull())
    stats = checkpointed(
        said.groupBy("opening").agg(
            F.count("*").alias("n"),
            F.sum(F.col("grounded").cast("bigint")).alias("n_grounded"),
            F.sum(F.col("declines").cast("bigint")).alias("n_declines"),
        )
    )
    head = F.substring("opening", 1, HEAD)
    free = stats.filter(F.col("n_grounded") <= 0.1 * F.col("n")).filter(F.length("opening") >= HEAD)
    clusters = checkpointed(free.join(opening_clusters(free), "opening"))
    # a task or domain counts once per cluster, however many of its openings have it
    seen = said.join(clusters.select("opening", "cluster"), "opening").select("cluster", "task_id", "domain").distinct()
    counted = lambda c, name: seen.filter(F.col(c).isNotNull()).select("cluster", c).distinct().groupBy("cluster").agg(F.count("*").alias(name))
    heads = stats.groupBy(head.alias("head")).agg((F.sum("n_grounded") / F.sum("n")).alias("led"))
    whole = clusters.join(heads, head == F.col("head")).groupBy("cluster").agg(
        (F.sum("n_declines") / F.sum("n")).alias("declining"),
        F.avg("led").alias("led"),
    )
    whole = whole.join(counted("task_id", "n_tasks"), "cluster", "left").join(counted("domain", "n_domains"), "cluster", "left")
    recurs = (F.coalesce("n_tasks", F.lit(0)) >= RECURS_TASKS) & (F.coalesce("n_domains", F.lit(0)) >= RECURS_DOMAINS)
    # what recurs is judged by recurrence alone; clusters too small for that by what most of their answers say
    kept = whole.filter(F.when(recurs, F.col("led") < 0.5).otherwise(F.col("declining") >= 0.5))
    return clusters.join(kept.select("cluster", recurs.alias("recurs")), "cluster").select("opening", "recurs")


def closings(rows: DataFrame) -> DataFrame:
    """(lang, tail) of the endings that close sentences: those of enough answers that have a full stop."""
    ended = rows.filter("closed AND tail IS NOT NULL AND lang IS NOT NULL")
    per = ended.groupBy("lang").agg(F.count("*").alias("n_lang"))
    return ended.groupBy("lang", "tail").agg(F.count("*").alias("n")).join(F.broadcast(per), "lang").filter((F.col("n") >= CLOSING_LEAST) & (F.col("n") >= CLOSING_SHARE * F.col("n_lang"))).select("lang", "tail")


def defects(predictions: DataFrame, tasks: DataFrame, profiles: Profiles) -> DataFrame:
    """(pred_id, defect) of every defective pair."""
    rows = checkpointed(looks(predictions, tasks, profiles))
    settled = rows.filter("defect IN ('empty', 'copy')").select("pred_id", "defect")
    open_rows = rows.filter("defect IS NULL OR defect = 'other_language'")
    refused = refusal_openings(open_rows).withColumn("refused", F.lit(True))
    ends = closings(open_rows).withColumn("ends", F.lit(True))
    with_task = F.col("domain").isNotNull()
    value_end = F.col("tail").rlike("n$") & F.col("tail").rlike("(^|[^a-z])n$")
    marked = open_rows.join(refused, "opening", "left").join(ends, ["lang", "tail"], "left")
    truncated = with_task & ~F.col("closed") & (F.col("tail").isNull() | F.col("lang").isNull() | F.col("ends").isNull() | (value_end & ~F.col("whole")))
    # a whole answer too short for clustering is a refusal where it declines in so many words
    declined = F.col("declines") & (F.length("opening") < HEAD)
    defect = F.when((F.coalesce("refused", F.lit(False)) | declined) & ~F.col("grounded"), "refusal").when(F.col("defect").isNotNull(), F.col("defect")).when(truncated, "truncated")
    return settled.unionByName(marked.select("pred_id", defect.alias("defect")).filter("defect IS NOT NULL"))
