"""Language labels of answers: missing, wrong and mixed (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldproof.llm.canon import BLANK, fold_form, is_empty
from fieldproof.llm.languages import UNKNOWN, Identifier, Profiles, canonical_lines
from fieldproof.llm.standins import holds_standin, standin_own_udf, task_key, task_own_texts

_SHARED: dict[int, Identifier] = {}


def identifier(profiles: Profiles) -> Identifier:
    """One identifier per process and profiles, so that what it has named is kept between tasks."""
    key = hash(tuple((lang, tuple(order)) for lang, order in sorted(profiles.items())))
    if key not in _SHARED:
        _SHARED[key] = Identifier(profiles)
    return _SHARED[key]


def task_labels(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """(task_id, code): the language each task's label names, null where it names none.

    Copies of a task agree in their label; should they not, the smallest label counts.
    """
    labels = tasks.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("task_id")).agg(F.min("expected_answer_language").alias("label"))
    return labels.join(F.broadcast(names.select("label", "code").dropDuplicates(["label"])), "label", "left").select("task_id", "code")


def answer_languages(predictions: DataFrame, profiles: Profiles) -> DataFrame:
    """(pred_id, task_id, langs, confidences, suspect): suspect is the answer where it may be a stand-in.

    Empty answers and those without running words are left out. Only these few columns go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = identifier(profiles)

        def looked(text: str) -> tuple[dict, bool]:
            lines = canonical_lines(text)
            form = BLANK.sub(" ", lines)
            return own.form_languages(lines), holds_standin(form, fold_form(form))

        for b in batches:
            seen: dict = {}
            for text in b["answer"]:
                if text not in seen:
                    seen[text] = None if is_empty(text) else looked(text)
            rows = [(p, t, list(found[0]), [c for _, c in found[0].values()], a if found[1] else None) for p, t, a in zip(b["pred_id"], b["task_id"], b["answer"]) if (found := seen[a]) and found[0]]
            if rows:
                yield pd.DataFrame(rows, columns=["pred_id", "task_id", "langs", "confidences", "suspect"])

    picked = predictions.filter(F.col("answer").isNotNull()).select("pred_id", task_key().alias("task_id"), "answer")
    return picked.mapInPandas(run, "pred_id bigint, task_id string, langs array<string>, confidences array<double>, suspect string")


def mislabelled(predictions: DataFrame, tasks: DataFrame, names: DataFrame, profiles: Profiles) -> DataFrame:
    """(pred_id, lang): the languages of each answer that isn't just in the language its task's label names."""
    found = answer_languages(predictions.filter(task_key().isNotNull()), profiles).join(task_labels(tasks, names), "task_id")
    wrong = found.filter((F.size("langs") > 1) | F.col("code").isNull() | (F.col("langs")[0] != F.col("code")))
    checked = wrong.join(task_own_texts(tasks), "task_id", "left").filter(F.col("suspect").isNull() | (F.col("own").isNotNull() & ~standin_own_udf("suspect", "own")))
    return checked.select("pred_id", F.explode("langs").alias("lang"))


def main_languages(predictions: DataFrame, profiles: Profiles) -> DataFrame:
    """(pred_id, lang, confidence, n_langs) of every answer; lang has the largest part.

    Null and empty answers, and those without running words of a known language, are `und` with
    confidence 0 and no languages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = identifier(profiles)
        for b in batches:
            seen: dict = {None: (UNKNOWN, 0.0, 0)}
            for text in b["answer"]:
                if text not in seen:
                    found = own.languages(text)
                    lang = next(iter(found), UNKNOWN)
                    seen[text] = (lang, found[lang][1] if found else 0.0, len(found))
            yield pd.DataFrame([(p, *seen[a]) for p, a in zip(b["pred_id"], b["answer"])], columns=["pred_id", "lang", "confidence", "n_langs"])

    return predictions.select("pred_id", "answer").mapInPandas(run, "pred_id bigint, lang string, confidence double, n_langs int")


def language_segments(predictions: DataFrame, profiles: Profiles) -> DataFrame:
    """(pred_id, seg, start, end, lang, confidence) of every stretch of running words.

    Places are code points in the consistent form of the answer (its line ends kept).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = identifier(profiles)
        for b in batches:
            rows = []
            for pred, text in zip(b["pred_id"], b["answer"]):
                rows += [(pred, i, s.start, s.end, s.lang, s.confidence) for i, s in enumerate(own.stretches(canonical_lines(text)))]
            if rows:
                yield pd.DataFrame(rows, columns=["pred_id", "seg", "start", "end", "lang", "confidence"])

    picked = predictions.filter(F.col("answer").isNotNull()).select("pred_id", "answer")
    return picked.mapInPandas(run, "pred_id bigint, seg int, start int, end int, lang string, confidence double")
