"""Reading level of each English text, by a familiar-word formula.

A text is the harder, the more of its words lie outside lists of familiar words and the longer its sentences are. The lists come
from document frequencies over the whole corpus: in how many texts of each estimated level a word occurs tells at which level it
is familiar. The first estimate rests on sentence length alone; each further one on the lists of the one before. The formula's
coefficients are fitted to a bounded sample of rated texts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliome.llm.words import document_frequencies, is_english, words_and_lengths

LEVELS = 5
#: Ratings the coefficients are fitted to, at most; every text is scored.
SAMPLE = 6_000
#: Fewest words (by white space) of a text that is given a level.
MIN_WORDS = 40
#: A word is outside a list if the level it is familiar at exceeds the list's.
_LISTS = (1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0, 4.25)
#: A word in fewer texts, or in a smaller share of them, is on no list.
_FEWEST, _SHARE = 5, 2e-5


#: The words of a text and the lengths of its sentences.
Text = tuple[list[str], list[int]]


@dataclass(frozen=True)
class Formula:
    """Lists (word -> level at which it is familiar), coefficients, and the scores at which levels part."""

    familiar: dict[str, float] | None
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def features(self, text: Text) -> list[float]:
        words, lengths = text
        lengths = lengths or [len(words)]
        mid, mean = float(median(lengths)), sum(lengths) / len(lengths)
        out = [1.0, min(mid, 60.0), math.log(mid), math.log(mean)]
        if self.familiar is not None:
            at = sorted(a for a in map(self.familiar.get, words) if a is not None)
            n = max(1, len(words))
            # a word on no list is outside each of them
            out += [(len(words) - bisect_right(at, c)) / n for c in _LISTS] + [sum(at) / max(1, len(at)), len(at) / n]
        return out

    def level(self, text: Text) -> int:
        score = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 + sum(score > c for c in self.cuts)


def eligible(text: str | None) -> Text | None:
    """The words and sentence lengths of an English text that is long enough, else None."""
    if text is None or len(text.split(None, MIN_WORDS)) < MIN_WORDS:
        return None
    read = words_and_lengths(text)
    return read if is_english(read[0]) else None


def _cuts(score: np.ndarray, level: np.ndarray) -> tuple[float, ...]:
    """The four scores that part levels best: each as close to its half-way point as the ratings allow."""
    out = []
    for k in range(1, LEVELS):
        grid = np.arange(k + 0.2, k + 0.81, 0.05)
        near = (level == k) | (level == k + 1)
        right = [((score[near] > g) == (level[near] > k)).mean() if near.any() else 0.0 for g in grid]
        best = max(right)
        good = grid[[r >= best - 0.004 for r in right]]
        out.append(float(good[np.abs(good - (k + 0.5)).argmin()]))
    return tuple(out)


def _fit(formula: Formula, rated: Sequence[tuple[Text, float, str]]) -> Formula:
    """Coefficients by ridge regression on rated texts, with an offset for each rater who rated enough of them."""
    x = np.array([formula.features(t) for t, _, _ in rated])
    y = np.array([v for _, v, _ in rated])
    raters = [r for r in sorted({r for *_, r in rated}) if sum(q == r for *_, q in rated) >= 30][1:]
    z = np.hstack([x, np.array([[float(q == r) for r in raters] for *_, q in rated]).reshape(len(y), len(raters))])
    scale = np.maximum(z.std(0), 1e-9)
    scale[0] = 1.0
    penalty = np.full(z.shape[1], 1e-3 * len(y))
    penalty[0] = 0.0
    penalty[x.shape[1] :] = 1e-6
    a = z / scale
    b = np.linalg.solve(a.T @ a + np.diag(penalty + 1e-9), a.T @ y) / scale
    offsets = sorted([0.0, *b[x.shape[1] :]])
    weights = b[: x.shape[1]].copy()
    weights[0] += offsets[len(offsets) // 2] if offsets else 0.0
    return Formula(formula.familiar, tuple(weights), _cuts(x @ weights, y))


def _lists(docs: Sequence[int], counts: dict[str, list[int]]) -> dict[str, float]:
    """The level at which each word is familiar: the mean level of its texts, levels counting alike."""
    out = {}
    for w, c in counts.items():
        if sum(c) >= _FEWEST:
            rate = [(k + 0.5) / (n + 1) for k, n in zip(c, docs, strict=True)]
            out[w] = sum(r * (i + 1) for i, r in enumerate(rate)) / sum(rate)
    return out


def fitted(documents: DataFrame, labels: DataFrame, *, rounds: int = 2) -> Formula:
    rated_rows = labels.where("reading_level IS NOT NULL").orderBy(F.xxhash64("doc_id", "rater"), "doc_id", "rater").limit(SAMPLE)
    joined = documents.select("doc_id", "text").join(rated_rows.select("doc_id", "reading_level", "rater"), "doc_id").toArrow().to_pylist()
    joined.sort(key=lambda r: (r["doc_id"], r["rater"] or ""))
    rated = [(t, float(r["reading_level"]), r["rater"] or "") for r in joined if (t := eligible(r["text"])) is not None]
    start = Formula(None, (0.5, 0.05, 0.5, 0.3), (1.5, 2.5, 3.5, 4.5))
    formula = _fit(start, rated) if len(rated) >= 20 else start
    for _ in range(rounds):
        docs, counts = document_frequencies(documents, "text", _grouper(formula), LEVELS, fewest=_FEWEST, share=_SHARE)
        lists = Formula(_lists(docs, counts), (), ())
        if len(rated) >= 20:
            formula = _fit(lists, rated)
    return formula


def _grouper(formula: Formula) -> Callable[[str], tuple[list[str], int | None]]:
    def group(text: str) -> tuple[list[str], int | None]:
        read = eligible(text)
        return ([], None) if read is None else (read[0], formula.level(read) - 1)

    return group


def reading_levels(documents: DataFrame, labels: DataFrame, *, rounds: int = 2) -> DataFrame:
    """(doc_id, reading_level): 1 (easiest) to 5, for every text in English of 40 or more words, whatever its lang says.

    Null, empty, short and foreign texts give no row; repeated texts get the same level. With fewer than 20 usable ratings
    levels rest on sentence length and a fixed formula.
    """
    formula = fitted(documents, labels, rounds=rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, levels = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                read = eligible(text)
                if read is not None:
                    ids.append(i)
                    levels.append(formula.level(read))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels, pa.int32())], ["doc_id", "reading_level"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, reading_level int")


def level_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_kind, reading_level, texts, mean_chars): the corpus by kind and level."""
    levels = reading_levels(documents, labels)
    return (
        documents.select("doc_id", "doc_kind", F.length("text").alias("chars")).join(levels, "doc_id")
        .groupBy("doc_kind", "reading_level").agg(F.count("*").alias("texts"), F.round(F.avg("chars"), 2).alias("mean_chars"))
    )
