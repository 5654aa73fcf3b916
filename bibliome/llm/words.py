"""Words and sentences of a text, and document frequencies over a whole corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliome.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TAG, _URL = re.compile(r"<[^<>]{1,60}>"), re.compile(r"https?://\S+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)\]]*\s+|\n+")
#: Frequent function words of English.
ENGLISH = frozenset("the of and in to a that is are was were we with for from by this".split())
#: Distinct words a partition counts before it hands its counts on.
_FLUSH = 200_000


def _bare(text: str) -> str:
    """Without tags and addresses of pages."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _URL.sub(" ", text) if "http" in text else text


def words_of(text: str) -> list[str]:
    return WORD.findall(_bare(text).lower())


def words_and_lengths(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and how many each sentence or line has; what has fewer than two isn't a sentence."""
    words: list[str] = []
    lengths = []
    for s in _SENTENCE.split(_bare(text).lower()):
        found = WORD.findall(s)
        words += found
        if len(found) > 1:
            lengths.append(len(found))
    return words, lengths


def sentence_lengths(text: str) -> list[int]:
    return words_and_lengths(text)[1]


def is_english(words: Sequence[str], share: float = 0.1) -> bool:
    return bool(words) and sum(w in ENGLISH for w in words) >= share * len(words)


def document_frequencies(
    df: DataFrame, text_col: str, group_of: Callable[[str], tuple[Iterable[str], int | None]], groups: int, *, fewest: int = 1, share: float = 0.0, most: int | None = None
) -> tuple[list[int], dict[str, list[int]]]:
    """How many documents there are of each group, and in how many of them each word occurs that is in at least `fewest` documents
    and in at least a `share` of all.

    Every document counts; group_of(text) gives its words and its group, or None to leave it out. Counting happens where the texts
    are; words are summed before they are shuffled. A share bounds what reaches the driver by the words of a text over it, whatever
    the size of the corpus; `most` keeps only those in most documents.
    """
    names = [f"g{i}" for i in range(groups)]
    schema = "word string, " + ", ".join(f"{n} bigint" for n in names)

    def batch(counts: list[Counter], docs: list[int]) -> pa.RecordBatch:
        vocabulary = sorted(set().union(*counts))
        cols = [pa.array([*vocabulary, None], pa.string())] + [pa.array([*(c[w] for w in vocabulary), docs[i]], pa.int64()) for i, c in enumerate(counts)]
        return pa.RecordBatch.from_arrays(cols, ["word", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = [Counter() for _ in range(groups)], [0] * groups
        for b in batches:
            for text in b.column(0).to_pylist():
                if text is None:
                    continue
                words, at = group_of(text)
                if at is not None:
                    counts[at].update(set(words))
                    docs[at] += 1
            if sum(map(len, counts)) > _FLUSH:
                yield batch(counts, docs)
                counts, docs = [Counter() for _ in range(groups)], [0] * groups
        yield batch(counts, docs)

    summed = df.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    summed = cut_lineage(summed)
    first = summed.where("word IS NULL").first()
    docs = [first[n] or 0 for n in names] if first else [0] * groups
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    often = summed.where(F.col("word").isNotNull() & (total >= max(float(fewest), share * sum(docs))))
    if most is not None:
        often = often.orderBy(F.desc(total), "word").limit(most)
    got = often.toArrow()
    return docs, {w: list(n) for w, *n in zip(*(got[c].to_pylist() for c in ("word", *names)), strict=True)}
