"""Containers of fixed capacity filled with texts that belong together, by lexical retrieval.

Texts are put in order by a weighted min-hash of their words, so that texts that share rare words stand together, and are cut into
shards of bounded size; each shard builds an inverted index of BM25 weights. The longest unused text seeds a window, the index
returns its unused neighbours, and the best ones that fit fill the window; what is left of it takes the largest unused texts
that still fit.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliome.llm.tokens import TOKENIZERS, automaton
from bibliome.llm.words import words_of
from bibliome.session import cut_lineage

#: Items of a shard.
SHARD = 2000
#: Words of a seed its neighbours are looked up by, the weightiest first.
QUERY_WORDS = 48
#: Words in a smaller share of the texts count as equally rare.
RARE = 5e-5
_K1, _B = 1.2, 0.75


def fill(sizes: Sequence[int], terms: Sequence[Mapping[str, int]], weight: Mapping[str, float], rare: float, mean: float, capacity: int) -> list[list[int]]:
    """Containers (lists of item numbers) of one shard; every item is in exactly one, and none holds more than the capacity."""
    n = len(sizes)
    size = np.array(sizes, np.int64)
    length = np.array([sum(c.values()) for c in terms], float)
    norm = _K1 * (1 - _B + _B * length / max(mean, 1.0))
    number: dict[str, int] = {}
    word = np.array([number.setdefault(w, len(number)) for c in terms for w in c], np.int64)
    item = np.repeat(np.arange(n), [len(c) for c in terms])
    times = np.array([t for c in terms for t in c.values()], float)
    heavy = np.array([weight.get(w, rare) for w in number])
    worth = heavy[word] * times * (_K1 + 1) / (times + norm[item]) if len(word) else times
    order = np.argsort(word, kind="stable")
    start = np.searchsorted(word[order], np.arange(len(number) + 1))
    posted, worth = item[order], worth[order]
    first = np.searchsorted(item, np.arange(n + 1))
    unused = np.ones(n, bool)
    by_size = sorted((sizes[i], -i) for i in range(n))
    out = []

    def take(i: int) -> int:
        unused[i] = False
        del by_size[bisect_right(by_size, (sizes[i], -i)) - 1]
        return sizes[i]

    for seed in sorted(range(n), key=lambda i: (-sizes[i], i)):
        if not unused[seed]:
            continue
        box, room = [seed], capacity - take(seed)
        if room and by_size and by_size[0][0] <= room:
            asked = word[first[seed] : first[seed + 1]]
            asked = asked[start[asked + 1] - start[asked] > 1]
            asked = asked[np.argsort(-heavy[asked], kind="stable")[:QUERY_WORDS]]
            spans = [slice(start[w], start[w + 1]) for w in asked]
            score = np.bincount(np.concatenate([posted[s] for s in spans]), np.concatenate([worth[s] for s in spans]), n) if spans else np.zeros(n)
            near = np.flatnonzero((score > 0) & unused & (size <= room))
            near = near[np.lexsort((near, -score[near]))]
            while len(near):
                box.append(int(near[0]))
                room -= take(int(near[0]))
                near = near[1:][size[near[1:]] <= room]
            while room and by_size:
                at = bisect_right(by_size, (room, 1)) - 1
                if at < 0:
                    break
                i = -by_size[at][1]
                box.append(i)
                room -= take(i)
        out.append(box)
    return out


def draws(weight: Mapping[str, float]) -> dict[str, float]:
    """What a weighted min-hash draws for each word: the heavier the word, the smaller, as a rule."""
    return {w: -math.log((zlib.crc32(w.encode("utf-8", "replace")) + 1) / 4294967297) / x for w, x in weight.items()}


def route(terms: Sequence[str], drawn: Mapping[str, float]) -> tuple[str, str]:
    """The two words of a text that draw least (of those the corpus weighs); texts share the first as often as their weighted
    words overlap."""
    best, second, first, other = math.inf, math.inf, "", ""
    for w in terms:
        x = drawn.get(w)
        if x is not None and x < second:
            if x < best:
                best, second, first, other = x, best, w, first
            else:
                second, other = x, w
    return first, other


def items_of(df: DataFrame, id_col: str, text_col: str, capacity: int, file: str) -> DataFrame:
    """(doc_id, piece, first_token, last_token, terms, times): texts cut where they exceed the capacity; terms and times are the
    words of what is to be packed with others, null for full containers."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(file)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = a.encode(t) if t else []
                n, full = len(ids), len(ids) // capacity
                out += [(i, k, k * capacity, (k + 1) * capacity, None, None) for k in range(full)]
                if n % capacity or not n:
                    words = Counter(words_of(t if not full else a.decode(ids[full * capacity :]))) if n else {}
                    out.append((i, full, full * capacity, n, list(words), list(words.values())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "first_token", "last_token", "terms", "times"])

    schema = "doc_id bigint, piece int, first_token bigint, last_token bigint, terms array<string>, times array<int>"
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def word_weights(items: DataFrame) -> tuple[dict[str, float], float, float]:
    """(weight by word, weight of all rarer words, mean words of a text): over all texts. Words in less than RARE of the texts
    aren't named, which bounds the names by the words of a text over RARE."""
    live = items.where("size(terms) > 0")
    n, mean = live.agg(F.count("*"), F.avg(F.aggregate("times", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    least = max(2.0, RARE * n)
    counts = live.select(F.explode("terms").alias("w")).groupBy("w").count().where(F.col("count") >= least).toArrow()
    idf = lambda c: math.log(1 + (n - c + 0.5) / (c + 0.5))
    return {w: idf(c) for w, c in zip(counts["w"].to_pylist(), counts["count"].to_pylist(), strict=True)}, idf(min(least, n)), mean or 0.0


def packed(df: DataFrame, id_col: str, text_col: str, *, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(container, place, doc_id, piece, first_token, last_token): where every text's tokens go.

    first_token and last_token are a half-open range of the text's token places. A text longer than the capacity is cut into
    full containers and a remainder, which is packed like any other; no other text is divided. A text without tokens (null or
    empty) has an empty range and takes no room. Document frequencies are those of all texts. Repeated rows are packed each.
    """
    items = cut_lineage(items_of(df, id_col, text_col, capacity, f"{path}/{tokenizer}.json"))
    weight, rare, mean = word_weights(items)
    drawn = draws(weight)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [route(t, drawn) if t else ("", "") for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k for k, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.string())], [*b.schema.names, "k1", "k2"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for b in batches:
            for s in range(0, b.num_rows, SHARD):
                held.append(b.slice(s, SHARD))
                while sum(x.num_rows for x in held) >= SHARD:
                    t = pa.Table.from_batches(held)
                    out, number = _boxed(t.slice(0, SHARD), number, weight, rare, mean, capacity)
                    yield out
                    held = t.slice(SHARD).to_batches()
        if held:
            yield _boxed(pa.Table.from_batches(held), number, weight, rare, mean, capacity)[0]

    with_keys = items.mapInArrow(routed, "doc_id bigint, piece int, first_token bigint, last_token bigint, terms array<string>, times array<int>, k1 string, k2 string")
    order = ["k1", "k2", F.xxhash64("doc_id", "piece"), "doc_id", "piece"]
    together = with_keys.repartitionByRange(*order).sortWithinPartitions(*order)
    return together.mapInArrow(pack, "container bigint, place int, doc_id bigint, piece int, first_token bigint, last_token bigint")


def _boxed(t: pa.Table, number: int, weight: Mapping[str, float], rare: float, mean: float, capacity: int) -> tuple[pa.RecordBatch, int]:
    """The containers of one shard, numbered from `number` on, and the next number."""
    first, last, terms, times = (t[c].to_pylist() for c in ("first_token", "last_token", "terms", "times"))
    sizes = [e - s for s, e in zip(first, last, strict=True)]
    boxes = [[i] for i, w in enumerate(terms) if w is None]
    loose = [i for i, w in enumerate(terms) if w is not None and sizes[i]]
    blank = [i for i, w in enumerate(terms) if w is not None and not sizes[i]]
    words = [dict(zip(terms[i], times[i], strict=True)) for i in loose]
    boxes += [[loose[i] for i in box] for box in fill([sizes[i] for i in loose], words, weight, rare, mean, capacity)]
    if blank:
        boxes = boxes or [[]]
        boxes[-1] = boxes[-1] + blank
    at = [(number + b, p, i) for b, box in enumerate(boxes) for p, i in enumerate(box)]
    rows = pa.array([i for _, _, i in at], pa.int64())
    flat = [t[c].combine_chunks().take(rows) for c in ("doc_id", "piece", "first_token", "last_token")]
    cols = [pa.array([c for c, _, _ in at], pa.int64()), pa.array([p for _, p, _ in at], pa.int32()), *flat]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["container", "place", "doc_id", "piece", "first_token", "last_token"]), number + len(boxes)


def packing_summary(boxes: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of the room that is used."""
    per = boxes.groupBy("container").agg(F.sum(F.col("last_token") - F.col("first_token")).alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 4).alias("used_share"))
