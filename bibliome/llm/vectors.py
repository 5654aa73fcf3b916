"""Most similar vectors for every vector, by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional residual codebooks; codes are found by beam search.
The first codebooks' codewords together name inverted lists, and every row goes to as many of its nearest lists as measured
recall asks for: the true neighbours of a bounded set of rows are found by comparing those with all rows, and lists are added
until enough of these neighbours share one. Within a list, rows are scored from lookup tables of vector-codeword products and
stored norms, and what scores high enough is ranked again by its exact cosine. The rows of crowded lists are quantised anew by
codebooks of their own; what is still crowded after that is compared whole, block by block.

Exact copies are searched once and share what was found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions.vectors import cosine
from bibliome.session import cut_lineage

#: Rows codebooks are trained on, about, and twice as many at most; every row is indexed.
SAMPLE = 8192
#: Rows whose true neighbours are found by comparing them with all rows, about, and twice as many at most.
MEASURED = 512
#: Aimed-at rows of a list, before each row is put into several.
CELL_ROWS = 1000
#: A list with more rows than this is quantised anew, and at last compared in blocks of this size.
BLOCK_ROWS = 32768
#: Lists a row goes to, at most; crowded lists are quantised anew at most so often.
MOST_LISTS, MOST_TIERS = 16, 3
#: Codewords of a codebook that names lists, at most; beyond, a further codebook is added.
_WORDS = 1024
#: Numbers a beam search holds at a time.
_ROOM = 4_000_000
#: Pairs a row leaves in, on average, above which they are many.
_MANY = 64
#: Rows beyond k that a search ranks by the vectors themselves, since 16-bit ones may turn neighbours round.
SPARE = 3
#: More than products of 32-bit unit vectors can be wrong.
SLACK = 1e-5

Books = tuple[np.ndarray, ...]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def _means(x: np.ndarray, at: np.ndarray, old: np.ndarray) -> np.ndarray:
    n = np.bincount(at, minlength=len(old))
    sums = np.zeros_like(old)
    np.add.at(sums, at, x)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old).astype(np.float32)


def beam(x: np.ndarray, books: Sequence[np.ndarray], width: int, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes rows x width x books, costs) of the best sums of one codeword per book, the best first.

    Costs are squared distances less the row's squared norm. Each book adds to the best sums of the books before it, so a row
    costs books x width x codewords, however many sums there are. `start` goes on from what the first books gave.
    """
    done = 0 if start is None else start[0].shape[2]
    cross = [[2 * (p @ c.T) for p in books[:i]] for i, c in enumerate(books)]
    squares = [(c * c).sum(1) for c in books]
    step = max(1, _ROOM // (width * max(len(c) for c in books)))
    parts = []
    for s in range(0, len(x), step):
        y = x[s : s + step]
        n = len(y)
        codes, cost = (np.zeros((n, 1, 0), np.int32), np.zeros((n, 1), np.float32)) if start is None else (start[0][s : s + step], start[1][s : s + step])
        for i in range(done, len(books)):
            c = books[i]
            total = cost[:, :, None] + (squares[i] - 2 * (y @ c.T))[:, None, :]
            for j in range(i):
                total += cross[i][j][codes[:, :, j]]
            flat = total.reshape(n, -1)
            keep = min(width, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // len(c))[:, :, None], 1), (best % len(c))[:, :, None].astype(np.int32)], axis=2)
        order = np.argsort(cost, axis=1, kind="stable")
        parts.append((np.take_along_axis(codes, order[:, :, None], 1), np.take_along_axis(cost, order, 1)))
    if not parts:
        return np.zeros((0, 1, len(books)), np.int32), np.zeros((0, 1), np.float32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def coarse_books(x: np.ndarray, rows: int, seed: int = 7, rounds: int = 8) -> Books:
    """The codebooks that name the lists of so many rows, fitted jointly on a sample: sums are chosen anew, then each codeword is
    the mean of what the other books leave over."""
    rng = np.random.default_rng(seed)
    cells = max(1.0, rows / CELL_ROWS)
    levels = max(2, math.ceil(math.log(cells) / math.log(_WORDS)))
    k = max(2, math.ceil(cells ** (1 / levels)))
    books, rest = [], x
    for _ in range(levels):
        c = _kmeans(rest, k, rng)
        rest = rest - c[_nearest(rest, c)]
        books.append(c)
    for _ in range(rounds):
        code = beam(x, books, 16)[0][:, 0]
        for i in range(levels):
            others = sum(books[j][code[:, j]] for j in range(levels) if j != i)
            books[i] = _means(x - others, code[:, i], books[i])
    return tuple(books)


def fine_books(x: np.ndarray, coarse: Books, many: int, seed: int = 7) -> Books:
    """Residual codebooks for what the coarse ones leave over."""
    rng = np.random.default_rng(seed)
    code = beam(x, coarse, 16)[0][:, 0]
    rest = x - sum(c[code[:, i]] for i, c in enumerate(coarse))
    out = []
    for _ in range(many):
        c = _kmeans(rest, min(256, max(4, len(x) // 8)), rng)
        rest = rest - c[_nearest(rest, c)]
        out.append(c)
    return tuple(out)


@dataclass(frozen=True)
class Tier:
    """Codebooks that name lists, how many lists a row goes to, and which lists are crowded (their rows go to the next tier)."""

    books: Books
    lists: int
    crowded: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass(frozen=True)
class Index:
    """tiers name lists; books, coarse and fine, make codes; least is the score that all but 0.1 % of the true neighbours seen have; blocks
    says of lists that are too long how many blocks they are compared in."""

    tiers: tuple[Tier, ...]
    books: Books
    least: float
    blocks: dict[int, int]


def cells_of(x: np.ndarray, books: Books, many: int) -> np.ndarray:
    """The lists nearest to each vector, the nearest first."""
    codes = beam(x, books, max(16, 2 * many))[0][:, :many]
    cell = np.zeros(codes.shape[:2], np.int64)
    for i, c in enumerate(books):
        cell = cell * len(c) + codes[:, :, i]
    return cell


def keys_of(x: np.ndarray, tiers: Sequence[Tier], many: Callable[[Tier], int] = lambda t: t.lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every list a row goes to: rows of crowded lists go to lists of the next tier instead."""
    rows, keys, left = [], [], np.arange(len(x))
    for t, tier in enumerate(tiers):
        near = cells_of(x[left], tier.books, many(tier)) + (t << 58)
        full = np.isin(near, tier.crowded) if len(tier.crowded) and t + 1 < len(tiers) else np.zeros(near.shape, bool)
        at, _ = np.nonzero(~full)
        rows.append(left[at])
        keys.append(near[~full])
        left = left[full.any(1)]
        if not len(left):
            break
    return np.concatenate(rows), np.concatenate(keys)


def encode(x: np.ndarray, books: Books, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the squared norms of what they stand for."""
    codes = beam(x, books, width)[0][:, 0]
    made = sum(c[codes[:, i]] for i, c in enumerate(books))
    return codes.astype(np.uint16), (made * made).sum(1).astype(np.float32)


def tables(q: np.ndarray, books: Books) -> list[np.ndarray]:
    """Products of each query with every codeword."""
    return [q @ c.T for c in books]


def scores(lookup: list[np.ndarray], codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Queries x rows, the greater the nearer: sums of table entries less half the stored norms."""
    total = np.take(lookup[0], codes[:, 0], axis=1)
    for m in range(1, codes.shape[1]):
        total += np.take(lookup[m], codes[:, m], axis=1)
    total -= np.float32(0.5) * norms
    return total


def unit(ints: np.ndarray) -> np.ndarray:
    x = ints.astype(np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _ints(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dim)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of dim finite elements, not all zero, as 16-bit integers scaled to the greatest element, so that
    vectors of one direction become equal whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0))
            at = np.flatnonzero(size == dim)
            if not len(at):
                continue
            x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            with np.errstate(all="ignore"):
                ints = np.rint(x[good] / top[good, None] * 32767).astype("<i2")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[good])).cast(pa.int64()), pa.array([r.tobytes() for r in ints], pa.binary())], ["id", "v"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("v is not null and id is not null").mapInArrow(run, "id bigint, v binary")


def _drawn(reps: DataFrame, rows: int, many: int, dim: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whole-number vectors) of about so many rows, those whose hash falls low; at most twice as many."""
    low = max(1, int(min(1.0, many / max(rows, 1)) * (1 << 30)))
    got = reps.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < low).select("id", "v").limit(2 * many).toArrow()
    return got["id"].to_numpy(), _ints(got["v"], dim)


def true_neighbours(reps: DataFrame, ids: np.ndarray, x: np.ndarray, dim: int, k: int, min_sim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, found, place of asked): unit vectors of the given rows and of their k best others among all, by comparing with all."""
    asked = unit(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, i, c = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32)
        for big in batches:
            for s in range(0, big.num_rows, 4096):
                part = big.slice(s, 4096)
                own = part.column(0).to_numpy()
                near = asked @ unit(_ints(part.column(1), dim)).T
                near[ids[:, None] == own[None]] = -2
                few = min(k, len(own))
                best = np.argpartition(-near, few - 1, axis=1)[:, :few]
                sim = np.take_along_axis(near, best, 1)
                a, b = np.nonzero(sim >= min_sim)
                q, i, c = np.r_[q, a.astype(np.int32)], np.r_[i, own[best[a, b]]], np.r_[c, sim[a, b]]
            q, i, c = _best(q, i, c, k)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(c, pa.float32())], ["q", "id", "cos"])

    met = reps.select("id", "v").mapInArrow(run, "q int, id bigint, cos float")
    best = met.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("less"), "id"))), 1, k).alias("l"))
    pairs = best.select("q", F.explode("l.id").alias("id")).toArrow()  # at most k rows for each row asked
    known = reps.join(F.broadcast(reps.sparkSession.createDataFrame([(int(i),) for i in set(pairs["id"].to_pylist())], "id bigint")), "id").select("id", "v").toArrow()
    place = {i: n for n, i in enumerate(known["id"].to_pylist())}
    at = np.array([place[i] for i in pairs["id"].to_pylist()], np.int64)
    q = pairs["q"].to_numpy().astype(np.int64)
    return asked[q], unit(_ints(known["v"], dim))[at] if len(at) else np.zeros((0, dim), np.float32), q


def _best(q: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each q, ties to the smaller id."""
    order = np.lexsort((ids, -cos, q))
    q, ids, cos = q[order], ids[order], cos[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
    return q[keep], ids[keep], cos[keep]


def lists_for(a: np.ndarray, b: np.ndarray, books: Books, recall: float, *, single: bool) -> int:
    """To how many lists a row must go, that so many of the given pairs share one; with `single`, b's rows are in one list each."""
    if not len(a):
        return 4
    most = min(MOST_LISTS * (8 if single else 1), math.prod(map(len, books)))
    ca, cb = cells_of(a, books, most), cells_of(b, books, 1 if single else most)
    same = ca[:, :, None] == cb[:, None, :]
    place = np.maximum(np.arange(ca.shape[1])[:, None], np.zeros(1, int) if single else np.arange(cb.shape[1])[None])
    needed = np.sort(np.where(same, place + 1, most).min(axis=(1, 2)))
    return max(2, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]))


def built(reps: DataFrame, rows: int, *, dim: int, k: int, min_sim: float, recall: float, fine: int, single: bool) -> Index:
    """The index of reps(id, v): trained on about SAMPLE rows, list numbers from the neighbours of about MEASURED rows.

    `single`: rows are in one list each and only the searching row goes to several. A recall of 1, or rows for two lists at most, make
    one list, whose rows are all compared.
    """
    _, x = _drawn(reps, rows, SAMPLE, dim, 1)
    x = unit(x) if len(x) else unit(_drawn(reps, 1, 64, dim, 1)[1])
    coarse = coarse_books(x, rows)
    books = (*coarse, *fine_books(x, coarse, fine))
    ids, asked = _drawn(reps, rows, MEASURED, dim, 2)
    a, b, _ = true_neighbours(reps, ids, asked, dim, k, min_sim) if len(ids) else (x[:0], x[:0], None)
    codes, norms = encode(np.concatenate([a, b]), books)
    made = sum(c[codes[:, i]] for i, c in enumerate(books))
    seen = np.r_[(a * made[len(a) :]).sum(1) - 0.5 * norms[len(a) :], (b * made[: len(a)]).sum(1) - 0.5 * norms[: len(a)]]
    least = float(np.quantile(seen, 0.001)) if len(seen) >= 200 and min_sim > -1 else -np.inf
    if recall >= 1 or rows <= 2 * CELL_ROWS:
        return Index((), books, -np.inf, {0: math.ceil(rows / BLOCK_ROWS)} if rows > BLOCK_ROWS else {})
    tiers = [Tier(coarse, lists_for(a, b, coarse, recall, single=single))]
    while True:
        held = tuple(tiers)
        store = (lambda t: 1) if single else (lambda t: t.lists)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                keys, n = np.unique(keys_of(unit(_ints(big.column(0), dim)), held, store)[1], return_counts=True)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        long = reps.select("v").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK_ROWS)
        sizes = {r.key: r.n for r in long.collect()}  # at most rows x lists / BLOCK_ROWS
        t = len(tiers) - 1
        here = {key: n for key, n in sizes.items() if key >> 58 == t}
        if not here or len(tiers) == MOST_TIERS:
            return Index(held, books, least, {key: math.ceil(n / BLOCK_ROWS) for key, n in sizes.items()})
        crowded = np.array(sorted(here), np.int64)

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                row, key = keys_of(unit(_ints(big.column(1), dim)), held, store)  # noqa: B023
                at = pa.array(np.unique(row[np.isin(key, crowded)]))  # noqa: B023
                yield pa.RecordBatch.from_arrays([big.column(0).take(at), big.column(1).take(at)], ["id", "v"])

        n = int(sum(here.values()) / store(tiers[-1]))
        hot = unit(_drawn(reps.mapInArrow(inside, "id bigint, v binary"), n, SAMPLE, dim, 3)[1])
        if not len(hot):
            return Index(held, books, least, {key: math.ceil(n / BLOCK_ROWS) for key, n in sizes.items()})
        again = coarse_books(hot, n)
        met = np.zeros(len(a), bool)
        for side in (a, b):
            row, key = keys_of(side, held)
            met[row[np.isin(key, crowded)]] = True
        tiers[-1] = Tier(tiers[-1].books, tiers[-1].lists, crowded)
        tiers.append(Tier(again, lists_for(a[met], b[met], again, recall, single=single)))


def _neighbours(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, index: Index, left: int, k: int, min_sim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row's place, other's id, cosine): every row's k best others, where the first `left` rows meet the rest; with no rest they
    meet each other.

    Lookup tables leave out pairs that score less than true neighbours were seen to; where they leave in many, as among rows
    that are all alike, products of 32-bit unit vectors leave out what surely isn't among a row's k best (they are right to within
    SLACK). What is left is ranked by the exact cosine, however much it is.
    """
    u, exact = unit(x), x.astype(np.float64)
    length = np.sqrt((exact * exact).sum(1))
    alone = left == len(x)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    floor = np.full(len(x), min_sim - SLACK, np.float32)  # a row's k-th best so far, less SLACK
    for s in range(0, left, 256):
        e = min(s + 256, left)
        at = s if alone else left
        hit = None
        if not np.isneginf(index.least):
            near = scores(tables(u[s:e], index.books), codes[at:], norms[at:])
            hit = near >= index.least
        if hit is None or np.count_nonzero(hit) > _MANY * (e - s):
            near = u[s:e] @ u[at:].T
            if alone:
                near[np.tril_indices(e - s)] = -np.inf
            hit = near >= min_sim - SLACK
            if np.count_nonzero(hit) > _MANY * (e - s):
                if near.shape[1] > k:
                    floor[s:e] = np.maximum(floor[s:e], np.partition(near, -k, axis=1)[:, -k] - SLACK)
                if e - s > k:
                    floor[at:] = np.maximum(floor[at:], np.partition(near, -k, axis=0)[-k] - SLACK)
                hit &= (near >= floor[s:e, None]) | (near >= floor[at:])
        elif alone:
            hit[np.tril_indices(e - s)] = False
        q, d = np.nonzero(hit)
        q, d = q + s, d + at
        cos = np.concatenate([np.einsum("pd,pd->p", exact[q[t : t + 8192]], exact[d[t : t + 8192]]) for t in range(0, len(q), 8192)] or [np.zeros(0)]) / (length[q] * length[d])
        ok = cos >= min_sim
        q, d, cos = q[ok], d[ok], cos[ok]
        kept = tuple(np.concatenate(c) for c in zip(kept, (q, ids[d], cos), (d, ids[q], cos), strict=True))
        if len(kept[0]) > 4 * k * len(x):
            kept = _best(*kept, k)
    return _best(*kept, k)


def _coded(big: pa.RecordBatch, at: np.ndarray, x: np.ndarray, index: Index) -> list[pa.Array]:
    """id, v, code and norm of the rows at the given places."""
    codes, norms = encode(x, index.books)
    code, take = pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(at)
    return [big.column(0).take(take), big.column(1).take(take), code.take(take), pa.array(norms).take(take)]


def _split(rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, blocks: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, pair of blocks, first) with rows of long lists once for every pair of blocks theirs is in; one block makes pair 0."""
    long = np.isin(keys, np.fromiter(blocks, np.int64, len(blocks))) if blocks else np.zeros(len(keys), bool)
    out = [(rows[~long], keys[~long], np.zeros((~long).sum(), np.int64), np.ones((~long).sum(), bool))]
    for r, key in zip(rows[long], keys[long], strict=True):
        n = blocks[int(key)]
        own = int(np.uint64(ids[r]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % n
        every = np.arange(n)
        out.append((np.full(n, r), np.full(n, key), np.minimum(own, every) * n + np.maximum(own, every), own <= every))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_in_lists(reps: DataFrame, index: Index, dim: int, k: int, min_sim: float) -> DataFrame:
    """reps(id, v), all different -> (id, near array<struct<less, id>>): less is the negative cosine. Rows of a list meet."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 2048):
                part = big.slice(s, 2048)
                x = unit(_ints(part.column(1), dim))
                row, key = keys_of(x, index.tiers) if index.tiers else (np.arange(len(x)), np.zeros(len(x), np.int64))
                row, key, pair, first = _split(row, key, part.column(0).to_numpy(), index.blocks)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pair), pa.array(first), *_coded(part, row, x, index)], ["key", "pair", "first", "id", "v", "code", "norm"])

    def search(group: pa.Table) -> pa.Table:
        who, other, cos = [], [], []
        first = group["first"].to_numpy()
        if len(first) > 1 and first.any():
            order = np.argsort(~first, kind="stable")
            ids = group["id"].to_numpy()[order]
            codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint16).reshape(len(ids), -1)[order]
            who, other, cos = _neighbours(_ints(group["v"], dim)[order], ids, codes, group["norm"].to_numpy()[order], index, int(first.sum()), k, min_sim)
            who = ids[who]
        return pa.table([pa.array(who, pa.int64()), pa.array(other, pa.int64()), pa.array(-np.asarray(cos, np.float64))], ["id", "other", "less"])

    placed = reps.select("id", "v").mapInArrow(place, "key bigint, pair bigint, first boolean, id bigint, v binary, code binary, norm float")
    found = placed.groupBy("key", "pair").applyInArrow(search, "id bigint, other bigint, less double")
    near = F.array_sort(F.collect_set(F.struct("less", F.col("other").alias("id"))))  # at most k from each list the row is in
    return found.groupBy("id").agg(F.slice(near, 1, k).alias("near"))


def _classes(u: DataFrame) -> DataFrame:
    """Rows of one direction as one: (id, v, n, h1, h2), id the least; the hashes stand for the vector where only equality counts."""
    one = u.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return cut_lineage(one.select("id", "v", "n", *_hashes()))


def _hashes() -> list:
    return [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]


def similar_rows(df: DataFrame, id_col: str, vec_col: str, *, dim: int = 96, k: int = 5, min_sim: float = 0.8, recall: float = 0.995, fine: int = 8) -> DataFrame:
    """(id, other, similarity): each row's k most similar rows whose cosine is at least min_sim.

    `recall` is the share of true neighbours that share a list, as measured on a sample; 1 compares all rows with all. Ties go
    to the smaller id. Unusable vectors (null, of another length, with a null or non-finite element, all zero) take no part.
    Copies, which are vectors of one direction, are searched once; of a class of copies each row has the others first.
    """
    u = usable_vectors(df, id_col, vec_col, dim)
    classes = _classes(u)
    rows = classes.count()
    if not rows:
        return df.sparkSession.createDataFrame([], "id bigint, other bigint, similarity double")
    index = built(classes, rows, dim=dim, k=k, min_sim=min_sim, recall=recall, fine=fine, single=False)
    near = nearest_in_lists(classes, index, dim, k, min_sim)
    several = classes.where("n > 1").select("h1", "h2", F.col("id").alias("rep"))
    members = u.select("id", *_hashes()).join(several, ["h1", "h2"]).select("rep", "id")
    first = (
        members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id")))
        .where(F.col("r") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    spread = near.select("id", F.explode("near").alias("n")).select("id", "n.less", F.col("n.id").alias("rep"))
    spread = spread.join(first, "rep", "left").select("id", "less", F.coalesce("ids", F.array("rep")).alias("ids"))
    own = first.select(F.col("rep").alias("id"), F.lit(-2.0).alias("less"), "ids")
    whole = (
        spread.unionByName(own)
        .groupBy("id")
        .agg(F.collect_list(F.struct("less", "ids")).alias("l"))
        .select(F.col("id").alias("rep"), F.expr(f"slice(array_sort(flatten(transform(l, x -> transform(x.ids, i -> struct(x.less AS less, i AS id))))), 1, {k + 1}) AS l"))
    )
    each = whole.join(members.withColumnRenamed("id", "member"), "rep", "left").select(F.coalesce("member", "rep").alias("id"), "l")
    return each.select("id", F.explode(F.expr(f"slice(filter(l, x -> x.id <> id), 1, {k})")).alias("x")).select("id", F.col("x.id").alias("other"), F.least(-F.col("x.less"), F.lit(1.0)).alias("similarity"))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, **options: object) -> DataFrame:
    """(facts_a, facts_b) with facts_a < facts_b: pairs of which at least one is among the other's k most similar."""
    s = similar_rows(df, id_col, vec_col, **options)
    return s.select(F.least("id", "other").alias("facts_a"), F.greatest("id", "other").alias("facts_b")).distinct()


def search_by_lists(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, *, dim: int = 96, k: int = 5, recall: float = 0.98, again: int = 400, fine: int = 12) -> DataFrame:
    """(id, rank, other, similarity): the k rows most similar to each query, over all rows.

    Every row is in the list nearest to it; a query goes to as many lists as hold `recall` of the true neighbours of a measured
    sample. The `again` best of each list by lookup tables are ranked by the cosine of 16-bit vectors, the best of all lists by
    that of the vectors themselves, rounded to nine places. A query is a row of the same table
    and isn't its own answer; fewer than k other usable rows give fewer answers.
    """
    rows_in = usable_vectors(df, id_col, vec_col, dim)
    rows = rows_in.count()
    if not rows:
        return df.sparkSession.createDataFrame([], "id bigint, rank int, other bigint, similarity double")
    reps = cut_lineage(rows_in)
    index = built(reps, rows, dim=dim, k=k, min_sim=-1.0, recall=recall, fine=fine, single=True)
    blocks = index.blocks

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 2048):
                part = big.slice(s, 2048)
                x = unit(_ints(part.column(1), dim))
                row, key = keys_of(x, index.tiers, lambda t: 1) if index.tiers else (np.arange(len(x)), np.zeros(len(x), np.int64))
                first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)  # a row is held once
                row, key = row[first], key[first]
                many = np.array([blocks.get(int(y), 1) for y in key], np.int64)
                own = (part.column(0).to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(many, 1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), *_coded(part, row, x, index)], ["key", "pair", "id", "v", "code", "norm"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            x = unit(_ints(big.column(1), dim))
            row, key = keys_of(x, index.tiers) if index.tiers else (np.arange(len(x)), np.zeros(len(x), np.int64))
            many = np.array([blocks.get(int(y), 1) for y in key], np.int64)
            row, key, pair = np.repeat(row, many), np.repeat(key, many), np.concatenate([np.arange(n) for n in many] or [np.zeros(0, np.int64)])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pair, pa.int64()), big.column(0).take(at), big.column(1).take(at), pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.float32())], ["key", "pair", "id", "v", "code", "norm"])

    def scan(group: pa.Table) -> pa.Table:
        is_query = group["norm"].is_null().to_numpy()
        ids, q, d = group["id"].to_numpy(), np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out_id, out_other, out_sim = [], [], []
        if len(q) and len(d):
            ask, hold = (_ints(group["v"].take(pa.array(at)), dim) for at in (q, d))
            u, exact = unit(ask), hold.astype(np.float64)
            length, own = np.sqrt((exact * exact).sum(1)), np.sqrt((ask.astype(np.float64) ** 2).sum(1))
            code = np.frombuffer(b"".join(group["code"].take(pa.array(d)).to_pylist()), np.uint16).reshape(len(d), -1)
            norm = group["norm"].take(pa.array(d)).to_numpy()
            keep = min(again + 1, len(d))
            for s in range(0, len(q), 64):
                near = scores(tables(u[s : s + 64], index.books), code, norm)
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                for r, row in enumerate(best):
                    row = row[ids[d[row]] != ids[q[s + r]]]
                    cos = np.minimum(exact[row] @ ask[s + r].astype(np.float64) / (length[row] * own[s + r]), 1.0)
                    top = np.lexsort((ids[d[row]], -cos))[: k + SPARE]
                    out_id += [ids[q[s + r]]] * len(top)
                    out_other += ids[d[row[top]]].tolist()
                    out_sim += cos[top].tolist()
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_other, pa.int64()), pa.array(out_sim, pa.float64())], ["id", "other", "similarity"])

    schema = "key bigint, pair bigint, id bigint, v binary, code binary, norm float"
    asked = usable_vectors(queries, id_col, vec_col, dim).mapInArrow(asking, schema)
    found = reps.mapInArrow(held, schema).unionByName(asked).groupBy("key", "pair").applyInArrow(scan, "id bigint, other bigint, similarity double")
    few = found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where(F.col("_n") <= k + SPARE).select("id", "other")
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    both = few.join(raw, "id").join(raw.select(F.col("id").alias("other"), F.col("v").alias("w")), "other")
    exact = both.select("id", "other", F.round(cosine(F.col("v"), F.col("w")), 9).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return exact.select("id", rank.alias("rank"), "other", "similarity").where(F.col("rank") <= k)
