"""Exact vector search, and an inverted-file index for those who accept an approximate one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions.vectors import similarities

#: How rows are compared with a stated query; greater is nearer.
MEASURES = ("cosine", "taxicab")


def semantic_search(df: DataFrame, id_col: str, vec_col: str, query: Sequence[float], limit: int) -> DataFrame:
    """(id, rank, score): the rows nearest to one query by cosine, ties by id; rank first, fetch display columns after."""
    top = similarities(df, id_col, vec_col, [query]).select("id", F.col("sims")[0].alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return _ranked(top, [F.desc("score"), F.asc("id")])


def _ranked(top: DataFrame, order: list) -> DataFrame:
    """Ranks for a list that a limit has already made short."""
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "x")).select(F.col("x.id").alias("id"), (F.col("p") + 1).alias("rank"), (-F.col("x.less")).alias("score"))


def interest_scan(df: DataFrame, id_col: str, vec_col: str, interests: Sequence[Sequence[float]], *, limit: int, band: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """(kind, id, score, interest): the top list by the best of k cosines, and the top of an inclusive band of it.

    Both lists come from one pass over the vectors: the cosines are worked out once per row and never joined back.
    """
    scored = similarities(df, id_col, vec_col, interests).select("id", F.array_max("sims").alias("score"), (F.array_position("sims", F.array_max("sims")) - 1).cast("int").alias("interest"))
    kinds = F.array(F.struct(F.lit("top").alias("kind"), F.lit(True).alias("on")), F.struct(F.lit("band").alias("kind"), F.col("score").between(*band).alias("on")))
    each = scored.select("id", "score", "interest", F.explode(kinds).alias("k")).where("k.on").select("k.kind", "id", "score", "interest")
    best = each.where("kind = 'top'").orderBy(F.desc("score"), "id").limit(limit)
    return best.unionByName(each.where("kind = 'band'").orderBy(F.desc("score"), "id").limit(limit))


@dataclass(frozen=True)
class CellIndex:
    """An approximate index: rows by the nearest of a set of centres; built, told about, searched at a depth, and dropped."""

    rows: DataFrame
    centres: tuple[tuple[float, ...], ...]

    @property
    def state(self) -> dict[str, int]:
        return {"centres": len(self.centres), "rows": self.rows.count()}

    def search(self, query: Sequence[float], limit: int, depth: int) -> DataFrame:
        near = sorted(range(len(self.centres)), key=lambda i: -sum(a * b for a, b in zip(self.centres[i], query, strict=True)))[:depth]
        return semantic_search(self.rows.where(F.col("cell").isin(near)), "id", "v", query, limit)

    def drop(self) -> None:
        self.rows.unpersist()


def build_index(df: DataFrame, id_col: str, vec_col: str, centres: int = 16) -> CellIndex:
    """Centres are rows spread by their hashed id (a bounded handful); every row with a vector of their size is assigned to one."""
    usable = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL AND size(v) > 0")
    picked = [tuple(float(x) for x in r.v) for r in usable.orderBy(F.xxhash64("id")).limit(centres).collect()]
    picked = [p for p in picked if len(p) == len(picked[0])]
    if not picked:
        return CellIndex(usable.withColumn("cell", F.lit(0)), ())
    near = similarities(usable, "id", "v", picked, keep=True).select("id", "v", (F.array_position("sims", F.array_max("sims")) - 1).cast("int").alias("cell"))
    return CellIndex(near.persist(), tuple(picked))


def search_stated(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, limit: int, *, measure: str = "cosine", block: int = 8192, query_block: int = 512) -> DataFrame:
    """(query, id, rank, score): the `limit` rows nearest to each stated query, the query's own row included, ties by id.

    Exact: rows and queries are hashed to blocks, each pair of blocks is scored as one matrix, and only its best leave the task.
    Rows without a vector of finite numbers, or of length 0 for the cosine, are left out; so are pairs of different sizes.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known are {MEASURES}")
    usable = lambda x: x.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    rows, asked = usable(df).withColumn("dim", F.size("v")), usable(queries).withColumn("dim", F.size("v"))
    blocks, qblocks = max(1, math.ceil(rows.count() / block)), max(1, math.ceil(asked.count() / query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = asked.select("dim", F.pmod(F.xxhash64("id"), F.lit(qblocks)).alias("q"), every(blocks).alias("b"), F.lit(True).alias("asks"), "id", "v")
    right = rows.select("dim", every(qblocks).alias("q"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.lit(False).alias("asks"), "id", "v")

    def score(t: pa.Table) -> pa.Table:
        asks, ids = t["asks"].to_numpy(), t["id"].to_numpy()
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        who, other, got = [], [], []
        if measure == "cosine":
            length = np.linalg.norm(x, axis=1)
            q, d = q[length[q] > 0], d[length[d] > 0]
        for i in q:
            near = (x[d] @ x[i]) / (length[d] * length[i]) if measure == "cosine" else -np.abs(x[d] - x[i]).sum(1)
            best = np.lexsort((ids[d], -near))[:limit]
            who += [ids[i]] * len(best)
            other += ids[d[best]].tolist()
            got += near[best].tolist()
        return pa.table([pa.array(who, pa.int64()), pa.array(other, pa.int64()), pa.array(got, pa.float64())], ["query", "id", "score"])

    found = left.unionByName(right).groupBy("dim", "q", "b").applyInArrow(score, "query bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)
