"""Several ranked lists made one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The constant of reciprocal rank fusion, and how deep each list goes for a page of a given size.
RRF_K = 60


def pool_depth(limit: int) -> int:
    return max(5 * limit, 50)


def _weight(weights: Mapping[str, float] | None) -> Column:
    out = F.lit(1.0)
    for method, w in (weights or {}).items():
        out = F.when(F.col("method") == method, F.lit(float(w))).otherwise(out)
    return out


def fuse(lists: DataFrame, limit: int, *, how: str = "rrf", weights: Mapping[str, float] | None = None, k: int = RRF_K, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """lists(query, method, id, rank, score) -> (query, id, rank, total, components map<method, part>).

    'rrf' sums weight / (k + rank); 'weighted' sums weight times the score scaled to 0..1 within its list, a list of equal
    scores counting 1. Ties go to the smaller id.
    """
    w = _weight(weights)
    if how == "rrf":
        part = w / (k + F.col("rank"))
    elif how == "weighted":
        own = Window.partitionBy(*by, "method")
        low, span = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
        part = w * F.when(span == 0, 1.0).otherwise((F.col("score") - low) / span)
    else:
        raise ValueError(f"unknown fusion: {how}")
    parts = lists.select(*by, "id", "method", part.alias("part"))
    total = parts.groupBy(*by, "id").agg(F.sum("part").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "part")))).alias("components"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "id"))
    return total.withColumn("rank", rank).where(F.col("rank") <= limit).select(*by, "id", "rank", "total", "components")
