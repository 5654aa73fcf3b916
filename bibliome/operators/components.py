"""Connected components of a graph of links, by contraction to star centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliome.session import cut_lineage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """links(a, b) -> (id, component): every linked id with the least id it is connected to.

    Large-star and small-star steps alternate until no link changes, however many rounds that takes (their number grows with the
    logarithm of the longest chain); each step is one aggregation, hub nodes are combined before the shuffle, and the lineage is
    cut after each round. Loops and repeated links don't matter; no links give no rows.
    """
    edges = cut_lineage(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number of links and two sums of their hashes: equal for equal sets, and otherwise all but never."""
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), wide("u", "v"), wide(F.lit(1), "v", "u")).first())
