"""Judged pools and ranking metrics, as aggregations over ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions.scores import gain

#: The grade from which a paper counts as relevant, and the depth at which unjudged papers are counted.
RELEVANT, DEPTH = 2, 10


def pool(runs: DataFrame) -> DataFrame:
    """runs(query, method, id, rank) -> (query, id, methods): what any method found, with the sorted methods that did."""
    return runs.groupBy("query", "id").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def metrics(runs: DataFrame, grades: DataFrame, depths: Sequence[int] = (5, 10)) -> DataFrame:
    """(query, method, precision_k, recall_k, ndcg_k, rr) for queries with at least one grade.

    An unjudged paper gains nothing; precision divides by k however few were returned; recall and NDCG of a query without
    relevant papers are 0.
    """
    judged = grades.where("grade IS NOT NULL")
    asked = runs.join(judged.select("query").distinct(), "query", "left_semi").join(judged, ["query", "id"], "left")
    g = F.coalesce(F.col("grade"), F.lit(0))
    hit = g >= RELEVANT
    aggs = [F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in depths:
        inside = F.col("rank") <= k
        aggs += [(F.count_if(hit & inside) / k).alias(f"precision_{k}"), F.count_if(hit & inside).alias(f"hits_{k}"), F.sum(F.when(inside, gain(g, F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}")]
    best = judged.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id")))
    ideal = best.groupBy("query").agg(F.count_if(F.col("grade") >= RELEVANT).alias("relevant"), *[F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias(f"ideal_{k}") for k in depths])
    x = asked.groupBy("query", "method").agg(*aggs).join(ideal, "query")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    out = [F.col("query"), F.col("method"), F.col("rr")]
    for k in depths:
        out += [F.col(f"precision_{k}"), ratio(f"hits_{k}", "relevant").alias(f"recall_{k}"), ratio(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}")]
    return x.select(*out)


def mean_metrics(m: DataFrame) -> DataFrame:
    """(method, queries, mean of each metric) over the scored queries."""
    cols = [c for c in m.columns if c not in ("query", "method")]
    return m.groupBy("method").agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in cols])


def coverage(runs: DataFrame, grades: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query, method, pooled, judged, unjudged): how much of each pool was judged, and what within the depth wasn't."""
    judged = grades.where("grade IS NOT NULL").select("query", "id", F.lit(1).alias("j"))
    p = pool(runs).join(judged, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("pooled"), F.count("j").alias("judged"))
    u = runs.where(F.col("rank") <= depth).join(judged, ["query", "id"], "left").groupBy("query", "method").agg(F.count_if(F.col("j").isNull()).alias("unjudged"))
    return u.join(p, "query").select("query", "method", "pooled", "judged", "unjudged")


def merged_judgments(old: DataFrame, new: DataFrame) -> DataFrame:
    """(query, id, grade, methods): no grade is ever lost, methods are joined."""
    a = old.select("query", "id", F.col("grade").alias("g0"), F.col("methods").alias("m0"))
    b = new.select("query", "id", F.col("grade").alias("g1"), F.col("methods").alias("m1"))
    none = F.array().cast("array<string>")
    return a.join(b, ["query", "id"], "full").select("query", "id", F.coalesce("g0", "g1").alias("grade"), F.array_sort(F.array_union(F.coalesce("m0", none), F.coalesce("m1", none))).alias("methods"))


def feed_description(feed: DataFrame, today: str) -> DataFrame:
    """feed(feed, id, topic_ids, feed_date, interest) -> one row per feed: size, distinct topics, greatest topic share, median
    age, share of a fortnight, interests represented."""
    age = F.datediff(F.lit(today).cast("date"), F.col("feed_date"))
    base = feed.groupBy("feed").agg(F.count("*").alias("size"), F.median(age).alias("median_age"), F.avg((age <= 14).cast("double")).alias("fresh_share"), F.count_distinct("interest").alias("interests"))
    topic = feed.select("feed", F.explode("topic_ids").alias("t")).groupBy("feed", "t").count().groupBy("feed").agg(F.count("*").alias("topics"), F.max("count").alias("most"))
    return base.join(topic, "feed", "left").select("feed", "size", F.coalesce("topics", F.lit(0)).alias("topics"), F.coalesce(F.col("most") / F.col("size"), F.lit(0.0)).alias("max_topic_share"), "median_age", "fresh_share", "interests")


def intra_list_diversity(items: DataFrame) -> float:
    """items(id, vector), one short list -> mean dissimilarity of its pairs; 1 for fewer than two, and unknown vectors are unlike."""
    rows = [np.asarray(r.vector, float) if r.vector else None for r in items.select("vector").collect()]  # a page's worth
    if len(rows) < 2:
        return 1.0
    unit = [v / n if v is not None and (n := np.linalg.norm(v)) > 0 else None for v in rows]
    alike = [min(1.0, max(0.0, float(a @ b))) if a is not None and b is not None and a.shape == b.shape else 0.0 for i, a in enumerate(unit) for b in unit[i + 1 :]]
    return 1.0 - sum(alike) / len(alike)


def overall(runs: DataFrame, grades: DataFrame) -> DataFrame:
    """(judged, pooled, share): over all queries, how many of the pooled papers have a grade."""
    p = pool(runs).join(grades.where("grade IS NOT NULL").select("query", "id", F.lit(1).alias("j")), ["query", "id"], "left")
    return p.agg(F.count("j").alias("judged"), F.count("*").alias("pooled"), F.coalesce(F.count("j") / F.nullif(F.count("*").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"))


def feed_scores(feed: DataFrame, grades: DataFrame, k: int = DEPTH) -> DataFrame:
    """feed(feed, id, rank), grades(feed, id, grade) -> (feed, judged, precision, ndcg, reportable): scores are null where nothing is
    judged, and fit to be reported only where everything shown is."""
    x = feed.where(F.col("rank") <= k).join(grades.where("grade IS NOT NULL").select("feed", "id", "grade"), ["feed", "id"], "left")
    best = x.where("grade IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("grade"), "id")))
    ideal = best.groupBy("feed").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    g = F.coalesce("grade", F.lit(0))
    one = x.groupBy("feed").agg(F.count("grade").alias("judged"), F.count("*").alias("shown"), F.count_if(g >= RELEVANT).alias("hits"), F.sum(gain(g, F.col("rank"))).alias("dcg")).join(ideal, "feed", "left")
    some = F.col("judged") > 0
    return one.select("feed", "judged", F.when(some, F.col("hits") / k).alias("precision"), F.when(some, F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0))).alias("ndcg"), (F.col("judged") == F.col("shown")).alias("reportable"))


def graded(judgments: DataFrame, query: str, paper: str, grade: int, judge: str, at: str) -> DataFrame:
    """judgments with one grade (0 to 3) stamped, its judge and time beside; an unknown pair becomes a new row."""
    if grade not in range(4):
        raise ValueError(f"a grade is 0, 1, 2 or 3, not {grade!r}")
    here = (F.col("query_id") == query) & (F.col("paper_id") == paper)
    stamped = judgments.withColumns({n: F.when(here, F.lit(v).cast(dict(judgments.dtypes)[n])).otherwise(F.col(n)) for n, v in (("grade", grade), ("judge", judge), ("judged_at", at))})
    new = judgments.sparkSession.createDataFrame([(query, paper, grade, judge, at)], "query_id string, paper_id string, grade int, judge string, judged_at string")
    return stamped.unionByName(new.join(judgments.where(here).select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti"), allowMissingColumns=True)


def grade_map(judgments: DataFrame) -> DataFrame:
    """(query, grades map<paper, grade>) of what is judged."""
    x = judgments.where("grade IS NOT NULL").groupBy("query_id", "paper_id").agg(F.max("grade").alias("grade"))
    return x.groupBy(F.col("query_id").alias("query")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("paper_id", "grade")))).alias("grades"))


def list_diversity(pairs: DataFrame) -> DataFrame:
    """pairs(feed, a, b, similarity), a before b -> (feed, diversity): mean dissimilarity."""
    return pairs.groupBy("feed").agg(F.avg(1 - F.col("similarity")).alias("diversity"))
