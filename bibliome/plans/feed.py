"""A reader's feed: candidates of several sources, hard filters, features, score, varied order, and reasons in words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.operators import evaluation, recommend, semantic
from bibliome.session import cut_lineage

#: Days a feed looks back, candidates it considers, the share exploration may fill, and the band it explores.
WINDOW_DAYS, BUDGET, EXPLORATION_SHARE, BAND = 90, 400, 0.15, (0.60, 0.80)
#: How a reason reads, by what a candidate was found by and by where the matched interest came from.
ORIGIN_WORDS = {
    "topic": "in {}, which you follow", "field": "in {}", "author": "by {}, whom you follow", "venue": "published in {}, which you follow",
    "collaborative": "read by people with interests like yours ({})", "sequential": "follows what you have been reading ({})",
}
INTEREST_WORDS = {"stated": "matches your interest in {}", "paper": "similar to a paper you chose: {}", "derived": "based on what you have been reading about {}"}
#: Contributions from which freshness and agreement are worth saying.
FRESH, AGREED = 0.05, 0.03


@dataclass(frozen=True)
class Feed:
    """items(rank, id, score, interest, reasons, origins, exploring, contributions) and what was counted on the way."""

    items: DataFrame
    diagnostics: Mapping[str, object] = field(default_factory=dict)


def _proposed(df: DataFrame, origin: str, strength: Column, detail: Column) -> DataFrame:
    return df.select(F.col("facts_id").alias("id"), F.lit(origin).alias("origin"), strength.cast("double").alias("strength"), detail.cast("string").alias("detail"))


def _matching(recent: DataFrame, origin: str, column: str, followed: Sequence[str]) -> DataFrame:
    """Papers whose list shares a member with what the reader follows; strength is how many, detail the first of them."""
    shared = F.array_intersect(column, F.array(*map(F.lit, followed)).cast("array<string>"))
    return _proposed(recent.withColumn("_s", shared).where("size(_s) > 0"), origin, F.size("_s"), F.array_min("_s"))


def sources_of(facts: DataFrame, profile: recommend.Profile, today: Column, *, window_days: int = WINDOW_DAYS, budget: int = BUDGET, events: DataFrame | None = None, reader: int | None = None, positive: Sequence[str] = ("save", "follow_from_item", "more_like_this")) -> dict[str, DataFrame]:
    """Source name -> candidates(id, origin, strength, detail), in the order they are asked.

    Vectors of the window are scanned once for both the nearest and the exploring source. events(user_id, item, event_type, ts,
    event_id) with item a facts_id add what like-minded readers saved and what follows the reader's own last papers.
    """
    recent = facts.where(F.col("feed_date").between(F.date_sub(today, window_days), today))
    out: dict[str, DataFrame] = {}
    if profile.positive:
        scan = semantic.interest_scan(recent, "facts_id", "vector", [i.vector for i in profile.positive], limit=budget, band=BAND)
        scan = cut_lineage(scan.withColumnRenamed("id", "facts_id"))  # at most twice the budget
        key = F.get(F.array(*[F.lit(i.key) for i in profile.positive]), F.col("interest"))
        out["semantic_interest"] = _proposed(scan.where("kind = 'top'"), "semantic_interest", F.col("score"), key)
    for origin, column, followed in (("topic", "topic_ids", profile.topics), ("field", "field_slugs", profile.fields), ("author", "author_ids", profile.authors)):
        if followed:
            out[origin] = _matching(recent, origin, column, followed)
    if profile.venues:
        out["venue"] = _proposed(recent.where(F.col("venue_name").isin(*profile.venues)), "venue", F.lit(1.0), F.col("venue_name"))
    if events is not None and reader is not None:
        liked = recommend.collaborative(events, reader, positive, budget)
        out["collaborative"] = liked.select(F.col("item").cast("bigint").alias("id"), F.lit("collaborative").alias("origin"), F.col("strength"), F.concat("support", F.lit(" readers")).alias("detail"))
        last = recommend.recent_positives(events.where(F.col("user_id") == reader), positive).select(F.col("item").alias("facts_id")).distinct()
        held = [r.f for r in facts.join(last, "facts_id", "left_semi").select(F.explode("field_slugs").alias("f")).distinct().collect()]  # of a dozen papers
        if held:
            own = F.array_intersect("field_slugs", F.array(*map(F.lit, sorted(held))))
            fresh = recent.join(last, "facts_id", "left_anti").withColumn("_s", own).where("size(_s) > 0")
            out["sequential"] = _proposed(fresh, "sequential", F.size("_s") / F.lit(len(held)), F.array_min("_s"))
    if profile.positive:
        out["exploration"] = _proposed(scan.where("kind = 'band'"), "exploration", F.col("score"), key)
    return out


def gathered(sources: Mapping[str, DataFrame], total: int = BUDGET, own: Mapping[str, int] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(candidates(id, reasons, agreement), contributions): sources in order, each given an equal part of what is left of the budget,
    its strongest first; `own` gives single sources a number of their own. Exploration never fills more than its share."""
    own = {"exploration": int(total * EXPLORATION_SHARE)} | dict(own or {})
    taken: DataFrame | None = None
    told: dict[str, int] = {}
    for n, (name, src) in enumerate(sources.items()):
        left = max(0, total - (taken.select("id").distinct().count() if taken is not None else 0))
        share = min(left, own[name]) if name in own else left if n + 1 == len(sources) else max(1, left // (len(sources) - n))
        part = cut_lineage(src.groupBy("id", "origin").agg(F.max_by("detail", "strength").alias("detail"), F.max("strength").alias("strength")).orderBy(F.desc("strength"), "id").limit(share))
        told[name] = part.count()
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        raise ValueError("no source")
    reasons = F.sort_array(F.collect_list(F.struct("origin", "strength", "detail")))
    return taken.groupBy("id").agg(reasons.alias("reasons"), F.count_distinct("origin").alias("agreement")), told


def _reason(origin: str) -> Column:
    return F.get(F.filter("reasons", lambda r: r["origin"] == origin), F.lit(0))


def explained(x: DataFrame, profile: recommend.Profile) -> Column:
    """Why a paper is shown, the matched interest first: distinct sentences, in a fixed order."""
    out: list[Column] = []
    for n, i in enumerate(profile.positive):
        words = INTEREST_WORDS.get(getattr(i, "kind", "stated"), INTEREST_WORDS["stated"])
        out.append(F.when(F.col("interest") == n, F.lit(words.format(getattr(i, "label", "") or i.key))))
    for origin, words in ORIGIN_WORDS.items():
        best = _reason(origin)["detail"]
        before, after = words.split("{}")
        out.append(F.when(F.length(best) > 0, F.concat(F.lit(before), best, F.lit(after))))
    out.append(F.when(F.coalesce(F.col("contributions")["freshness"], F.lit(0.0)) > FRESH, F.lit("published recently")))
    out.append(F.when((F.coalesce(F.col("contributions")["source_agreement"], F.lit(0.0)) > AGREED) & (F.col("agreement") > 1), F.concat(F.lit("found "), F.col("agreement"), F.lit(" different ways"))))
    out.append(F.when(F.col("exploring"), F.lit("adjacent to your interests")))
    out.append(F.when(F.col("retracted") > 0, F.lit("retracted - shown because you follow this area")))
    return F.array_distinct(F.array_compact(F.array(*out)))


def build_feed(facts: DataFrame, profile: recommend.Profile, today: Column, *, budget: int = BUDGET, limit: int = 20, window_days: int = WINDOW_DAYS, events: DataFrame | None = None, reader: int | None = None, weights: recommend.Weights | None = None, diversity: recommend.Diversity | None = None, sources: Mapping[str, DataFrame] | None = None) -> Feed:
    """The whole feed of one reader. Blocked papers are removed, not scored low, and counted; candidates without facts are dropped
    and counted; everything after the pool is bounded by the budget."""
    made = sources if sources is not None else sources_of(facts, profile, today, window_days=window_days, budget=budget, events=events, reader=reader)
    if not made:
        made = {"recent": _proposed(facts.where(F.col("feed_date").between(F.date_sub(today, window_days), today)), "recent", F.lit(0.0), F.lit(""))}
    pool, told = gathered(made, budget)
    pool = cut_lineage(pool)
    known = cut_lineage(facts.join(pool.withColumnRenamed("id", "facts_id"), "facts_id"))
    allowed = recommend.hard_filtered(known, profile)
    lexical = _reason("lexical")["strength"]
    scored = recommend.scored(recommend.features(allowed, profile, today, origins=F.col("agreement"), lexical=lexical), weights or recommend.weights_for(profile))
    alone = (F.size("reasons") == 1) & (F.col("reasons")[0]["origin"] == "exploration")
    scored = cut_lineage(scored.withColumn("exploring", alone))
    short = scored.select(F.lit(reader or 0).cast("bigint").alias("reader"), F.col("facts_id").alias("id"), "score", "interest", F.col("topic_ids").alias("topics"), "vector", "exploring")
    order = recommend.diversified(short, limit, diversity).select("id", F.col("place").alias("rank"))
    shown = order.join(scored.withColumnRenamed("facts_id", "id"), "id").withColumn("origins", F.array_sort(F.array_distinct(F.transform("reasons", lambda r: r["origin"]))))
    items = cut_lineage(shown.withColumn("why", explained(shown, profile)).select("rank", "id", "score", "interest", F.col("why").alias("reasons"), "origins", "exploring", "contributions", "vector", "topic_ids"))
    counts = pool.count()
    have, left = known.select("facts_id").distinct().count(), scored.count()
    diagnostics = {
        "considered": counts, "missing_facts": counts - have, "blocked": known.count() - left, "ranked": left, "contributions": told,
        "interest_coverage": {r.interest: r["count"] for r in items.where("interest IS NOT NULL").groupBy("interest").count().collect()},
        "diversity": evaluation.intra_list_diversity(items.select("id", "vector")), "exploration": items.where("exploring").count(),
    }
    return Feed(items.drop("vector", "topic_ids"), diagnostics)


def newest(facts: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Candidates that meet a condition, the newest first: strength falls with the place."""
    w = Window.orderBy(F.desc_nulls_last("feed_date"), F.desc("facts_id"))
    top = facts.where(condition).orderBy(F.desc_nulls_last("feed_date"), F.desc("facts_id")).limit(limit)
    return _proposed(top.withColumn("_n", F.row_number().over(w)), "field", 1 / F.col("_n"), F.lit(""))
