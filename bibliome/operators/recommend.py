"""Recommendation: candidates of several sources, bounded features, a linear score, diversified order, and feedback."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions import scores as S
from bibliome.functions.vectors import similarities

#: Features with their direction (1: more is better) and their default weight.
FEATURES = {
    "semantic_affinity": (1, 0.35), "affinity_long": (1, 0.0), "affinity_short": (1, 0.0), "interest_emphasis": (1, 0.12), "negative_affinity": (-1, 0.30), "topic_affinity": (1, 0.15), "field_affinity": (1, 0.05),
    "author_affinity": (1, 0.10), "venue_affinity": (1, 0.05), "lexical_affinity": (1, 0.05), "freshness": (1, 0.15), "novelty": (1, 0.03), "source_agreement": (1, 0.05), "quality_prior": (1, 0.05),
    "preprint_fit": (1, 0.04), "seen_fatigue": (-1, 0.20), "retracted": (-1, 0.60),
}
#: How strongly each kind of event speaks.
SIGNALS = {"impression": 0.0, "open": 0.10, "abstract_expand": 0.05, "outbound_click": 0.20, "save": 0.50, "follow_from_item": 0.60, "more_like_this": 0.50, "dismiss": -0.30, "not_relevant": -0.70, "less_like_this": -0.50, "block_topic": -1.00}
#: Fixed value: the step of online weight learning.
LEARNING_RATE = 0.02


@dataclass(frozen=True)
class Interest:
    key: str
    vector: tuple[float, ...]
    weight: float = 1.0
    horizon: str = "long"
    negative: bool = False
    label: str = ""
    #: Where it came from: 'stated' by the reader, a 'paper' they chose, or 'derived' from their reading.
    kind: str = "stated"


@dataclass(frozen=True)
class Profile:
    """What a reader cares about; a handful of interests, so closures and literals carry it."""

    interests: tuple[Interest, ...] = ()
    topics: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    blocked_topics: tuple[str, ...] = ()
    blocked_authors: tuple[str, ...] = ()
    peer_reviewed_only: bool = False
    recency: float = 0.5
    preprint_appetite: float = 1.0
    freshness_appetite: float = 0.5

    def __post_init__(self) -> None:
        keys = [i.key for i in self.interests]
        if len(keys) > 16 or len(set(keys)) < len(keys):
            raise ValueError("at most 16 interests, each with its own key")
        if any(not 0 <= i.weight <= 10 for i in self.interests):
            raise ValueError("weights lie between 0 and 10")

    @property
    def positive(self) -> tuple[Interest, ...]:
        return tuple(i for i in self.interests if not i.negative)

    @property
    def negative(self) -> tuple[Interest, ...]:
        return tuple(i for i in self.interests if i.negative)


@dataclass(frozen=True)
class Weights:
    """A weight for each feature; its direction is the feature's own."""

    values: Mapping[str, float] = field(default_factory=lambda: {n: w for n, (_, w) in FEATURES.items()})

    def __post_init__(self) -> None:
        if set(self.values) != set(FEATURES) or any(w < 0 for w in self.values.values()):
            raise ValueError("one weight, not negative, for each feature")

    @property
    def reachable(self) -> float:
        return sum(w for n, w in self.values.items() if FEATURES[n][0] > 0) or 1.0

    @staticmethod
    def learned(delta: Mapping[str, float]) -> Weights:
        return Weights({n: min(2.0, max(0.0, w + min(1.0, max(-1.0, delta.get(n, 0.0))))) for n, (_, w) in FEATURES.items()})


def weights_for(profile: Profile) -> Weights:
    """The default table, its freshness moved between 0.05 and 0.30 by the reader's appetite; 0.5 moves nothing."""
    a, base = profile.freshness_appetite, FEATURES["freshness"][1]
    new = base + (0.30 - base) * (a - 0.5) * 2 if a >= 0.5 else 0.05 + (base - 0.05) * a * 2
    return Weights({n: new if n == "freshness" else w for n, (_, w) in FEATURES.items()})


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def hard_filtered(facts: DataFrame, p: Profile) -> DataFrame:
    """Without blocked topics and authors, and without what isn't peer reviewed if the reader wants only that."""
    out = facts
    for col, blocked in (("topic_ids", p.blocked_topics), ("author_ids", p.blocked_authors)):
        if blocked:
            out = out.where(~F.coalesce(F.arrays_overlap(col, _strings(blocked)), F.lit(False)))
    return out.where("is_peer_reviewed") if p.peer_reviewed_only else out


def affinities(facts: DataFrame, p: Profile, id_col: str = "facts_id", vec_col: str = "vector") -> DataFrame:
    """(id, long, short, negative, interest): best rescaled cosines by horizon, and the interest with the greatest weighted one."""
    every = [*p.positive, *p.negative]
    if not every:
        return facts.select(F.col(id_col).alias("id"), *(F.lit(0.0).alias(n) for n in ("long", "short", "negative")), F.lit(None).cast("int").alias("interest")).limit(0)
    sims = similarities(facts, id_col, vec_col, [i.vector for i in every])
    at = lambda ok: [F.col("sims")[n] for n, i in enumerate(every) if ok(i)]
    best = lambda cols: S.rescaled(F.array_max(F.array(*cols))) if cols else F.lit(0.0)
    led = [F.struct((F.col("sims")[n] * i.weight).alias("v"), F.lit(-n).alias("n")) for n, i in enumerate(p.positive)]
    return sims.select(
        "id", best(at(lambda i: not i.negative and i.horizon != "short")).alias("long"), best(at(lambda i: not i.negative and i.horizon == "short")).alias("short"), best(at(lambda i: i.negative)).alias("negative"),
        (-F.array_max(F.array(*led))["n"] if led else F.lit(None)).cast("int").alias("interest"),
    )


def features(facts: DataFrame, p: Profile, today: Column, *, origins: Column | None = None, lexical: Column | None = None, seen_days: Column | None = None) -> DataFrame:
    """facts with one column per feature, each within 0..1, and the interest that matched (its place among the positive ones).

    Everything but the cosines is a native expression over the row itself; nothing is shuffled but the join of affinities.
    """
    a = affinities(facts, p).withColumnRenamed("id", "facts_id")
    x = facts.join(a, "facts_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    has_short = any(i.horizon == "short" for i in p.positive)
    heaviest = max((i.weight for i in p.positive), default=0.0)
    emphasis = F.lit(1.0)
    for n, i in enumerate(p.positive):
        emphasis = F.when(F.col("interest") == n, F.lit(min(1.0, i.weight / heaviest) if heaviest else 1.0)).otherwise(emphasis)
    topics, authors = _strings(p.topics), _strings(p.authors)
    signals = [1 - S.hit(F.col(c), f) for c, f, some in (("topic_ids", topics, p.topics), ("author_ids", authors, p.authors)) if some]
    lean = (p.preprint_appetite - 1) / 2
    empty = F.array().cast("array<string>")
    cols = {
        "affinity_long": zero("long"), "affinity_short": zero("short"), "semantic_affinity": (1 - p.recency) * zero("long") + p.recency * zero("short") if has_short else zero("long"),
        "interest_emphasis": emphasis, "negative_affinity": zero("negative"), "topic_affinity": S.share(F.coalesce("topic_ids", empty), topics), "field_affinity": S.hit(F.col("field_slugs"), _strings(p.fields)),
        "author_affinity": S.hit(F.col("author_ids"), authors), "venue_affinity": F.coalesce(F.col("venue_name").isin(list(p.venues)), F.lit(False)).cast("double") if p.venues else F.lit(0.0),
        "lexical_affinity": S.clamp(F.coalesce(lexical, F.lit(0.0))) if lexical is not None else F.lit(0.0), "freshness": S.freshness(F.col("feed_date"), today),
        "novelty": sum(signals[1:], signals[0]) / len(signals) if signals else F.lit(0.5), "source_agreement": S.clamp(origins / S.AGREEMENT) if origins is not None else F.lit(1 / S.AGREEMENT),
        "quality_prior": (F.coalesce(F.col("is_peer_reviewed").cast("double"), F.lit(0.0)) + F.coalesce(F.col("has_abstract").cast("double"), F.lit(0.0)) + S.clamp(F.coalesce("venue_mean_citedness", F.lit(0.0)) / S.CITEDNESS_CAP)) / 3,
        "preprint_fit": F.lit(0.5) if p.preprint_appetite == 1 else S.clamp(F.when(F.col("is_preprint"), 0.5 + lean).otherwise(0.5 - lean)),
        "seen_fatigue": S.seen_fatigue(seen_days if seen_days is not None else F.col("seen_days_ago")), "retracted": F.coalesce(F.col("retraction_status") == "retracted", F.lit(False)).cast("double"),
    }
    return x.select(*[facts[c] for c in facts.columns], "interest", *[cols[n].alias(n) for n in FEATURES])


def scored(f: DataFrame, w: Weights | None = None) -> DataFrame:
    """f with score (0 at least, by the weight that could be reached) and the contribution of each feature that has a weight."""
    w = w or Weights()
    parts = {n: FEATURES[n][0] * w.values[n] * F.col(n) for n in FEATURES if w.values[n]}
    total = reduce(lambda a, b: a + b, parts.values(), F.lit(0.0))
    return f.withColumn("score", F.greatest(F.lit(0.0), total / w.reachable)).withColumn("contributions", F.create_map(*[x for n, c in parts.items() for x in (F.lit(n), c)]))


def ranked(s: DataFrame, key: str, limit: int) -> DataFrame:
    """The best by score, then key, with their rank; the order is total."""
    top = s.orderBy(F.desc("score"), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), key)))


def leading(contributions: Column, most: int = 3) -> Column:
    """The greatest positive contributions, the greatest first."""
    entries = F.filter(F.map_entries(contributions), lambda e: e.value > 0)
    return F.transform(F.slice(F.array_sort(F.transform(entries, lambda e: F.struct((-e.value).alias("less"), e.key.alias("name")))), 1, most), lambda e: e["name"])


def penalties(contributions: Column, most: int = 3) -> Column:
    """What speaks most against a paper, the worst first."""
    entries = F.filter(F.map_entries(contributions), lambda e: e.value < 0)
    return F.transform(F.slice(F.array_sort(F.transform(entries, lambda e: F.struct(e.value.alias("less"), e.key.alias("name")))), 1, most), lambda e: e["name"])


@dataclass(frozen=True)
class Diversity:
    """How relevance is traded for variety; the values are fixed ones."""

    relevance: float = 0.75
    per_interest: int = 3
    per_topic: int = 4
    exploration_share: float = 0.15
    exploration_floor: float = 0.5
    same: float = 0.95
    #: What makes two papers alike: 'vector' (cosine) or 'topics' (shared part of their topics); unknown counts as unlike.
    by: str = "vector"
    #: A function of two rows to use in place of both.
    alike: Callable[[dict, dict], float] | None = None


def _likeness(rows: list[dict], d: Diversity) -> np.ndarray:
    """How alike each pair of a short list is, 0 to 1; what isn't known counts as unlike."""
    n = len(rows)
    out = np.zeros((n, n))
    if d.alike is not None:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = d.alike(rows[i], rows[j])
    elif d.by == "topics":
        every = sorted({t for r in rows for t in r["topics"] or ()})
        has = np.array([[t in (r["topics"] or ()) for t in every] for r in rows], float).reshape(n, len(every))
        shared = has @ has.T
        size = has.sum(1)
        out = np.divide(shared, size[:, None] + size[None] - shared, out=out, where=shared > 0)
    else:
        for dim in {len(r["vector"]) for r in rows if r["vector"]}:
            at = np.array([i for i, r in enumerate(rows) if r["vector"] and len(r["vector"]) == dim])
            x = np.array([rows[i]["vector"] for i in at], float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            out[np.ix_(at, at)] = np.clip(np.nan_to_num(x @ x.T), 0.0, 1.0)
    return out


def _reorder(rows: list[dict], limit: int, d: Diversity) -> list[int]:
    """Places in rows of one reader's varied list: at each step the best of what is still allowed, by score less likeness to what is
    picked. Caps on interests and topics give way where they leave nothing; likeness and exploration never do."""
    n = len(rows)
    if not n:
        return []
    score = np.array([r["score"] for r in rows], float)
    tie = np.array([r["id"] for r in rows])
    exploring = np.array([bool(r["exploring"]) for r in rows])
    likeness = _likeness(rows, d)
    # one column per interest and topic, with how many of each a list may hold
    kinds = [("i", r["interest"]) for r in rows if r["interest"] is not None] + [("t", t) for r in rows for t in r["topics"] or ()]
    column = {k: c for c, k in enumerate(dict.fromkeys(kinds))}
    member = np.zeros((n, len(column)), bool)
    for r, row in enumerate(rows):
        if row["interest"] is not None:
            member[r, column[("i", row["interest"])]] = True
        for t in row["topics"] or ():
            member[r, column[("t", t)]] = True
    cap = np.array([d.per_interest if kind == "i" else d.per_topic for kind, _ in column], int)
    held = np.zeros(len(column), int)
    near, left, picked = np.zeros(n), np.ones(n, bool), []
    left &= ~exploring | (score >= score.max() * d.exploration_floor)
    for _ in range(min(limit, n)):
        if exploring[picked].sum() >= int(limit * d.exploration_share):
            left &= ~exploring
        may = left & (near < d.same) if picked else left
        within = may & ~(member & (held >= cap)).any(1)
        some = np.flatnonzero(within if within.any() else may)
        if not len(some):
            break
        worth = d.relevance * score[some] - (1 - d.relevance) * near[some]
        best = int(some[np.lexsort((tie[some], -worth))[0]])
        picked.append(best)
        left[best] = False
        held += member[best]
        near = np.maximum(near, likeness[best])
    return picked


def top_per_interest(sims: DataFrame, most: int = 100) -> DataFrame:
    """(id, sims array) as of similarities() -> (interest, rank, id, score): each interest's nearest papers, ties by id."""
    each = sims.select("id", F.posexplode("sims").alias("interest", "score"))
    w = Window.partitionBy("interest").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("interest", "rank", "id", "score")


def diversified(s: DataFrame, limit: int, d: Diversity | None = None) -> DataFrame:
    """s(reader, id, score, interest, topics, vector, exploring) -> (reader, id, place, score): each reader's list, varied.

    A reader's candidates are few (a budget bounds them), so one group is one reader's short list.
    """
    d = d or Diversity()

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        at = _reorder(rows, limit, d)
        return pa.table({"reader": pa.array([rows[i]["reader"] for i in at], pa.int64()), "id": pa.array([rows[i]["id"] for i in at], pa.int64()), "place": pa.array(range(1, len(at) + 1), pa.int32()), "score": pa.array([rows[i]["score"] for i in at], pa.float64())})

    return s.groupBy("reader").applyInArrow(run, "reader bigint, id bigint, place int, score double")


def pooled(candidates: DataFrame) -> DataFrame:
    """candidates(id, origin, strength) -> (id, origins, agreement): one row each, reasons together, distinct origins counted."""
    return candidates.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("origin", "strength"))).alias("origins"), F.count_distinct("origin").alias("agreement"))


def within_budget(sources: Sequence[DataFrame], total: int, own: Mapping[int, int] | None = None) -> DataFrame:
    """Sources one after another, each given an equal part of what is left of the budget of distinct candidates, the strongest
    first and ties by id; `own` gives single sources (by place) a number of their own. What is counted is bounded by the budget."""
    taken: DataFrame | None = None
    for n, src in enumerate(sources):
        left = total - (taken.select("id").distinct().count() if taken is not None else 0)
        part = src.orderBy(F.desc("strength"), "id").limit((own or {}).get(n, max(1, left // (len(sources) - n))))
        taken = part if taken is None else taken.unionByName(part)
    return pooled(taken)


def collaborative(events: DataFrame, user: int, positive: Sequence[str], limit: int, *, least: int = 3) -> DataFrame:
    """events(user_id, item, event_type) -> (item, support, strength): what readers who share an item with this one liked besides."""
    good = events.where(F.col("event_type").isin(*positive)).select("user_id", "item").distinct()
    anchors = good.where(F.col("user_id") == user).select("item")
    peers = good.where(F.col("user_id") != user).join(anchors, "item", "left_semi").select("user_id").distinct()
    found = good.join(peers, "user_id", "left_semi").join(anchors, "item", "left_anti").groupBy("item").agg(F.count_distinct("user_id").alias("support"))
    return found.where(F.col("support") >= least).orderBy(F.desc("support"), "item").limit(limit).withColumn("strength", F.least(F.lit(1.0), F.col("support") / 5.0))


def recent_positives(events: DataFrame, positive: Sequence[str], most: int = 12) -> DataFrame:
    """(user_id, item, ts, event_id, n): each reader's last positive events."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.where(F.col("event_type").isin(*positive)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def interest_deltas(events: DataFrame, signals: Mapping[str, float], now: Column, horizon: str = "long") -> DataFrame:
    """events(user_id, interest_key, event_type, ts) -> (user_id, interest_key, total, delta): decayed evidence, saturated."""
    strength = F.lit(0.0)
    for kind, s in signals.items():
        strength = F.when(F.col("event_type") == kind, F.lit(s)).otherwise(strength)
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    told = events.where("interest_key IS NOT NULL").select("user_id", "interest_key", S.decayed(strength, age, horizon).alias("x"))
    return told.groupBy("user_id", "interest_key").agg(F.sum("x").alias("total")).withColumn("delta", S.saturated(F.col("total")))


def impression_rate(events: DataFrame, kind: str, shown: str = "impression") -> DataFrame:
    """(user_id, rate): events of a kind per impression; 0 where nothing was shown."""
    n = F.count_if(F.col("event_type") == shown)
    return events.groupBy("user_id").agg(F.coalesce(F.count_if(F.col("event_type") == kind) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("rate"))

