"""What readers do, turned into weights of their interests; and what was shown to them, kept with the score that put it there."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliome.functions import scores as S
from bibliome.operators import recommend
from bibliome.operators.recommend import SIGNALS, Profile

#: Events that say no outright (nothing else is ever read as a no), and the greatest weight of an interest.
NO = ("dismiss", "not_relevant", "less_like_this", "block_topic")
MOST = 10.0


@dataclass(frozen=True)
class Summary:
    """What a batch of events did: how many were read, only exposures, outright noes and without a known interest, and the evidence
    by interest."""

    considered: int = 0
    impressions: int = 0
    negatives: int = 0
    unattributed: int = 0
    evidence: Mapping[str, float] = field(default_factory=dict)


def is_negative(event_type: Column) -> Column:
    """Only what readers say outright; that something was shown and not opened says nothing."""
    return F.coalesce(event_type.isin(*NO), F.lit(False))


def moved(weight: Column, evidence: Column, negative: Column) -> Column:
    """An interest's weight after evidence: a no about something unwanted strengthens it; saturated, held within 0..10; without
    evidence unchanged."""
    new = S.saturated(weight + F.when(negative, -evidence).otherwise(evidence))
    return F.when(F.coalesce(evidence, F.lit(0.0)) == 0, weight).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(0.0), new)))


def reweighted(interests: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """interests(user_id, key, weight, horizon, negative), events(user_id, interest_key, event_type, ts) -> interests with their weights
    moved by decayed evidence. Events that name no interest of the reader change nothing; impressions weigh nothing."""
    told = [recommend.interest_deltas(events, SIGNALS, now, h).select("user_id", F.col("interest_key").alias("key"), F.lit(h).alias("horizon"), F.col("total").alias("_e")) for h in ("long", "short")]
    x = interests.join(told[0].unionByName(told[1]), ["user_id", "key", "horizon"], "left")
    return x.withColumn("weight", moved(F.col("weight"), F.col("_e"), F.col("negative"))).select(*interests.columns)


def applied(profile: Profile, events: DataFrame, now: Column) -> tuple[Profile, Summary]:
    """One reader's profile after their events, and what the events did; the profile's interests are a handful."""
    keys = [i.key for i in profile.interests]
    known = F.coalesce(F.col("interest_key").isin(keys), F.lit(False)) if keys else F.lit(False)
    shown = F.col("event_type") == "impression"
    n = events.agg(F.count("*"), F.count_if(shown), F.count_if(is_negative(F.col("event_type"))), F.count_if(~shown & ~known)).first()
    own = events.withColumn("user_id", F.lit(0))
    evidence: dict[str, float] = {}
    for h in ("long", "short"):
        mine = [i.key for i in profile.interests if (i.horizon == "short") == (h == "short")]
        if mine:
            evidence |= {r.interest_key: r.total for r in recommend.interest_deltas(own.where(F.col("interest_key").isin(mine) & ~shown), SIGNALS, now, h).collect()}
    spark = events.sparkSession
    rows = [(i.key, float(i.weight), float(evidence.get(i.key, 0.0)), i.negative) for i in profile.interests]
    after = {r.key: r.w for r in spark.createDataFrame(rows, "key string, w double, e double, negative boolean").select("key", moved(F.col("w"), F.col("e"), F.col("negative")).alias("w")).collect()} if rows else {}
    return replace(profile, interests=tuple(replace(i, weight=after[i.key]) for i in profile.interests)), Summary(*n, evidence)


def issued(items: DataFrame, reader: int, session: str, at: Column) -> DataFrame:
    """A feed's items as events of the kind 'issued': what was shown to whom, where, why and with which contributions, so that later
    feedback finds the features it answers to."""
    keep = F.struct("score", F.map_filter("contributions", lambda _, v: v != 0).alias("contributions"), "origins")
    return items.select(
        F.sha2(F.concat_ws(":", F.lit(session), F.lit(str(reader)), F.col("id").cast("string")), 256).alias("event_id"), F.lit(reader).cast("bigint").alias("user_id"), F.col("id").alias("paper"),
        F.lit("issued").alias("event_type"), F.lit(session).alias("session_id"), F.col("rank").alias("position"), at.alias("ts"), F.to_json(keep).alias("snapshot"),
    )


def answered(feedback: DataFrame, shown: DataFrame) -> DataFrame:
    """feedback(event_id, user_id, paper, session_id, ts) with the snapshot of the last time the paper was issued to the reader in that
    session, at or before the event; null where it never was. Bounded by what one session showed."""
    s = shown.select("user_id", "paper", "session_id", F.col("ts").alias("_at"), "snapshot")
    met = feedback.select("event_id", "user_id", "paper", "session_id", "ts").join(s, ["user_id", "paper", "session_id"]).where("_at <= ts")
    last = met.groupBy("event_id").agg(F.max_by("snapshot", "_at").alias("snapshot"))
    return feedback.join(last, "event_id", "left")


def contributions_of(snapshot: Column) -> Column:
    """The features a snapshot was issued with."""
    return F.from_json(snapshot, "score double, contributions map<string,double>, origins array<string>")["contributions"]
