import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bibliome.operators import recommend as R


def shown(spark, n=40, seed=0):
    rng = random.Random(seed)
    rows = [(0, i, rng.random(), rng.choice([0, 1, None]), [rng.choice("abcdef")], [rng.gauss(0, 1) for _ in range(4)] if i % 9 else None, i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "reader bigint, id bigint, score double, interest int, topics array<string>, vector array<double>, exploring boolean"), rows


@pytest.mark.parametrize("seed", range(3))
def test_diversified_laws(spark, seed):
    df, rows = shown(spark, seed=seed)
    by = {r[1]: r for r in rows}
    out = sorted(R.diversified(df, 10).collect(), key=lambda r: r.place)
    ids = [r.id for r in out]
    assert len(ids) == len(set(ids)) == 10 and [r.place for r in out] == list(range(1, 11))
    assert sum(by[i][6] for i in ids) <= 1  # a share of 0.15 of ten
    assert ids == [r.id for r in sorted(R.diversified(df.repartition(3), 10).collect(), key=lambda r: r.place)]


def test_near_duplicates_are_dropped_and_caps_relax(spark):
    rows = [(0, i, 1.0 - i / 100, 0, ["a"], [1.0, 0.0] if i < 3 else [0.0, 1.0], False) for i in range(6)]
    df = spark.createDataFrame(rows, "reader bigint, id bigint, score double, interest int, topics array<string>, vector array<double>, exploring boolean")
    assert [r.id for r in sorted(R.diversified(df, 5).collect(), key=lambda r: r.place)] == [0, 3]
    loose = df.withColumn("vector", F.lit(None).cast("array<double>"))
    assert len(R.diversified(loose, 5).collect()) == 5
    assert R.diversified(df.limit(0), 5).count() == 0
    assert [r.id for r in R.diversified(df, 5, R.Diversity(by="topics")).collect()] == [0]  # all share their one topic


def test_features_are_bounded_and_score(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)] if i else None, dt.date(2025, 5, 1), ["t"] if i % 2 else None, ["f"], ["u"], "V" if i % 3 else None, rng.random() * 20, i % 2 == 0, True, False, "retracted" if i == 5 else None, float(i) if i % 4 else None) for i in range(12)]
    schema = "facts_id bigint, vector array<double>, feed_date date, topic_ids array<string>, field_slugs array<string>, author_ids array<string>, venue_name string, venue_mean_citedness double, is_preprint boolean, is_peer_reviewed boolean, has_abstract boolean, retraction_status string, seen_days_ago double"
    facts = spark.createDataFrame(rows, schema)
    p = R.Profile((R.Interest("a", tuple(rows[1][1]), 2.0), R.Interest("b", tuple(rows[2][1]), 1.0, "short"), R.Interest("n", tuple(rows[3][1]), 1.0, negative=True)), topics=("t",), fields=("f",), authors=("x",), venues=("V",), preprint_appetite=0.5)
    f = R.features(facts, p, F.lit("2025-05-15").cast("date"))
    s = {r.facts_id: r for r in R.scored(f).collect()}
    assert len(s) == 12 and all(0 <= s[i][n] <= 1 for i in s for n in R.FEATURES)
    assert s[1].affinity_long == 1.0 and s[1].interest == 0 and s[3].negative_affinity == 1.0 and s[0].semantic_affinity == 0 and s[5].retracted == 1 and s[5].score < s[1].score
    assert all(abs(max(0.0, sum(s[i].contributions.values())) / R.Weights().reachable - s[i].score) < 1e-9 for i in s)
    empty = R.Profile()
    assert {r.novelty for r in R.features(facts, empty, F.lit("2025-05-15").cast("date")).collect()} == {0.5}
    assert R.features(facts.limit(0), p, F.lit("2025-05-15").cast("date")).count() == 0
    top = R.ranked(R.scored(f), "facts_id", 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3]
    lead = R.scored(f).select(R.leading(F.col("contributions")).alias("l")).first().l
    assert len(lead) <= 3


def test_profiles_and_weights():
    with pytest.raises(ValueError):
        R.Profile((R.Interest("a", (1.0,)), R.Interest("a", (1.0,))))
    with pytest.raises(ValueError):
        R.Weights({"x": 1.0})
    assert R.weights_for(R.Profile()).values == R.Weights().values
    assert R.weights_for(R.Profile(freshness_appetite=1.0)).values["freshness"] == pytest.approx(0.30)
    assert R.Weights.learned({"freshness": 5.0}).values["freshness"] == pytest.approx(1.15)


def test_sources_and_feedback(spark):
    ev = [(u, i, "click") for u in range(1, 6) for i in (1, 2)] + [(u, 3, "click") for u in (2, 3, 4)] + [(9, 4, "click"), (2, 5, "view")]
    df = spark.createDataFrame(ev, "user_id bigint, item bigint, event_type string")
    assert [(r.item, r.support, r.strength) for r in R.collaborative(df, 1, ("click",), 10).collect()] == [(3, 3, 0.6)]
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, "k", "save", t), (1, "k", "impression", t), (1, None, "save", t), (1, "k", "dismiss", t)], "user_id bigint, interest_key string, event_type string, ts timestamp")
    d = R.interest_deltas(e, R.SIGNALS, F.lit("2024-01-01").cast("timestamp")).first()
    assert d.total == pytest.approx(0.2)
    assert R.impression_rate(e, "save").first().rate == 2.0
    a = spark.createDataFrame([(i, "x", 1.0) for i in range(5)], "id bigint, origin string, strength double")
    b = spark.createDataFrame([(i, "y", 0.5) for i in range(3, 9)], "id bigint, origin string, strength double")
    pool = {r.id: r.agreement for r in R.within_budget([a, b], 8).collect()}
    assert set(pool) == {0, 1, 2, 3, 4, 5, 6} and pool[3] == 2
