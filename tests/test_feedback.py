import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from bibliome.functions.embedding import HashedWords
from bibliome.operators.recommend import Interest, Profile
from bibliome.plans import embedding as E
from bibliome.plans import feedback as X

NOW = dt.datetime(2025, 6, 1)
EV = "event_id bigint, user_id bigint, interest_key string, event_type string, ts timestamp"


def events(spark, *rows):
    return spark.createDataFrame([(n, 1, k, e, NOW - dt.timedelta(days=d)) for n, (k, e, d) in enumerate(rows)], EV)


def test_evidence_moves_weights(spark):
    p = Profile((Interest("a", (1.0,), 1.0), Interest("b", (1.0,), 1.0, "short"), Interest("n", (1.0,), 1.0, negative=True), Interest("z", (1.0,), 0.1), Interest("q", (1.0,), 7.0)))
    ev = events(spark, ("a", "save", 0), ("a", "impression", 0), ("b", "save", 10), ("n", "less_like_this", 0), ("z", "block_topic", 0), (None, "save", 0), ("gone", "open", 0))
    after, told = X.applied(p, ev, F.lit(NOW).cast("timestamp"))
    w = {i.key: i.weight for i in after.interests}
    soft = lambda x: 3 * math.tanh(x / 3)
    assert w == {"a": pytest.approx(soft(1.5)), "b": pytest.approx(soft(1.25)), "n": pytest.approx(soft(1.5)), "z": 0.0, "q": 7.0}
    assert (told.considered, told.impressions, told.negatives, told.unattributed) == (7, 1, 2, 2) and told.evidence["a"] == pytest.approx(0.5)
    again, none = X.applied(Profile(), ev.limit(0), F.lit(NOW).cast("timestamp"))
    assert again == Profile() and none.considered == 0
    table = spark.createDataFrame([(1, i.key, i.weight, i.horizon, i.negative) for i in p.interests] + [(2, "a", 1.0, "long", False)], "user_id bigint, key string, weight double, horizon string, negative boolean")
    got = {(r.user_id, r.key): r.weight for r in X.reweighted(table, ev, F.lit(NOW).cast("timestamp")).collect()}
    assert got == {(1, k): pytest.approx(v) for k, v in w.items()} | {(2, "a"): 1.0}


def test_only_outright_noes_are_noes(spark):
    x = spark.createDataFrame([(e,) for e in ("impression", "open", "dismiss", None)], "e string").select(X.is_negative(F.col("e")).alias("n")).collect()
    assert [r.n for r in x] == [False, False, True, False]


def test_snapshots_answer_feedback(spark):
    items = spark.createDataFrame([(1, 10, 0.5, {"freshness": 0.1, "novelty": 0.0}, ["topic"])], "rank int, id bigint, score double, contributions map<string,double>, origins array<string>")
    at = lambda h: F.lit(NOW + dt.timedelta(hours=h)).cast("timestamp")
    shown = X.issued(items, 7, "s1", at(0)).unionByName(X.issued(items.withColumn("score", F.lit(0.9)), 7, "s1", at(2))).unionByName(X.issued(items, 7, "s2", at(0)))
    fb = spark.createDataFrame([("e1", 7, 10, "s1", NOW + dt.timedelta(hours=1)), ("e2", 7, 10, "s1", NOW + dt.timedelta(hours=3)), ("e3", 7, 11, "s1", NOW)], "event_id string, user_id bigint, paper bigint, session_id string, ts timestamp")
    got = {r.event_id: (r.snapshot, r.c) for r in X.answered(fb, shown).withColumn("c", X.contributions_of(F.col("snapshot"))).collect()}
    assert '"score":0.5' in got["e1"][0] and '"score":0.9' in got["e2"][0] and got["e3"][0] is None and got["e1"][1] == {"freshness": 0.1}


def test_vectors_are_kept_up(spark):
    papers = spark.createDataFrame([(i, f"title {i}", "x" * 50 if i % 2 else None, NOW) for i in range(70)], "id bigint, title string, abstract string, updated_at timestamp")
    enc = HashedWords(16)
    none = E.encoded(papers.limit(0), papers.select("id").limit(0), enc, enc.model_key)
    todo = E.pending_papers(papers, none, enc.model_key, limit=40)
    b = E.batches(todo, enc.model_key).orderBy("batch").collect()
    assert [len(r.ids) for r in b] == [32, 8] and len({r.dedup_key for r in b}) == 2 and b[0].ids == list(range(32))
    one = E.refreshed(papers, none, enc, limit=40).cache()
    assert one.count() == 40 and E.invariant(one, enc).count() == 0 and one.where("title_only").count() == 20
    two = E.refreshed(papers, one, enc)
    assert two.count() == 70 and two.select("id", "model_key").distinct().count() == 70
    with pytest.raises(ValueError):
        E.encoded(papers, papers, enc, "another")
    assert E.merged_statistics([{"vectors": 2}, {"vectors": 3, "title_only": 1}]) == {"vectors": 5, "title_only": 1}
