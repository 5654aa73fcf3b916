import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliome.operators import evaluation, filters, recommend
from bibliome.plans import feed as X
from bibliome.plans.engine import Engine

SCHEMA = "facts_id bigint, paper_id string, vector array<double>, feed_date date, topic_ids array<string>, field_slugs array<string>, author_ids array<string>, venue_name string, venue_mean_citedness double, is_preprint boolean, is_peer_reviewed boolean, has_abstract boolean, retraction_status string, seen_days_ago double"
TODAY = "2025-06-01"


def unit(angle):
    return [float(np.cos(angle)), float(np.sin(angle)), 0.0]


def facts(spark):
    def row(i, v, day="2025-05-20", topics=(), fields=(), authors=(), venue=None, status=None, reviewed=True, seen=None):
        return (i, f"p{i}", v, None if day is None else __import__("datetime").date.fromisoformat(day), list(topics), list(fields), list(authors), venue, 2.0, False, reviewed, True, status, seen)

    rows = [row(i, unit(i * 0.35), topics=["T1"] if i % 2 else ["T2"]) for i in range(12)]
    rows += [row(20, unit(0.8)), row(21, unit(0.85), topics=["bad"]), row(22, None, fields=["f1"]), row(23, unit(0.01), day="2020-01-01"), row(24, unit(0.03), status="retracted"), row(25, unit(0.02), reviewed=False), row(26, None, authors=["A1"], venue="V1"), row(27, None, day=None, fields=["f1"])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def profile():
    return recommend.Profile((recommend.Interest("i0", tuple(unit(0.0)), label="polar ice"), recommend.Interest("i1", (0.0, 0.0, 1.0), kind="paper", label="A paper")), fields=("f1",), authors=("A1",), blocked_topics=("bad",))


def test_whole_feed(spark, profile):
    f = X.build_feed(facts(spark), profile, F.lit(TODAY).cast("date"), budget=40, limit=10)
    rows = sorted(f.items.collect(), key=lambda r: r["rank"])
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids)) >= 6 and 21 not in ids and 23 not in ids and 27 not in ids
    assert f.diagnostics["blocked"] == 1 and f.diagnostics["missing_facts"] == 0 and set(f.diagnostics["contributions"]) == {"semantic_interest", "field", "author", "exploration"}
    by = {r.id: r for r in rows}
    assert by[ids[0]].reasons[0] == "matches your interest in polar ice"
    assert 22 not in by or by[22].reasons == ["in f1", "published recently"]
    assert 0 <= f.diagnostics["diversity"] <= 1


def test_sources_and_budget(spark, profile):
    s = X.sources_of(facts(spark), profile, F.lit(TODAY).cast("date"), budget=40)
    assert {r.id for r in s["field"].collect()} == {22} and {r.detail for r in s["author"].collect()} == {"A1"}
    assert all(0.6 <= r.strength <= 0.8 for r in s["exploration"].collect())
    c = lambda n, lo: spark.createDataFrame([(i, n, float(i % 7), "") for i in range(lo, lo + 30)], "id bigint, origin string, strength double, detail string")
    pool, told = X.gathered({"a": c("a", 0), "b": c("b", 10), "exploration": c("exploration", 100)}, 20, {"a": 4})
    assert told == {"a": 4, "b": 8, "exploration": 3} and pool.count() <= 20 and {r.id for r in pool.where("exists(reasons, r -> r.origin = 'a')").collect()} == {6, 13, 20, 27}
    with pytest.raises(ValueError):
        X.gathered({})


def test_behavioural_sources(spark, profile):
    t = lambda n: __import__("datetime").datetime(2025, 5, n)
    ev = spark.createDataFrame([(1, u, i, "save", t(1 + u)) for u, i in [(1, 0), (2, 0), (3, 0), (4, 0), (2, 9), (3, 9), (4, 9), (2, 8)]] + [(9, 1, 22, "save", t(9))], "event_id bigint, user_id bigint, item bigint, event_type string, ts timestamp")
    s = X.sources_of(facts(spark), profile, F.lit(TODAY).cast("date"), events=ev, reader=1)
    assert [(r.id, r.detail) for r in s["collaborative"].collect()] == [(9, "3 readers")]
    assert s["sequential"].count() == 0  # the only other paper of that field has no date
    f = X.build_feed(facts(spark), profile, F.lit(TODAY).cast("date"), events=ev, reader=1, limit=20)
    assert "read by people with interests like yours (3 readers)" in {r.id: r.reasons for r in f.items.collect()}[9]


def test_feed_without_interests(spark):
    f = X.build_feed(facts(spark), recommend.Profile(), F.lit(TODAY).cast("date"), limit=5)
    assert f.items.count() == 5 and f.diagnostics["interest_coverage"] == {}


def test_engine_stores_filters_and_many_queries(spark, tmp_path):
    rows = [(1, "Deep learning", "models for proteins", "2024-01-01", "en"), (2, "Protein models", "learning is deep here", "2024-02-01", "de"), (3, "Marine life", None, None, "en"), (4, None, "deep sea", "2024-03-01", "en"), (5, "Deep learning", "models for proteins", "2024-05-01", "en")]
    texts = spark.createDataFrame(rows, "id bigint, title string, body string, day string, lang string").withColumn("day", F.col("day").cast("date"))
    records = spark.createDataFrame([(1, "arxiv"), (5, "pubmed"), (4, "pubmed")], "id bigint, source_key string")
    make = lambda: Engine(spark, texts, facts(spark), store=str(tmp_path / "store"), columns={"date": "day", "language": "lang"}, records=records)
    first = make()
    r = first.answer("deep learning", method="lexical", limit=3)
    assert [h.id for h in r.hits.collect()] == [5, 1, 2] and r.mode == "strict" and r.unit.startswith("cover") and {"title", "day", "lang"} <= set(r.hits.columns)
    again = make()  # reads what the first one wrote
    plan = again._of(["deep"]).select("term")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and [h.id for h in again.search("deep learning", method="lexical", limit=3).collect()] == [5, 1, 2]
    only = lambda **k: {h.id for h in again.search("deep learning", f=filters.SearchFilters(**k), limit=5).collect()}
    assert only(languages=("de",)) == {2} and only(sources=("pubmed",)) == {4, 5} and only(published_from=__import__("datetime").date(2024, 2, 15)) == {4, 5}
    with pytest.raises(ValueError):
        again.search("deep", f=filters.SearchFilters(open_access_only=True))
    assert {h.id for h in again.search("-deep", method="lexical").collect()} == {3}
    many = again.run_all({"a": "deep learning", "b": "marine"}, limit=3)
    lists = {(r.query, r.method): [] for r in many.collect()}
    for r in sorted(many.collect(), key=lambda r: r["rank"]):
        lists[(r.query, r.method)].append(r.id)
    assert lists[("b", "lexical")] == [3] and lists[("b", "hybrid")][0] == 3 and set(lists[("a", "lexical")]) <= {1, 2, 4, 5}


def test_feed_reports(spark):
    feed = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 12, 1)], "feed int, id int, rank int")
    grades = spark.createDataFrame([(1, 10, 3), (1, 11, 0), (2, 99, 2), (3, 12, 2)], "feed int, id int, grade int")
    got = {r.feed: (r.judged, r.precision, r.ndcg, r.reportable) for r in evaluation.feed_scores(feed, grades, 2).collect()}
    assert got == {1: (2, 0.5, 1.0, True), 2: (0, None, None, False), 3: (1, 0.5, 1.0, True)}
    runs = spark.createDataFrame([(1, "m", 10, 1), (1, "n", 10, 1), (1, "m", 11, 2)], "query int, method string, id int, rank int")
    assert tuple(evaluation.overall(runs, spark.createDataFrame([(1, 10, 2)], "query int, id int, grade int")).first()) == (1, 2, 0.5)
    j = spark.createDataFrame([("q", "p", None, "t", None, None)], "query_id string, paper_id string, grade int, title string, judge string, judged_at string")
    j = evaluation.graded(evaluation.graded(j, "q", "p", 3, "me", "now"), "q", "x", 1, "me", "now")
    assert {(r.paper_id, r.grade, r.judge) for r in j.collect()} == {("p", 3, "me"), ("x", 1, "me")} and evaluation.grade_map(j).first().grades == {"p": 3, "x": 1}
    with pytest.raises(ValueError):
        evaluation.graded(j, "q", "p", 4, "me", "now")
    assert evaluation.intra_list_diversity(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id int, vector array<double>")) == 1.0
