import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliome.operators import evaluation, filters, fusion, lexical, semantic
from bibliome.plans.engine import Engine


def docs(spark):
    rows = [(1, "Deep learning", "models for proteins"), (2, "Protein models", "learning is deep here"), (3, "Marine life", None), (4, None, "deep sea"), (5, "Deep deep sea", "marine learning of seas")]
    return spark.createDataFrame(rows, "id bigint, title string, body string")


def found(spark, q):
    index = lexical.postings(docs(spark), "id", {"title": "A", "body": "C"})
    x, mode = lexical.lexical_search(index, q, 10)
    return {r.id for r in x.collect()}, mode


@pytest.mark.parametrize(("q", "ids", "mode"), [("deep learning", {1, 2, 5}, "strict"), ('"deep learning"', {1}, "strict"), ("deep -marine", {1, 2, 4}, "strict"), ("proteins or marine", {1, 2, 3, 5}, "strict"), ("deep volcano", {1, 2, 4, 5}, "relaxed"), ("deep -volcano nothing", set(), "strict"), ("the of", set(), "strict"), ("", set(), "strict")])
def test_query_language(spark, q, ids, mode):
    assert found(spark, q) == (ids, mode)


def test_many_queries_at_once_equal_single_ones(spark):
    index = lexical.postings(docs(spark), "id", {"title": "A", "body": "C"})
    texts = {"a": "deep learning", "b": '"deep sea"', "c": "nothing here"}
    many = lexical.evaluate_many(index, {k: lexical.parse(t) for k, t in texts.items()}, 5).collect()
    for k, t in texts.items():
        single, _ = lexical.lexical_search(index, t, 5, relax=False)
        assert [(r.id, round(r.score, 9)) for r in sorted((x for x in many if x.query == k), key=lambda x: x["rank"])] == [(r.id, round(r.score, 9)) for r in single.collect()]


def test_rank_laws():
    near, far = lexical.cover_density([(1, "a", 1.0), (2, "b", 1.0)], 2), lexical.cover_density([(1, "a", 1.0), (9, "b", 1.0)], 2)
    assert near > far > 0
    assert lexical.cover_density([(1, "a", 1.0), (2, "b", 1.0)], 2) > lexical.cover_density([(1, "a", 0.1), (2, "b", 0.1)], 2)
    assert lexical.cover_density([(1, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0), (4, "b", 1.0)], 2) > near
    assert lexical.stem("studies") == lexical.stem("study") and lexical.stem("models") == lexical.stem("model") and lexical.stem("modelling") == lexical.stem("modelled")


def test_semantic_and_index(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-(u @ u[3]))[:5].tolist()
    got = semantic.semantic_search(df, "id", "v", v[3].tolist(), 5).orderBy("rank").collect()
    assert [r.id for r in got] == want and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    index = semantic.build_index(df, "id", "v", 8)
    assert index.state == {"centres": 8, "rows": 200}
    assert [r.id for r in index.search(v[3].tolist(), 5, 8).orderBy("rank").collect()] == want
    index.drop()
    scan = semantic.interest_scan(df, "id", "v", [v[0].tolist(), v[1].tolist()], limit=3, band=(0.2, 0.4)).collect()
    best = np.maximum(u @ u[0], u @ u[1])
    assert [r.id for r in scan if r.kind == "top"] == np.argsort(-best)[:3].tolist()
    assert all(0.2 <= r.score <= 0.4 for r in scan if r.kind == "band")
    assert semantic.semantic_search(df.limit(0), "id", "v", [1.0] * 8, 5).count() == 0


def test_fusion(spark):
    rows = [(0, "a", 1, 1, 0.9), (0, "a", 2, 2, 0.1), (0, "b", 2, 1, 5.0), (0, "b", 3, 2, 5.0)]
    lists = spark.createDataFrame(rows, "query int, method string, id bigint, rank int, score double")
    r = {x.id: x for x in fusion.fuse(lists, 10).collect()}
    assert r[2].total == pytest.approx(1 / 62 + 1 / 61) and r[2].components == {"a": pytest.approx(1 / 62), "b": pytest.approx(1 / 61)} and r[2]["rank"] == 1
    w = {x.id: x.total for x in fusion.fuse(lists, 10, how="weighted", weights={"b": 0.5}).collect()}
    assert w == {1: 1.0, 2: 0.5, 3: 0.5}
    assert fusion.pool_depth(20) == 100 and fusion.pool_depth(3) == 50
    with pytest.raises(ValueError):
        fusion.fuse(lists, 1, how="x")


def plain_metrics(ranked, grades, k):
    rel = {i for i, g in grades.items() if g >= 2}
    dcg = lambda gs: sum((2**g - 1) / np.log2(p + 2) for p, g in enumerate(gs))
    ideal = dcg(sorted(grades.values(), reverse=True)[:k])
    top = ranked[:k]
    return (sum(i in rel for i in top) / k, sum(i in rel for i in top) / len(rel) if rel else 0, dcg([grades.get(i, 0) for i in top]) / ideal if ideal else 0, next((1 / (p + 1) for p, i in enumerate(ranked) if i in rel), 0))


def test_metrics_against_plain_python(spark):
    rng = random.Random(4)
    runs, grades, want = [], [], {}
    for q in range(5):
        g = {i: rng.choice([0, 1, 2, 3]) for i in range(12)} if q < 4 else {1: 0}
        grades += [(q, i, v) for i, v in g.items()]
        for m in "ab":
            order = rng.sample(range(16), 9)
            runs += [(q, m, i, p + 1) for p, i in enumerate(order)]
            want[(q, m)] = plain_metrics(order, g, 5)
    r = spark.createDataFrame(runs, "query int, method string, id bigint, rank int")
    g = spark.createDataFrame([*grades, (9, 1, None)], "query int, id bigint, grade int")
    got = {(x.query, x.method): (x.precision_5, x.recall_5, x.ndcg_5, x.rr) for x in evaluation.metrics(r, g, (5,)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert evaluation.mean_metrics(evaluation.metrics(r, g, (5,))).count() == 2
    cov = {(x.query, x.method): (x.pooled, x.judged, x.unjudged) for x in evaluation.coverage(r, g).collect()}
    assert len(cov) == 10 and all(u <= 9 and j <= p for p, j, u in cov.values())


def test_filters_and_pages(spark):
    rows = [(1, "2024-01-01", True, ["a"], "retracted"), (2, None, False, None, None), (3, "2024-03-01", False, ["b", "a"], "concern")]
    df = spark.createDataFrame(rows, "id bigint, day string, pre boolean, fields array<string>, status string").withColumn("day", F.col("day").cast("date"))
    cols = {"date": "day", "preprint": "pre", "fields": "fields", "retraction": "status"}
    ids = lambda **k: sorted(r.id for r in filters.filtered(df, filters.SearchFilters(**k), cols).collect())
    assert ids() == [2, 3] and ids(retraction="all") == [1, 2, 3] and ids(retraction="only") == [1, 3] and ids(fields=("a",)) == [3] and ids(preprints="only", retraction="all") == [1]
    assert [r.id for r in filters.newest_first(df, "day", "id", limit=2, offset=1).collect()] == [1, 2]
    assert {r.slug: r.papers for r in filters.field_counts(df, "fields").collect()} == {"a": 2, "b": 1, "unclassified": 1}
    ranked = spark.createDataFrame([(3, 1), (9, 2), (1, 3)], "id bigint, rank int")
    assert [r.id for r in filters.hydrate(ranked, df, "id").collect()] == [3, 1]


def test_plan_pushes_filters_and_columns(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "'en' AS lang", "'x' AS text", "id AS n_chars").write.parquet(str(tmp_path / "t"))
    df = filters.filtered(spark.read.parquet(str(tmp_path / "t")), filters.SearchFilters(languages=("en",)), {"language": "lang"}).select("doc_id")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_engine(spark):
    facts = spark.createDataFrame([(1, "p", None)], "facts_id bigint, paper_id string, feed_date date")
    e = Engine(spark, docs(spark), facts)
    for method in ("lexical", "semantic", "hybrid"):
        hits = e.search("deep\tlearning", method=method, limit=3).collect()
        assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1)) and hits[0].id in (1, 2, 5)
    with pytest.raises(ValueError):
        e.search("x", method="magic")
    assert {r.method for r in e.search_all("deep learning", limit=2).collect()} == {"lexical", "semantic", "hybrid"}
    assert e.paper(1).count() == 1 and e.paper(2).count() == 0
