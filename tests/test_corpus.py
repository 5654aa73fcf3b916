import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from bibliome.operators import corpus
from bibliome.operators.components import components
from bibliome.session import ensure_checkpoint_dir


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_random(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}


def test_components_chain_hub_and_empty(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(100, 200), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == brute_components(e for e in chain if e[0] != e[1])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_resolved_cuts_by_doi(spark):
    records = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, None), (5, None), (6, "x")], "record bigint, doi string")
    known = [(1, "doi", "x"), (1, "arxiv", "p"), (3, "doi", "y"), (3, "arxiv", "p"), (2, "pmid", "9"), (3, "pmid", "9"), (4, "pmid", "8"), (6, "doi", "x"), (5, "pmid", None)]
    got = {r.record: r.paper for r in corpus.resolved(records, spark.createDataFrame(known, "record bigint, id_type string, value string")).collect()}
    assert got[1] == got[6] == 1 and got[3] == got[2] == 2 and got[4] == 4 and got[5] == 5


def test_fuzzy_pairs_against_brute_force(spark):
    rng = random.Random(1)
    words = "deep marine model of proteins and samples in sediments after treatment".split()
    data = [(i, " ".join(rng.choices(words, k=6)), rng.choice(["ab", "cd"]), rng.choice([None, 2000, 2001, 2003]), rng.choice([None, None, "d1", "d2"])) for i in range(60)]
    df = spark.createDataFrame(data, "id bigint, title string, surname string, year int, doi string")

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {}
    for a, b in itertools.combinations(data, 2):
        s = len(grams(a[1]) & grams(b[1])) / len(grams(a[1]) | grams(b[1]))
        if a[2] == b[2] and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 1) and s >= 0.6 and not (a[4] and b[4] and a[4] != b[4]):
            want[(a[0], b[0])] = round(s, 9)
    assert {(r.a, r.b): round(r.similarity, 9) for r in corpus.fuzzy_pairs(df).collect()} == want
    assert corpus.fuzzy_pairs(spark.createDataFrame([(1, "Errata", "x", None, None), (2, "Errata", "x", None, None)], df.schema)).count() == 0


def test_fuzzy_pairs_of_titles_and_authors_in_any_script(spark, tmp_path):
    from bibliome import queries

    data = [
        (1, "Modèle de protéines β-amyloïdes", "Fójifelin H, Doe A.", "2001", None), (2, "Modele de proteines β-amyloides", "FÓJIFELIN H.", "2001", None),
        (3, "海洋堆積物的深層模型研究", "van der Jigusonik PA, Li B", None, None), (4, "海洋堆積物的深層模型研究", "van der Jigusonik P.", "1999", None),
        (5, "A survey of sediments — part one", "Kepo-Gepo IM", "2010", "10.1/a"), (6, "A survey of sediments – part one", "Kepo-Gepo I.", "2011", "10.1/a"),
        (7, "A survey of sediments – part one", "van der Gepo I.", "2011", None), (8, "A survey of sediments – part one", None, "2011", None), (9, None, "Kepo-Gepo I.", "2011", None),
        (10, "A survey of sediments - part one", "Kepo-Gepo I", "2011", "10.1/b"), (11, "A survey of sediments - part one", "Kepo-Gepo I", "2013", None),
    ]
    spark.createDataFrame(data, "article_id bigint, title string, author_string string, pub_year string, doi string").write.parquet(str(tmp_path / "epmc_article.parquet"))
    folded = {1: "modele de proteines β amyloides", 3: "海洋堆積物的深層模型研究", 5: "a survey of sediments part one"}
    title = {i: folded[1 if i < 3 else 3 if i < 5 else 5] for i, t, *_ in data if t}
    family = {1: "fojifelin", 2: "fojifelin", 3: "van der jigusonik", 4: "van der jigusonik", 7: "van der gepo"} | dict.fromkeys((5, 6, 10, 11), "kepo gepo")
    row = {r[0]: r for r in data}
    want = set()
    for a, b in itertools.combinations([i for i in title if i in family], 2):
        (*_, ya, da), (*_, yb, db) = row[a], row[b]
        if title[a] == title[b] and family[a] == family[b] and (ya is None or yb is None or abs(int(ya) - int(yb)) <= 1) and not (da and db and da != db):
            want.add((a, b, 1.0))
    assert want == {(1, 2, 1.0), (3, 4, 1.0), (5, 6, 1.0)}
    assert {tuple(r) for r in queries.QUERIES["dedup_trigram_pairs"](spark, str(tmp_path)).collect()} == want


def test_candidates_and_fold(spark):
    t = dt.datetime(2024, 1, 1)
    recs = [
        (1, "openalex", "o", "p", json.dumps({"display_name": " ", "title": "T <i>one</i>", "doi": "https://doi.org/10.1234/A", "publication_date": "2024-02-01", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "primary_location": {"source": {"display_name": "V"}, "license": "CC BY"}}), t),
        (2, "arxiv", "a", "p", json.dumps({"title": "T one", "abstract": "long abstract", "created": "2023-01-01", "journal-ref": " "}), t),
        (3, "pubmed", "m", "p", json.dumps({"title": "T 1", "abstract": "pm", "pub_date": "bad"}), t),
        (4, "biorxiv", "b", None, "{broken", t),
        (5, "europepmc", "e", "q", json.dumps({"title": None}), t),
    ]
    df = spark.createDataFrame(recs, "record_id bigint, source_key string, source_id string, paper_id string, payload string, fetched_at timestamp")
    c = {r.record_id: r for r in corpus.candidates(df).collect()}
    assert set(c) == {1, 2, 3} and c[1].abstract == "a b a" and c[1].licence == "cc-by" and c[1].title == "T one" and c[2].is_preprint and not c[2].is_peer_reviewed and c[3].published is None
    f = corpus.folded(corpus.candidates(df)).first()
    assert (f.records, f.title, f.abstract, f.doi, f.published, f.is_peer_reviewed, f.is_preprint) == (3, "T one", "pm", "10.1234/a", dt.date(2024, 2, 1), True, False)


def test_notices_locations_edges_upserts(spark):
    n = spark.createDataFrame([(1, "d", None, "concern"), (2, "d", None, "retracted"), (3, None, "5", "retracted")], "notice_id bigint, doi string, pmid string, status string")
    p = spark.createDataFrame([(10, "d", "5"), (11, None, None)], "paper bigint, doi string, pmid string")
    assert [tuple(r) for r in corpus.worst_status(n, p).collect()] == [(10, "retracted", 2)]
    loc = spark.createDataFrame([("p", "u", "repository", None, None, 1), ("p", "u", None, "cc-by", "x", 2), ("p", "v", "repository", None, None, 3)], "paper string, url string, host_type string, licence string, pdf_url string, at int")
    assert sorted((r.url, r.licence, r.is_best) for r in corpus.best_locations(loc).collect()) == [("u", "cc-by", True), ("v", None, False)]
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "z")], "from_doi string, to_doi string")
    ends = spark.createDataFrame([(1, "a"), (2, "b")], "paper bigint, doi string")
    assert [tuple(r) for r in corpus.edges(links, ends).collect()] == [(1, 2)]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "id bigint, v string")
    assert sorted(tuple(r) for r in corpus.upserted(old, new, ["id"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    own = spark.createDataFrame([("doi", "d", 5, 2, 1), ("doi", "d", 6, 1, 9)], "id_type string, value string, paper bigint, arrived int, record bigint")
    assert corpus.identifier_owners(own).first().paper == 6
    pend = corpus.pending(spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id bigint, updated_at int"), spark.createDataFrame([(1, 1), (3, 2)], "id bigint, source_updated_at int"))
    assert sorted(r.id for r in pend.collect()) == [2, 3]


def test_checkpoint_dir_is_the_clusters(spark):
    before = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before
    assert F.col("x") is not None
