import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bibliome.operators import corpus
from bibliome.operators import ingest as I

T = dt.datetime(2024, 5, 1)
TODAY = "2025-06-01"
SCHEMA = "record_id bigint, source_key string, source_id string, payload string, fetched_at timestamp, note string"


def authors(*names):
    return {"author": [{"keyname": n, "forenames": "A."} for n in names]}


def rows():
    long = "Deep sediments of the northern shelf and what they keep"
    work = {"id": "https://openalex.org/W1000", "doi": "https://doi.org/10.1234/a", "title": long, "type": "article", "publication_date": "2024-01-05", "open_access": {"oa_status": "green"}, "authorships": [{"author": {"display_name": "Ann Olsen"}}], "topics": [{"id": "https://openalex.org/T1000", "display_name": "Mud"}], "keywords": [{"display_name": "Shelf"}]}
    epmc = {"source": "MED", "doi": "10.1234/A", "pmid": "9", "title": long + ".", "abstractText": "An abstract", "firstPublicationDate": "2024-01-07", "isOpenAccess": "Y", "keywordList": {"keyword": ["shelf", "core"]}, "authorList": {"author": [{"fullName": "Olsen A"}]}, "fullTextUrlList": {"fullTextUrl": [{"availabilityCode": "OA", "site": "Europe_PMC", "url": "http://e/1", "documentStyle": "html"}]}}
    pre = {"doi": "10.1101/p", "title": "A preprint about the shelf in winter", "date": "2023-10-01", "server": "biorxiv", "authors": "Olsen, A.", "published": "10.1234/a"}
    twin = {"id": "2401.00009", "title": long, "created": "2024-01-02", "authors": authors("Olsen"), "abstract": "x"}
    far = {"id": "2401.00010", "title": long, "created": "2024-01-02", "authors": authors("Berg"), "abstract": "x"}
    other = {"id": "2401.00011", "doi": "10.1234/zzz", "title": long, "created": "2024-01-02", "authors": authors("Olsen")}
    late = {"id": "2401.00012", "title": "A wholly different subject from the future", "created": "2199-01-01", "authors": authors("Li")}
    data = [(1, "openalex", "W1", work), (2, "europepmc", "MED:9", epmc), (3, "biorxiv", "p", pre), (4, "arxiv", "2401.00009", twin), (5, "arxiv", "2401.00010", far), (6, "arxiv", "2401.00011", other), (7, "arxiv", "2401.00012", late)]
    return [(i, s, k, json.dumps(p), T + dt.timedelta(days=i), "n") for i, s, k, p in data] + [(8, "arxiv", "cut", '{"id": "2401', T, "n"), (9, "arxiv", "none", None, T, "n")]


@pytest.fixture(scope="module")
def run(spark):
    return I.ingested(spark.createDataFrame(rows(), SCHEMA), F.lit(TODAY).cast("date"))


def test_records_find_their_papers(run):
    got = {r.record: (r.paper, r.rule) for r in run.resolved.collect()}
    assert got == {1: (1, "identifier"), 2: (1, "identifier"), 3: (3, "created"), 4: (1, "fuzzy_title_author"), 5: (5, "created"), 6: (6, "created"), 7: (7, "created")}
    assert {r.state: r.n for r in run.records.groupBy("state").agg(F.count("*").alias("n")).collect()} == {"new": 7, "bad": 2}
    assert {(r.source_key, r.state, r.records) for r in run.metrics().collect()} >= {("arxiv", "bad", 2), ("arxiv", "new", 4)}


def test_papers_take_over_fields(run):
    p = {r.paper: r for r in run.papers.collect()}
    assert p[1].doi == "10.1234/a" and p[1].abstract == "An abstract" and p[1].oa_status == "green" and p[1].is_peer_reviewed and not p[1].is_preprint and p[1].records == 3
    assert p[1].published_date == dt.date(2024, 1, 5) and p[1].first_seen_online == dt.date(2024, 1, 2) and p[1].authors[0].name == "Ann Olsen"
    assert [t.id for t in p[1].topics] == ["T1000"] and p[1].keywords == ["Shelf", "core"] and p[7].published_date is None
    assert [(e.from_paper, e.to_paper) for e in run.edges.collect()] == [(3, 1)]
    assert {(r.id_type, r.value, r.paper) for r in run.identifiers.collect()} >= {("doi", "10.1234/a", 1), ("pmid", "9", 1), ("arxiv", "2401.00009", 1), ("doi", "10.1101/p", 3)}
    best = {r.paper: r.url for r in run.locations.where("is_best").collect()}
    assert best[1] == "http://e/1" and best[3].endswith("10.1101/pv1")
    assert {r.name for r in run.venues.collect()} == {"arXiv", "bioRxiv"}


def test_unchanged_deliveries_are_skipped(spark, run):
    again = spark.createDataFrame([(20, "openalex", "W1", json.dumps(dict(reversed(list(json.loads(rows()[0][3]).items())))), T, "n"), (21, "openalex", "W2", '{"a": 1}', T, "n"), (22, "openalex", "W2", '{"a": 2}', T + dt.timedelta(1), "n")], SCHEMA)
    state = lambda **k: {r.record_id: r.state for r in I.delivered(again, run.records, **k).collect()}
    assert state() == {20: "same", 21: "same", 22: "new"} and state(force=True) == {20: "new", 21: "same", 22: "new"}
    assert I.delivered(again.limit(0)).count() == 0


def test_survivors_and_merge(spark):
    m = spark.createDataFrame([(1, "pmid", 10), (1, "doi", 20), (1, "arxiv", 30), (2, "pmid", 5), (2, "pmid", 4)], "record int, id_type string, paper int")
    assert {tuple(r) for r in I.survivors(m).collect()} == {(1, 20, 10), (1, 20, 30), (2, 4, 5)}
    pairs = spark.createDataFrame([(20, 10)], "winner int, loser int")
    ident = spark.createDataFrame([(20, "pmid", "1"), (10, "pmid", "1"), (10, "mag", "2")], "paper int, id_type string, value string")
    loc = spark.createDataFrame([(20, "u", None), (10, "u", "x"), (10, "v", None)], "paper int, url string, licence string")
    doi = spark.createDataFrame([(20, None), (10, "10.1/x"), (7, "10.1/y")], "paper int, doi string")
    i, p, d = I.merged(pairs, ident, loc, doi)
    assert {tuple(r) for r in i.collect()} == {(20, "pmid", "1"), (20, "mag", "2")} and {tuple(r) for r in p.collect()} == {(20, "u", "x"), (20, "v", None)} and {tuple(r) for r in d.collect()} == {(20, "10.1/x"), (7, "10.1/y")}


def test_unions_and_ranks(spark):
    df = spark.createDataFrame([("p", ["Deep Sea", "krill"], 1, "green"), ("p", ["KRILL", "deep sea ", "ice"], 2, "gold"), ("q", None, 1, "closed"), ("q", [None], 2, "odd")], "k string, w array<string>, at int, oa string")
    assert {r.k: r.w for r in corpus.united_keywords(df, "k", "w", "at").collect()} == {"p": ["Deep Sea", "krill", "ice"]}
    assert {r.k: r.s for r in df.groupBy("k").agg(corpus.most_open(F.col("oa")).alias("s")).collect()} == {"p": "gold", "q": "closed"}
