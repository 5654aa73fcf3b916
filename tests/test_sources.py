import io
import json
import urllib.error

import pytest

from bibliome.sources import landing, paged, transports
from tests import served


def test_landed_pages(spark, tmp_path):
    (tmp_path / "oa.json").write_text(json.dumps({"results": [{"id": "W1", "title": "a"}, {"id": "W2"}]}))
    (tmp_path / "bio.json").write_text(json.dumps({"messages": [], "collection": [{"doi": "10.1101/x", "version": "2"}]}))
    (tmp_path / "epmc.json").write_text(json.dumps({"resultList": {"result": [{"id": "5", "source": "MED"}]}}))
    assert sorted(r.source_id for r in landing.read_source(spark, "openalex", str(tmp_path / "oa.json")).collect()) == ["W1", "W2"]
    assert landing.read_source(spark, "biorxiv", str(tmp_path / "bio.json")).first().source_id == "10.1101/xv2"
    assert landing.read_source(spark, "europepmc", str(tmp_path / "epmc.json")).first().source_id == "MED:5"
    with pytest.raises(ValueError):
        landing.read_source(spark, "nowhere", "")


def test_oai_records(spark, tmp_path):
    rec = '<record><header{s}><identifier>oai:{i}</identifier></header>{m}</record>'
    live = rec.format(s="", i=1, m="<metadata><arXiv><id>1706.1</id><title>T</title><authors><author><keyname>K</keyname></author></authors></arXiv></metadata>")
    gone = rec.format(s=' status="deleted"', i=2, m="")
    (tmp_path / "p.xml").write_text(f"<OAI-PMH><ListRecords>{live}{gone}</ListRecords></OAI-PMH>")
    rows = landing.arxiv_pages(spark, str(tmp_path / "p.xml")).collect()
    assert [r.source_id for r in rows] == ["1706.1"] and json.loads(rows[0].payload)["authors"]["author"][0]["keyname"] == "K"


def test_notices(spark, tmp_path):
    (tmp_path / "n.csv").write_text('Record ID,Title,OriginalPaperDOI,OriginalPaperPubMedID,Reason,\n1,"A, ""b""",10.1/x,,"X;Y",\n,"no id",10.1/y,,,\n3,neither,,,,\n')
    rows = landing.notices_csv(spark, str(tmp_path / "n.csv")).collect()
    assert [(r.record_id, r.title, r.reason) for r in rows] == [("1", 'A, "b"', "X;Y")]


def test_judgments_round_trip(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('// note\n\n{"query_id": "q", "paper_id": "b", "title": "B", "grade": 2}\n{"query_id": "q", "paper_id": "a", "title": "a", "retrieved_by": ["x"]}\n')
    df = landing.read_judgments(spark, str(tmp_path / "j.jsonl"))
    landing.write_judgments(df, str(tmp_path / "out"))
    again = landing.read_judgments(spark, str(tmp_path / "out"))
    assert [r.paper_id for r in again.collect()] == ["a", "b"] and again.where("grade IS NULL").count() == 1
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="not a judgment"):
        landing.read_judgments(spark, str(tmp_path / "bad.jsonl")).collect()
    landing.write_report({"a": 1}, str(tmp_path / "r" / "x.json"))
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"a": 1}


@pytest.fixture()
def pages(tmp_path):
    f = tmp_path / "pages.jsonl"
    f.write_text("\n".join(json.dumps({"records": [{"id": f"{p}{i}"} for i in range(2)]}) for p in "abc"))
    return str(f)


def test_paged_batch_and_stream(spark, pages, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("bibliome_paged").option("path", pages).option("source", "s")
    assert sorted(r.source_id for r in read.load().collect()) == ["a0", "a1", "b0", "b1", "c0", "c1"]
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for _ in range(2):
        q = spark.readStream.format("bibliome_paged").option("path", pages).option("source", "s").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(out).count() == 6


def test_cursors_batches_queries():
    c = paged.format_cursor("q", "2024-01-01", "2024-01-08", "*m")
    assert paged.parse_cursor(c, "q") == ("2024-01-01", "2024-01-08", "*m")
    for bad in (None, "", "x|y", c[:-2], c.replace("2024-01-08", "soon")):
        assert paged.parse_cursor(bad, "q") is None
    assert paged.parse_cursor(c, "other") is None
    assert paged.doi_batches(["a", "b", "a", "c,d", "e"], 2) == [["a", "b"], ["e"]]
    assert paged.windowed_query("x", "1", "2") == "(x) AND (UPDATE_DATE:[1 TO 2])"


def test_fetch_retries_and_paces():
    waits, calls = [], []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "2"}, None)
        return io.BytesIO(b"page")

    assert paged.fetch("http://x", {"a": "1"}, opener=opener, sleep=waits.append) == "page" and waits == [2.0, 2.0]

    def gone(url):
        raise urllib.error.HTTPError(url, 404, "gone", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        paged.fetch("http://x", opener=gone, sleep=waits.append)
    now = [0.0]
    slept = []
    bucket = paged.TokenBucket(2.0, 1, now=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    bucket.take()
    bucket.take()
    assert slept == [0.5]
    assert paged.wait_before(10, None, lambda: 1.0) == 60.0


def read_all(source, **options):
    page = transports.transport(source, options | {"get": "tests.served.get"})
    out, cursor = [], None
    while True:
        rows, cursor = page(cursor)
        out += [i for i, _ in rows]
        if cursor is None:
            return out


def test_every_transport_follows_its_pages():
    assert read_all("openalex", expression="f:1", since="2024-01-01") == ["W0", "W1"]
    assert served.ASKED[-1][1] == {"filter": "f:1,from_updated_date:2024-01-01", "per-page": "200", "cursor": "c1", "sort": "updated_date:asc"}
    assert read_all("arxiv", expression="cs") == ["2401.1", "2401.2"] and served.ASKED[-1][1] == {"verb": "ListRecords", "resumptionToken": "tok"}
    assert read_all("arxiv", expression="none") == []
    with pytest.raises(ValueError, match="badArgument"):
        read_all("arxiv", expression="bad")
    assert read_all("biorxiv", expression="medrxiv", since="2024-01-01", until="2024-01-08") == ["d0v2", "d1v2", "d2v2"] and served.ASKED[-1][0].endswith("/details/medrxiv/2024-01-01/2024-01-08/2")
    assert read_all("biorxiv_links", until="2024-01-08") == ["a>b"] and "/2024-01-01/2024-01-08/" in served.ASKED[-1][0]
    assert read_all("europepmc", expression="q", since="2024-01-01", until="2024-01-08") == ["MED:*", "MED:m2"] and served.ASKED[-1][1]["query"] == "(q) AND (UPDATE_DATE:[2024-01-01 TO 2024-01-08])"
    assert [i for i, _ in transports.works_by_doi([f"10.1/{n}" for n in range(60)] + ["10.1/a,b"], {"get": "tests.served.get"})] == [f"https://doi.org/10.1/{n}" for n in range(60)]
    with pytest.raises(ValueError):
        transports.transport("nowhere", {})


def test_transports_through_the_data_source(spark):
    spark.dataSource.register(paged.PagedSource)
    load = lambda **o: spark.read.format("bibliome_paged").options(get="tests.served.get", **o).load()
    got = load(source="biorxiv", expressions="biorxiv;medrxiv", since="2024-01-01", until="2024-01-08").collect()
    assert sorted(r.source_id for r in got) == sorted(["d0v2", "d1v2", "d2v2"] * 2) and {json.loads(r.payload)["server"] for r in got} == {"biorxiv", "medrxiv"}
    with pytest.raises(Exception, match="go on from cursor"):
        load(source="biorxiv", expressions="biorxiv", max_pages="1").collect()
    assert [r.source_id for r in load(source="biorxiv", expressions="biorxiv", cursor="2").collect()] == ["d2v2"]
