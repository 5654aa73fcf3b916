import datetime as dt
import json

import pytest

from bibliome.operators import normalise as N

OA = {
    "id": "https://openalex.org/W123456", "doi": "https://doi.org/10.1234/AbC", "title": "A <i>title</i> &amp; more", "type": "erratum", "language": "en", "publication_date": "2024-03-02", "cited_by_count": 7,
    "ids": {"openalex": "https://openalex.org/W123456", "pmid": "https://pubmed/00012", "mag": 99}, "abstract_inverted_index": {"world": [1], "Hello": [0]}, "open_access": {"oa_status": "gold", "oa_url": "http://x/1"},
    "authorships": [{"author": {"display_name": "Ana B", "orcid": "o", "id": "https://openalex.org/A5000"}, "institutions": [{"display_name": "I"}, {}]}, {"author": {}}, {"author": {"display_name": "Cy D"}}],
    "topics": [{"id": "https://openalex.org/T1111", "display_name": "T", "score": 0.5, "field": {"display_name": "F"}}, {"display_name": "no id"}], "keywords": [{"display_name": "k"}, {}],
    "primary_location": {"source": {"display_name": "J", "id": "https://openalex.org/S2222", "issn_l": "1-2", "type": "journal", "is_oa": True}},
    "locations": [
        {"is_oa": True, "landing_page_url": "http://x/1", "pdf_url": "http://x/1.pdf", "version": "publishedVersion", "license": "cc-by", "source": {"type": "journal", "display_name": "J"}},
        {"is_oa": True, "landing_page_url": "http://x/1", "source": {"type": "repository"}}, {"is_oa": False, "landing_page_url": "http://x/2"},
        {"is_oa": True, "landing_page_url": "https://arxiv.org/abs/2401.12345v2", "source": {"type": "repository", "display_name": "arXiv (Cornell)"}}, {"is_oa": True, "pdf_url": "http://y/3.pdf", "source": {"type": "repository", "display_name": "R"}},
    ],
}
EP = {
    "source": "MED", "title": "T", "pmid": "55", "pmcid": "PMC77", "doi": "10.1/bad", "language": "eng", "license": "cc by-nc", "isOpenAccess": "N", "abstractText": "<p>Abs</p>", "citedByCount": 3, "electronicPublicationDate": "2023-01-05",
    "journalInfo": {"journal": {"title": "Jour", "essn": "9-9"}}, "pubTypeList": {"pubType": ["Journal Article", "Review", "Retracted Publication", "odd"]}, "keywordList": {"keyword": ["a", " "]},
    "authorList": {"author": [{"fullName": "Loot C", "firstName": "Céline", "lastName": "Loot", "authorId": {"type": "ORCID", "value": "0-1"}, "authorAffiliationDetailsList": {"authorAffiliation": [{"affiliation": "Lab"}, {}]}}, {"fullName": "Millot G"}, {}]},
    "meshHeadingList": {"meshHeading": [{"descriptorName": "Mice", "majorTopic_YN": "Y"}, {"descriptorName": "Rats", "majorTopic_YN": "N"}, {}]},
    "fullTextUrlList": {"fullTextUrl": [
        {"availabilityCode": "S", "site": "DOI", "url": "https://doi.org/x", "documentStyle": "doi"}, {"availabilityCode": "OA", "site": "PubMedCentral", "url": "http://pmc/1", "documentStyle": "html"},
        {"availabilityCode": "OA", "site": "Europe_PMC", "url": "http://e/1", "documentStyle": "html"}, {"availabilityCode": "OA", "site": "Europe_PMC", "url": "http://e/1?pdf", "documentStyle": "pdf"},
    ]},
}
AX = {"id": "2401.00001v3", "title": "On x", "abstract": "A", "created": "2024-01-02", "categories": "cs.LG stat.ML", "license": "http://creativecommons.org/licenses/by/4.0/", "journal-ref": " ", "authors": {"author": [{"keyname": "Li", "forenames": "B."}, {"keyname": "Solo"}, {}]}}
BX = {"doi": "10.1101/2024.01.01.1", "title": "P", "date": "2024-01-09", "server": "medrxiv", "license": "CC_BY_ND", "category": "Zoology", "authors": "Loot, C.; ; Millot, G.", "version": "2", "published": "10.5555/final"}


@pytest.fixture(scope="module")
def made(spark):
    rows = [(1, "openalex", OA), (2, "europepmc", EP), (3, "arxiv", AX), (4, "biorxiv", BX), (5, "pubmed", {"title": "M", "doi": "10.1234/m", "pub_date": "2020-02-30", "journal": "J"}), (6, "europepmc", {"title": "no identifier"}), (7, "openalex", {"doi": "10.1234/x"}), (8, "elsewhere", {"title": "T"})]
    data = [(i, s, f"s{i}", json.dumps(p), None, "x") for i, s, p in rows] + [(9, "arxiv", "s", "{cut", None, "x"), (10, "arxiv", "s", None, None, "x")]
    df = spark.createDataFrame(data, "record_id bigint, source_key string, source_id string, payload string, fetched_at timestamp, title string")
    assert N.candidates_of(df.limit(0)).count() == 0
    c = N.candidates_of(df).cache()
    return {r.record_id: r for r in c.collect()}, c


def test_aggregator(made):
    r = made[0][1]
    assert (r.title, r.abstract, r.work_type, r.language, r.citation_count, r.oa_status) == ("A title & more", "Hello world", "correction", "en", 7, "gold")
    assert [(i.id_type, i.value) for i in r.identifiers] == [("openalex", "W123456"), ("doi", "10.1234/abc"), ("pmid", "12"), ("mag", "99"), ("arxiv", "2401.12345")]
    assert [(a.name, a.position, a.openalex_id, a.affiliations) for a in r.authors] == [("Ana B", 0, "A5000", ["I"]), ("Cy D", 2, None, [])]
    assert (r.venue.name, r.venue.openalex_id, r.venue.issn_l, r.venue.is_oa) == ("J", "S2222", "1-2", True)
    assert [(p.url, p.pdf_url, p.host_type, p.version, p.is_best) for p in r.locations] == [
        ("http://x/1", "http://x/1.pdf", "publisher", "publishedVersion", True), ("https://arxiv.org/abs/2401.12345v2", None, "preprint", "unknown", False), ("http://y/3.pdf", "http://y/3.pdf", "repository", "unknown", False),
    ]
    assert [(t.scheme, t.id, t.label, t.score, t.field) for t in r.topics] == [("openalex", "T1111", "T", 0.5, "F")] and r.keywords == ["k"] and r.published_date == dt.date(2024, 3, 2)


def test_europepmc(made):
    r = made[0][2]
    assert (r.work_type, r.language, r.oa_status, r.is_peer_reviewed, r.is_retracted_hint, r.is_preprint, r.abstract) == ("review", "en", "bronze", True, True, False, "Abs")
    assert [(i.id_type, i.value) for i in r.identifiers] == [("pmid", "55"), ("pmcid", "PMC77")]
    assert [(a.name, a.position, a.orcid, a.affiliations) for a in r.authors] == [("Céline Loot", 0, "0-1", ["Lab"]), ("Millot G", 1, None, [])]
    assert [(p.url, p.pdf_url, p.host_type, p.licence, p.source_name, p.is_best) for p in r.locations] == [("http://pmc/1", None, "repository", "cc-by-nc", "PubMedCentral", False), ("http://e/1", "http://e/1?pdf", "repository", "cc-by-nc", "Europe PMC", True)]
    assert [(t.id, t.score) for t in r.topics] == [("Mice", 1.0), ("Rats", None)] and r.keywords == ["a"] and (r.venue.name, r.venue.issn_l) == ("Jour", "9-9") and r.published_date == dt.date(2023, 1, 5)


def test_servers_and_pubmed(made):
    a, b, p = made[0][3], made[0][4], made[0][5]
    assert [x.name for x in a.authors] == ["B. Li", "Solo"] and a.locations[0].url == "https://arxiv.org/abs/2401.00001" and not a.is_peer_reviewed and [t.id for t in a.topics] == ["cs.LG", "stat.ML"]
    assert [(x.name, x.position) for x in b.authors] == [("Loot, C.", 0), ("Millot, G.", 2)] and b.preprint_of_doi == "10.5555/final" and b.venue.name == "medRxiv"
    assert b.locations[0].url == "https://www.medrxiv.org/content/10.1101/2024.01.01.1v2" and b.locations[0].licence == "cc-by-nd"
    assert p.published_date is None and p.venue.name == "J" and p.authors == [] and set(made[0]) == {1, 2, 3, 4, 5}


def test_children(made):
    assert N.children(made[1], "identifiers").where("record_id = 1").count() == 5 and {r.value for r in N.children(made[1], "keywords").collect()} == {"k", "a"}


@pytest.mark.parametrize(("payload", "want"), [({"hasBook": "Y", "pubTypeList": {"pubType": ["Review"]}}, "reference-entry"), ({"fullTextUrlList": {"fullTextUrl": [{"site": "NCBI_Bookshelf"}]}}, "reference-entry"), ({"source": "PPR"}, "preprint"), ({"pubTypeList": {"pubType": ["Letter", "Comment"]}}, "comment"), ({}, None)])
def test_work_types(spark, payload, want):
    df = spark.createDataFrame([(1, "europepmc", "s", json.dumps({"title": "t", "doi": "10.1234/a"} | payload), None)], "record_id bigint, source_key string, source_id string, payload string, fetched_at timestamp")
    assert N.candidates_of(df).first().work_type == want


