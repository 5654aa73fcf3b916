"""Raw records of each source as candidates of one shape, every field of it a native expression over the parsed payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliome.functions import dates, ids, text

#: Types of publication as Europe PMC names them (in lower case), with the type they stand for here.
PUBLICATION_TYPES = {
    "journal article": "article", "research-article": "article", "case reports": "article", "case-report": "article", "case-study": "article", "clinical trial": "article",
    "clinical trial protocol": "article", "randomized controlled trial": "article", "observational study": "article", "historical article": "article", "brief-report": "article",
    "data-paper": "article", "protocol": "article", "review": "review", "review-article": "review", "systematic review": "review", "scoping review": "review", "meta-analysis": "review",
    "preprint": "preprint", "conference-paper": "conference-paper", "proceedings-article": "conference-paper", "chapter": "book-chapter", "book chapter": "book-chapter",
    "book-chapter": "book-chapter", "book": "book", "study guide": "reference-entry", "book-review": "book-review", "book review": "book-review", "abstract": "abstract", "congress": "abstract",
    "meeting abstract": "abstract", "published erratum": "correction", "erratum": "correction", "correction": "correction", "expression of concern": "correction",
    "retraction of publication": "retraction-notice", "retraction notice": "retraction-notice", "editorial": "editorial", "editorial-material": "editorial", "comment": "comment",
    "letter": "letter", "news": "paratext", "obituary": "paratext", "introduction": "paratext", "in brief": "paratext", "in-brief": "paratext", "addresses": "paratext", "oration": "paratext",
    "addendum": "paratext",
}
#: Which of several types a record is given, the first that it has.
TYPE_ORDER = ("review", "article", "conference-paper", "preprint", "book-chapter", "book", "reference-entry", "book-review", "abstract", "correction", "retraction-notice", "editorial", "comment", "letter", "paratext")
RETRACTED_TYPES = ("retracted publication", "retracted-article")
#: ISO 639-2 codes and the two-letter codes kept here.
LANGUAGES = {"eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "chi": "zh", "zho": "zh", "jpn": "ja", "kor": "ko", "dut": "nl", "nld": "nl", "pol": "pl", "tur": "tr"}
#: A preprint server's licence codes.
SERVER_LICENCES = {"cc0": "cc0", "cc_by": "cc-by", "cc_by_sa": "cc-by-sa", "cc_by_nc": "cc-by-nc", "cc_by_nd": "cc-by-nd", "cc_by_nc_nd": "cc-by-nc-nd", "cc_no": "biorxiv-no-reuse"}
#: Databases of reviewed literature, sites that are repositories, and codes of links anybody may read.
REVIEWED_DATABASES, REPOSITORY_SITES, FREE = ("MED", "PMC", "AGR", "CBA"), ("europe_pmc", "pubmedcentral", "ncbi_bookshelf"), ("OA", "F")
PREFERRED_SITE, SERVERS = "Europe_PMC", {"biorxiv": "bioRxiv", "medrxiv": "medRxiv"}
#: An aggregator's types that count as reviewed, and its kinds of publishing hosts.
REVIEWED_TYPES, PUBLISHING_HOSTS = ("article", "review", "conference-paper"), ("journal", "conference", "book series", "ebook platform")

_IDENTIFIER = "struct<id_type:string,value:string>"
_AUTHOR = "struct<name:string,position:int,orcid:string,openalex_id:string,affiliations:array<string>>"
_VENUE = "struct<name:string,openalex_id:string,issn_l:string,publisher:string,venue_type:string,is_oa:boolean>"
_TOPIC = "struct<scheme:string,id:string,label:string,score:double,field:string,domain:string>"
_LOCATION = "struct<url:string,pdf_url:string,host_type:string,version:string,licence:string,source_name:string,is_best:boolean>"
#: What a candidate tells besides record_id, source_key, source_id and fetched_at.
CANDIDATE = {
    "title": "string", "identifiers": f"array<{_IDENTIFIER}>", "abstract": "string", "authors": f"array<{_AUTHOR}>", "venue": _VENUE, "published_date": "date", "first_seen_online": "date",
    "is_preprint": "boolean", "is_peer_reviewed": "boolean", "work_type": "string", "language": "string", "topics": f"array<{_TOPIC}>", "keywords": "array<string>", "citation_count": "bigint",
    "oa_status": "string", "locations": f"array<{_LOCATION}>", "is_retracted_hint": "boolean", "preprint_of_doi": "string",
}

_SOURCE = "struct<id:string,display_name:string,type:string,issn_l:string,host_organization_name:string,is_oa:boolean>"
_PLACE = f"struct<is_oa:boolean,landing_page_url:string,pdf_url:string,version:string,license:string,source:{_SOURCE}>"
PAYLOADS = {
    "openalex": (
        "id string, doi string, title string, display_name string, type string, language string, publication_date string, cited_by_count bigint, is_retracted boolean,"
        " ids struct<openalex:string,doi:string,pmid:string,pmcid:string,mag:string>, abstract_inverted_index map<string,array<int>>, open_access struct<oa_status:string,oa_url:string>,"
        " authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>,"
        " topics array<struct<id:string,display_name:string,score:double,field:struct<display_name:string>,domain:struct<display_name:string>>>, keywords array<struct<display_name:string>>,"
        f" primary_location {_PLACE}, best_oa_location {_PLACE}, locations array<{_PLACE}>"
    ),
    "europepmc": (
        "source string, title string, abstractText string, doi string, pmid string, pmcid string, language string, license string, isOpenAccess string, hasBook string, citedByCount bigint,"
        " firstPublicationDate string, electronicPublicationDate string, journalInfo struct<printPublicationDate:string,journal:struct<title:string,issn:string,essn:string>>,"
        " bookOrReportDetails struct<publisher:string>, pubTypeList struct<pubType:array<string>>, keywordList struct<keyword:array<string>>,"
        " authorList struct<author:array<struct<fullName:string,firstName:string,lastName:string,authorId:struct<type:string,value:string>,authorAffiliationDetailsList:struct<authorAffiliation:array<struct<affiliation:string>>>>>>,"
        " meshHeadingList struct<meshHeading:array<struct<descriptorName:string,majorTopic_YN:string>>>, commentCorrectionList struct<commentCorrection:array<struct<type:string>>>,"
        " fullTextUrlList struct<fullTextUrl:array<struct<availabilityCode:string,documentStyle:string,site:string,url:string>>>"
    ),
    "pubmed": "title string, abstract string, doi string, pmid string, pub_date string, journal string, license string, language string",
    "arxiv": (
        "id string, title string, abstract string, doi string, created string, categories string, license string, `journal-ref` string,"
        " authors struct<author:array<struct<keyname:string,forenames:string>>>"
    ),
    "biorxiv": "doi string, title string, abstract string, date string, server string, license string, category string, authors string, version string, published string",
}


def mapped(table: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def language(code: Column) -> Column:
    """Two letters where known, else the code in lower case; null for a blank one."""
    low = F.nullif(F.lower(F.trim(code)), F.lit(""))
    return F.coalesce(mapped(LANGUAGES, low), low)


def licence(code: Column) -> Column:
    """'CC BY-NC' -> 'cc-by-nc'; null for a blank one."""
    return F.nullif(F.regexp_replace(F.lower(text.squeeze(code)), " ", "-"), F.lit(""))


def server_licence(code: Column) -> Column:
    low = F.nullif(F.lower(F.trim(code)), F.lit(""))
    return F.coalesce(mapped(SERVER_LICENCES, low), low)


def is_open_licence(code: Column) -> Column:
    """Whether the licence lets the full text be kept and processed: a Creative Commons or public domain address, or such a code."""
    low = F.lower(code)
    return F.coalesce(low.contains("creativecommons.org") | low.contains("publicdomain") | low.isin("cc0", "cc-by", "cc-by-sa"), F.lit(False))


def listed_authors(packed: Column) -> Column:
    """'Loot, C.; Millot, G.' -> authors with their place in the list; blanks keep their place but are no author."""
    each = F.transform(F.split(packed, ";"), lambda n, i: F.struct(text.display_text(n).alias("name"), i.cast("int").alias("position")))
    return F.transform(F.filter(each, lambda a: a["name"].isNotNull()), lambda a: _author(a["name"], a["position"]))


def _author(name: Column, position: Column, orcid: Column | None = None, openalex: Column | None = None, affiliations: Column | None = None) -> Column:
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    return F.struct(name.alias("name"), position.cast("int").alias("position"), (orcid if orcid is not None else none).alias("orcid"), (openalex if openalex is not None else none).alias("openalex_id"), F.coalesce(affiliations if affiliations is not None else empty, empty).alias("affiliations"))


def _identifiers(*pairs: tuple[str, Column]) -> Column:
    """Those that can be read, each once."""
    each = F.array(*[F.struct(F.lit(t).alias("id_type"), ids.NORMALISERS[t](c).alias("value")) for t, c in pairs])
    return F.array_distinct(F.filter(each, lambda x: x["value"].isNotNull()))


def _topic(scheme: str, of: Column, label: Column, score: Column | None = None, field: Column | None = None, domain: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(scheme).alias("scheme"), of.alias("id"), label.alias("label"), (score if score is not None else F.lit(None).cast("double")).alias("score"), (field if field is not None else none).alias("field"), (domain if domain is not None else none).alias("domain"))


def _venue(name: Column, kind: Column, is_oa: Column, openalex: Column | None = None, issn: Column | None = None, publisher: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    made = F.struct(name.alias("name"), (openalex if openalex is not None else none).alias("openalex_id"), (issn if issn is not None else none).alias("issn_l"), (publisher if publisher is not None else none).alias("publisher"), kind.alias("venue_type"), F.coalesce(is_oa, F.lit(False)).alias("is_oa"))
    return F.when(name.isNotNull(), made)


def _location(url: Column, pdf: Column, host: Column, version: Column, licence_: Column, name: Column, best: Column) -> Column:
    return F.struct(url.alias("url"), pdf.alias("pdf_url"), host.alias("host_type"), version.alias("version"), licence_.alias("licence"), name.alias("source_name"), F.coalesce(best, F.lit(False)).alias("is_best"))


def host_type(source: Column) -> Column:
    """Publisher, repository, preprint server or unknown, by what an aggregator says of a location's source."""
    kind, name = F.lower(source["type"]), F.lower(F.coalesce(source["display_name"], F.lit("")))
    server = reduce(lambda a, b: a | b, [name.contains(w) for w in ("arxiv", "biorxiv", "medrxiv", "preprint")])
    return F.when(kind == "repository", F.when(server, "preprint").otherwise("repository")).when(kind.isin(*PUBLISHING_HOSTS), "publisher").otherwise("unknown")


def _openalex(j: Column) -> dict[str, Column]:
    title = F.coalesce(text.display_text(j["title"]), text.display_text(j["display_name"]))
    kind = F.nullif(F.lower(j["type"]), F.lit(""))
    kind = F.when(kind == "erratum", "correction").otherwise(kind)
    of_places = F.flatten(F.transform(j["locations"], lambda p: F.array(ids.arxiv_of_url(p["landing_page_url"]), ids.arxiv_of_url(p["pdf_url"]))))
    arxiv = F.transform(F.array_compact(F.coalesce(of_places, F.array().cast("array<string>"))), lambda v: F.struct(F.lit("arxiv").alias("id_type"), v.alias("value")))
    by_doi = F.when(F.lower(j["doi"]).contains("arxiv"), F.regexp_replace(F.lower(j["doi"]), r"^https?://[^/]+/", ""))
    own = _identifiers(("openalex", F.coalesce(j["ids"]["openalex"], j["id"])), ("doi", F.coalesce(j["ids"]["doi"], j["doi"])), ("pmid", j["ids"]["pmid"]), ("pmcid", j["ids"]["pmcid"]), ("mag", j["ids"]["mag"]))
    authors = F.transform(j["authorships"], lambda a, i: _author(text.display_text(a["author"]["display_name"]), i, a["author"]["orcid"], ids.openalex(a["author"]["id"]), F.filter(F.transform(a["institutions"], lambda x: x["display_name"]), lambda x: F.length(x) > 0)))
    best = F.coalesce(F.nullif(j["best_oa_location"]["landing_page_url"], F.lit("")), j["open_access"]["oa_url"])
    free = F.filter(j["locations"], lambda p: F.coalesce(p["is_oa"], F.lit(False)) & (F.length(F.coalesce(p["landing_page_url"], p["pdf_url"])) > 0))
    urls = F.transform(free, lambda p: F.coalesce(p["landing_page_url"], p["pdf_url"]))
    first = F.filter(free, lambda p, i: F.array_position(urls, F.coalesce(p["landing_page_url"], p["pdf_url"])) == i + 1)
    places = F.transform(first, lambda p: _location(F.coalesce(p["landing_page_url"], p["pdf_url"]), p["pdf_url"], host_type(p["source"]), F.coalesce(p["version"], F.lit("unknown")), p["license"], text.display_text(p["source"]["display_name"]), F.coalesce(p["landing_page_url"], p["pdf_url"]) == best))
    source = j["primary_location"]["source"]
    day = dates.iso_date(j["publication_date"])
    return {
        "title": title, "identifiers": F.array_distinct(F.concat(own, arxiv, _identifiers(("arxiv", by_doi)))), "abstract": text.display_text(text.inverted_text(j["abstract_inverted_index"])),
        "authors": F.filter(authors, lambda a: a["name"].isNotNull()), "published_date": day, "first_seen_online": day,
        "venue": _venue(text.display_text(source["display_name"]), source["type"], source["is_oa"], ids.openalex(source["id"]), source["issn_l"], text.display_text(source["host_organization_name"])),
        "is_preprint": F.coalesce(kind == "preprint", F.lit(False)), "is_peer_reviewed": F.coalesce(kind.isin(*REVIEWED_TYPES), F.lit(False)), "work_type": kind, "language": j["language"],
        "topics": F.transform(F.filter(j["topics"], lambda t: F.length(t["id"]) > 0), lambda t: _topic("openalex", F.coalesce(ids.openalex(t["id"]), t["id"]), t["display_name"], t["score"], t["field"]["display_name"], t["domain"]["display_name"])),
        "keywords": F.filter(F.transform(j["keywords"], lambda k: k["display_name"]), lambda k: F.length(k) > 0), "citation_count": j["cited_by_count"],
        "oa_status": F.coalesce(F.nullif(j["open_access"]["oa_status"], F.lit("")), F.lit("unknown")), "locations": places, "is_retracted_hint": F.coalesce(j["is_retracted"], F.lit(False)),
    }


def publication_types(j: Column) -> Column:
    """A Europe PMC record's types, in lower case."""
    return F.coalesce(F.filter(F.transform(j["pubTypeList"]["pubType"], lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 0), F.array().cast("array<string>"))


def is_bookshelf(j: Column) -> Column:
    """A chapter of a reference work: the record has a book, or a full text on the bookshelf; its types can't tell."""
    shelf = F.exists(F.coalesce(j["fullTextUrlList"]["fullTextUrl"], F.array()), lambda u: F.coalesce(F.lower(F.trim(u["site"])) == "ncbi_bookshelf", F.lit(False)))
    return F.coalesce(j["hasBook"] == "Y", F.lit(False)) | shelf


def work_type(j: Column, preprint: Column) -> Column:
    """Bookshelf chapters first, then preprints, then the most telling of the record's types; null where none is known."""
    place = F.create_map(*[F.lit(x) for kv in {k: TYPE_ORDER.index(v) for k, v in PUBLICATION_TYPES.items()}.items() for x in kv])
    least = F.array_min(F.filter(F.transform(publication_types(j), lambda t: place[t]), lambda n: n.isNotNull()))
    return F.when(is_bookshelf(j), "reference-entry").when(preprint, "preprint").otherwise(F.get(F.array(*map(F.lit, TYPE_ORDER)), least))


def site_locations(j: Column, preprint: Column) -> Column:
    """One location per site of the links anybody may read, in the order the sites occur: its landing page, or its PDF where it has
    no page, with its first PDF beside. The preferred site's is the best, else the first."""
    free = F.filter(F.coalesce(j["fullTextUrlList"]["fullTextUrl"], F.array()), lambda u: (F.length(u["url"]) > 0) & u["availabilityCode"].isin(*FREE))
    named = F.transform(free, lambda u: F.struct(F.coalesce(u["site"], F.lit("unknown")).alias("site"), u["url"].alias("url"), F.coalesce(F.lower(u["documentStyle"]) == "pdf", F.lit(False)).alias("pdf")))
    sites = F.array_distinct(F.transform(named, lambda u: u["site"]))
    one = lambda s, pdf: F.get(F.filter(named, lambda u: (u["site"] == s) & (u["pdf"] if pdf else ~u["pdf"])), F.lit(0))["url"]
    host = lambda s: F.when(preprint, "preprint").when(F.lower(s).isin(*REPOSITORY_SITES), "repository").otherwise("publisher")
    best = F.when(F.array_contains(sites, PREFERRED_SITE), F.lit(PREFERRED_SITE)).otherwise(F.get(sites, F.lit(0)))
    version = F.when(preprint, "submittedVersion").otherwise("publishedVersion")
    return F.transform(sites, lambda s: _location(F.coalesce(one(s, False), one(s, True)), one(s, True), host(s), version, licence(j["license"]), F.translate(s, "_", " "), s == best))


def _europepmc(j: Column) -> dict[str, Column]:
    types = publication_types(j)
    preprint = (F.upper(F.coalesce(j["source"], F.lit(""))) == "PPR") | F.array_contains(types, "preprint")
    first = lambda a: (text.display_text(a["firstName"]), text.display_text(a["lastName"]))
    name = lambda a: F.when(first(a)[0].isNotNull() & first(a)[1].isNotNull(), F.concat_ws(" ", *first(a))).otherwise(F.coalesce(text.display_text(a["fullName"]), first(a)[1], first(a)[0]))
    placed = lambda a: F.array_compact(F.transform(a["authorAffiliationDetailsList"]["authorAffiliation"], lambda x: text.display_text(x["affiliation"])))
    authors = F.transform(j["authorList"]["author"], lambda a, i: _author(name(a), i, F.when(a["authorId"]["type"] == "ORCID", a["authorId"]["value"]), None, placed(a)))
    journal = j["journalInfo"]["journal"]
    title, server = text.display_text(journal["title"]), F.when(preprint, text.display_text(j["bookOrReportDetails"]["publisher"]))
    places = site_locations(j, preprint)
    day = F.coalesce(dates.iso_date(j["firstPublicationDate"]), dates.iso_date(j["electronicPublicationDate"]), dates.iso_date(j["journalInfo"]["printPublicationDate"]))
    open_ = F.coalesce(j["isOpenAccess"] == "Y", F.lit(False))
    notices = F.exists(F.coalesce(j["commentCorrectionList"]["commentCorrection"], F.array()), lambda c: F.coalesce(F.lower(F.trim(c["type"])) == "retraction in", F.lit(False)))
    return {
        "title": text.display_text(j["title"]), "identifiers": _identifiers(("doi", j["doi"]), ("pmid", j["pmid"]), ("pmcid", j["pmcid"])), "abstract": text.display_text(j["abstractText"]),
        "authors": F.filter(authors, lambda a: a["name"].isNotNull()), "published_date": day, "first_seen_online": day,
        "venue": F.coalesce(_venue(title, F.lit("journal"), open_, None, F.coalesce(F.nullif(journal["issn"], F.lit("")), journal["essn"])), _venue(server, F.lit("preprint_server"), F.lit(True))),
        "is_preprint": preprint, "is_peer_reviewed": ~preprint & F.coalesce(F.upper(j["source"]).isin(*REVIEWED_DATABASES), F.lit(False)), "work_type": work_type(j, preprint), "language": language(j["language"]),
        "topics": F.transform(F.filter(j["meshHeadingList"]["meshHeading"], lambda m: text.display_text(m["descriptorName"]).isNotNull()), lambda m: _topic("mesh", text.display_text(m["descriptorName"]), text.display_text(m["descriptorName"]), F.when(m["majorTopic_YN"] == "Y", F.lit(1.0)))),
        "keywords": F.array_compact(F.transform(j["keywordList"]["keyword"], text.display_text)), "citation_count": j["citedByCount"],
        "oa_status": F.when(open_, "green").when(F.size(places) > 0, "bronze").otherwise("closed"), "locations": places,
        "is_retracted_hint": F.arrays_overlap(types, F.array(*map(F.lit, RETRACTED_TYPES))) | notices,
    }


def _pubmed(j: Column) -> dict[str, Column]:
    day = dates.iso_date(j["pub_date"])
    return {
        "title": text.display_text(j["title"]), "identifiers": _identifiers(("doi", j["doi"]), ("pmid", j["pmid"])), "abstract": text.display_text(j["abstract"]), "published_date": day,
        "first_seen_online": day, "venue": _venue(text.display_text(j["journal"]), F.lit("journal"), F.lit(False)), "is_preprint": F.lit(False), "is_peer_reviewed": F.lit(True),
        "work_type": F.lit("article"), "language": language(j["language"]), "oa_status": F.lit("unknown"),
    }


def _arxiv(j: Column) -> dict[str, Column]:
    key, day = ids.arxiv(j["id"]), dates.iso_date(j["created"])
    full = lambda a: F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim(a["forenames"]), F.lit("")), F.nullif(F.trim(a["keyname"]), F.lit("")))), F.lit(""))
    authors = F.transform(j["authors"]["author"], lambda a, i: _author(full(a), i))
    copy = _location(F.concat(F.lit("https://arxiv.org/abs/"), key), F.concat(F.lit("https://arxiv.org/pdf/"), key), F.lit("preprint"), F.lit("submittedVersion"), j["license"], F.lit("arXiv"), F.lit(True))
    return {
        "title": text.display_text(j["title"]), "identifiers": _identifiers(("arxiv", j["id"]), ("doi", j["doi"])), "abstract": text.display_text(j["abstract"]),
        "authors": F.filter(authors, lambda a: a["name"].isNotNull()), "venue": _venue(F.lit("arXiv"), F.lit("preprint_server"), F.lit(True)), "published_date": day, "first_seen_online": day,
        "is_preprint": F.lit(True), "is_peer_reviewed": text.display_text(j["journal-ref"]).isNotNull(), "work_type": F.lit("preprint"), "language": F.lit("en"),
        "topics": F.transform(F.filter(F.split(F.trim(j["categories"]), r"\s+"), lambda c: F.length(c) > 0), lambda c: _topic("arxiv", c, c)), "oa_status": F.lit("green"),
        "locations": F.when(key.isNotNull(), F.array(copy)),
    }


def _biorxiv(j: Column) -> dict[str, Column]:
    doi, day = ids.doi(j["doi"]), dates.iso_date(j["date"])
    server = F.lower(F.coalesce(j["server"], F.lit("biorxiv")))
    label = F.coalesce(mapped(SERVERS, server), j["server"], F.lit("bioRxiv"))
    page = F.concat(F.lit("https://www."), server, F.lit(".org/content/"), doi, F.lit("v"), F.coalesce(j["version"], F.lit("1")))
    category = text.display_text(j["category"])
    copy = _location(page, F.concat(page, F.lit(".full.pdf")), F.lit("preprint"), F.lit("submittedVersion"), server_licence(j["license"]), label, F.lit(True))
    return {
        "title": text.display_text(j["title"]), "identifiers": _identifiers(("doi", j["doi"])), "abstract": text.display_text(j["abstract"]), "authors": listed_authors(j["authors"]),
        "venue": _venue(label, F.lit("preprint_server"), F.lit(True)), "published_date": day, "first_seen_online": day, "is_preprint": F.lit(True), "is_peer_reviewed": F.lit(False),
        "work_type": F.lit("preprint"), "language": F.lit("en"), "topics": F.when(category.isNotNull(), F.array(_topic("biorxiv", category, category))), "oa_status": F.lit("green"),
        "locations": F.when(doi.isNotNull(), F.array(copy)), "preprint_of_doi": ids.doi(j["published"]),
    }


NORMALISERS = {"openalex": _openalex, "europepmc": _europepmc, "pubmed": _pubmed, "arxiv": _arxiv, "biorxiv": _biorxiv}


def candidates_of(records: DataFrame, *, named: bool = True) -> DataFrame:
    """records(record_id, source_key, source_id, fetched_at, payload) -> candidates: one row per readable record with a title.

    Each payload is parsed once, with the members its own source has; lists are never null. `named` leaves out records without
    any identifier, which could never be told from others. An unknown source or an unreadable payload gives no row; repeated
    records give repeated candidates; other columns don't matter.
    """
    key = F.col("source_key")
    parsed = [F.when(key == s, F.from_json("payload", schema)).alias(f"_{s}") for s, schema in PAYLOADS.items()]
    x = records.where(key.isin(*PAYLOADS)).select("record_id", "source_key", "source_id", "fetched_at", *parsed)
    fields = {s: f(F.col(f"_{s}")) for s, f in NORMALISERS.items()}
    out = []
    for name, kind in CANDIDATE.items():
        value = F.lit(None).cast(kind)
        for s, of in fields.items():
            if name in of:
                value = F.when(key == s, of[name].cast(kind)).otherwise(value)
        if kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        elif kind == "boolean":
            value = F.coalesce(value, F.lit(False))
        out.append(value.alias(name))
    made = x.select("record_id", "source_key", "source_id", "fetched_at", *out).where("title IS NOT NULL")
    return made.where("size(identifiers) > 0") if named else made


def children(candidates: DataFrame, name: str) -> DataFrame:
    """One of the lists of candidates as a table of its own: (record_id, place, ...), places from 1."""
    each = candidates.select("record_id", F.posexplode(name).alias("p", "x")).select("record_id", (F.col("p") + 1).alias("place"), "x")
    kind = CANDIDATE[name]
    return each.select("record_id", "place", "x.*") if "struct" in kind else each.withColumnRenamed("x", "value")
