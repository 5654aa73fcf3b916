"""Transports of the four literature APIs for the paged data source: (cursor) -> ((source id, record) pairs, next cursor or None).

Each keeps to its API's way of paging: opaque cursors, resumption tokens, offsets with a total, or marks bound to a query window.
Options: expression (filter, set, server or query; one partition each), since and until (ISO days), and get, the dotted name of a
function (url, params) -> text to use in place of fetch().
"""

from __future__ import annotations

import importlib
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, date, datetime, timedelta

from bibliome.sources import paged

Page = tuple[list[tuple[str, dict]], str | None]
Get = Callable[[str, dict[str, str] | None], str]

#: Addresses, page sizes and the days a first read looks back.
OPENALEX, ARXIV, BIORXIV, EUROPEPMC = "https://api.openalex.org/works", "https://oaipmh.arxiv.org/oai", "https://api.biorxiv.org", "https://www.ebi.ac.uk/europepmc/webservices/rest/search"
NOTICES = "https://gitlab.com/crossref/retraction-watch-data/-/raw/main/retraction_watch.csv"
PER_PAGE = {"openalex": 200, "details": 30, "pubs": 100, "europepmc": 100}
WINDOW_DAYS = 7
#: Requests a second and burst that each service bears.
LIMITS = {"openalex": (5.0, 5), "arxiv": (0.3, 1), "biorxiv": (1.0, 2), "europepmc": (5.0, 5), "retraction_watch": (0.5, 1)}
_OAI = {"o": "http://www.openarchives.org/OAI/2.0/", "a": "http://arxiv.org/OAI/arXiv/"}


def getter(source: str, options: dict[str, str]) -> Get:
    """How pages are fetched: as the option says, else over HTTP at the pace the service bears, with retries."""
    if "get" in options:
        module, _, name = options["get"].rpartition(".")
        return getattr(importlib.import_module(module), name)
    bucket = paged.TokenBucket(*LIMITS[source])
    return lambda url, params=None: paged.fetch(url, params, bucket=bucket)


def _object(text: str) -> dict:
    read = json.loads(text)
    if not isinstance(read, dict):
        raise ValueError("a page must be a JSON object")
    return read


def _window(options: dict[str, str]) -> tuple[str, str]:
    end = date.fromisoformat(options["until"]) if options.get("until") else datetime.now(UTC).date()
    start = options.get("since") or (end - timedelta(days=int(options.get("days", WINDOW_DAYS)))).isoformat()
    return start, end.isoformat()


def openalex(options: dict[str, str]) -> Callable[[str | None], Page]:
    """Works of one filter expression, changed since a day, in the order of their change."""
    get, order = getter("openalex", options), options.get("incremental_field", "updated_date")
    chosen = [options.get("expression", ""), *([f"from_{order}:{options['since']}"] if options.get("since") else [])]

    def page(cursor: str | None) -> Page:
        asked = {"filter": ",".join(c for c in chosen if c), "per-page": str(PER_PAGE["openalex"]), "cursor": cursor or "*", "sort": f"{order}:asc"} | ({"api_key": options["api_key"]} if options.get("api_key") else {})
        read = _object(get(OPENALEX, asked))
        found = read.get("results") or []
        following = (read.get("meta") or {}).get("next_cursor")
        more = following if found and following and following != (cursor or "*") else None
        return [(str(w["id"]), w) for w in found if w.get("id")], more

    return page


def works_by_doi(dois: Iterable[str], options: dict[str, str] | None = None) -> Iterator[tuple[str, dict]]:
    """The works of the given dois, fifty a request; a doi the service doesn't know gives nothing."""
    get = getter("openalex", options or {})
    for some in paged.doi_batches(list(dois)):
        read = _object(get(OPENALEX, {"filter": "doi:" + "|".join(f"https://doi.org/{d}" for d in some), "per-page": str(PER_PAGE["openalex"])}))
        yield from ((str(w["id"]), w) for w in read.get("results") or [] if w.get("id"))


def oai_page(xml: str) -> Page:
    """One ListRecords answer: live records as flat objects, and the token of the next page. No match is an empty page; any other
    error the service tells is an error."""
    root = ET.fromstring(xml)
    wrong = root.find("o:error", _OAI)
    if wrong is not None:
        if wrong.get("code") == "noRecordsMatch":
            return [], None
        raise ValueError(f"{wrong.get('code')}: {(wrong.text or '').strip()}")
    out = []
    for r in root.iterfind("o:ListRecords/o:record", _OAI):
        head, body = r.find("o:header", _OAI), r.find("o:metadata/a:arXiv", _OAI)
        if body is None or head is not None and head.get("status") == "deleted":
            continue
        flat = {e.tag.split("}")[1]: (e.text or "").strip() for e in body if not len(e)}
        flat["authors"] = {"author": [{e.tag.split("}")[1]: (e.text or "").strip() for e in a} for a in body.iterfind("a:authors/a:author", _OAI)]}
        if flat.get("id"):
            out.append((flat["id"], flat))
    token = root.findtext("o:ListRecords/o:resumptionToken", "", _OAI).strip()
    return out, token or None


def arxiv(options: dict[str, str]) -> Callable[[str | None], Page]:
    """Records of one set; a resumption token is sent alone, as the protocol asks."""
    get = getter("arxiv", options)
    first = {"verb": "ListRecords", "metadataPrefix": "arXiv", "set": options.get("expression", "cs")} | ({"from": options["since"]} if options.get("since") else {})
    return lambda cursor: oai_page(get(ARXIV, {"verb": "ListRecords", "resumptionToken": cursor} if cursor else first))


def _offsets(endpoint: str, options: dict[str, str]) -> Callable[[str | None], tuple[list[dict], str | None]]:
    """Pages by offset over a window of days; the end is where the total says, or a page that isn't full where none is told."""
    get, (start, end), server = getter("biorxiv", options), _window(options), options.get("expression") or "biorxiv"

    def page(cursor: str | None) -> tuple[list[dict], str | None]:
        at = int(cursor or 0)
        read = _object(get(f"{BIORXIV}/{endpoint}/{server}/{start}/{end}/{at}", None))
        found = read.get("collection") or []
        said = (read.get("messages") or [{}])[0]
        total = str(said.get("total", "")) if isinstance(said, dict) else ""
        reached = at + len(found)
        done = not found or (reached >= int(total) if total.isdigit() and int(total) else len(found) < PER_PAGE[endpoint])
        return found, None if done else str(reached)

    return page


def biorxiv(options: dict[str, str]) -> Callable[[str | None], Page]:
    """Preprint details of one server."""
    pages, server = _offsets("details", options), options.get("expression") or "biorxiv"

    def page(cursor: str | None) -> Page:
        found, nxt = pages(cursor)
        return [(f"{r['doi']}v{r.get('version') or '1'}", r | {"server": r.get("server") or server}) for r in found if r.get("doi")], nxt

    return page


def biorxiv_links(options: dict[str, str]) -> Callable[[str | None], Page]:
    """Preprints with the doi they were published under; links without both ends are left out."""
    pages = _offsets("pubs", options)

    def page(cursor: str | None) -> Page:
        found, nxt = pages(cursor)
        ends = [((r.get("preprint_doi") or "").strip(), (r.get("published_doi") or "").strip(), r) for r in found]
        return [(f"{a}>{b}", r | {"from_doi": a, "to_doi": b}) for a, b, r in ends if a and b], nxt

    return page


def europepmc(options: dict[str, str]) -> Callable[[str | None], Page]:
    """Results of one query within a window of update days; cursors carry query and window, so a read that was cut off goes on in
    its own window, and one of another query starts anew."""
    get, expression = getter("europepmc", options), options.get("expression", "")

    def page(cursor: str | None) -> Page:
        start, end, mark = paged.parse_cursor(cursor, expression) or (*_window(options), "*")
        asked = {"query": paged.windowed_query(expression, start, end), "format": "json", "resultType": "core", "pageSize": str(PER_PAGE["europepmc"]), "cursorMark": mark}
        read = _object(get(EUROPEPMC, asked))
        found, nxt = (read.get("resultList") or {}).get("result") or [], read.get("nextCursorMark") or ""
        more = found and nxt and nxt != mark
        return [(f"{r['source']}:{r['id']}", r) for r in found if r.get("id") and r.get("source")], paged.format_cursor(expression, start, end, nxt) if more else None

    return page


def download_notices(path: str, options: dict[str, str] | None = None) -> str:
    """The whole table of retraction notices, as one CSV file for landing.notices_csv."""
    text = getter("retraction_watch", options or {})(NOTICES, None)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


#: Source name -> transport factory.
TRANSPORTS = {"openalex": openalex, "arxiv": arxiv, "biorxiv": biorxiv, "biorxiv_links": biorxiv_links, "europepmc": europepmc}


def transport(source: str, options: dict[str, str]) -> Callable[[str | None], Page]:
    if source not in TRANSPORTS:
        raise ValueError(f"unknown source {source!r}; known are {sorted(TRANSPORTS)}")
    return TRANSPORTS[source](options)
