"""A Python data source for paged APIs: batches and streams of raw records, resumed from a cursor.

What a page is comes from a transport, a function (cursor) -> (records, next cursor or None), named by its source or found by its
dotted name, so that the reader itself can be tested on recorded pages; a record may come with its id as a pair. Requests are retried and paced as each source asks.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

_SCHEMA = "source_key string, source_id string, payload string"
#: Answers worth another try, tries, first and longest wait in seconds.
RETRY = (408, 425, 429, 500, 502, 503, 504)
TRIES, FIRST, LONGEST = 5, 1.0, 60.0


class TokenBucket:
    """Requests at a steady rate with a burst; waits where none is left."""

    def __init__(self, rate: float, burst: int = 1, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.now, self.sleep = rate, burst, now, sleep
        self.left, self.at = float(burst), now()

    def take(self) -> None:
        t = self.now()
        self.left, self.at = min(self.burst, self.left + (t - self.at) * self.rate), t
        if self.left < 1:
            self.sleep((1 - self.left) / self.rate)
            self.left, self.at = 1.0, self.now()
        self.left -= 1


def wait_before(attempt: int, retry_after: str | None = None, rand: Callable[[], float] = random.random) -> float:
    """What the server asks for, else a random part of a doubling bound."""
    if retry_after and retry_after.strip().isdigit():
        return min(LONGEST, float(retry_after))
    return rand() * min(LONGEST, FIRST * 2**attempt)


def fetch(url: str, params: dict[str, str] | None = None, *, bucket: TokenBucket | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> str:
    """A page's text; tries again where the server is busy, gives up on any other error."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for attempt in range(TRIES):
        if bucket:
            bucket.take()
        try:
            with opener(full) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or attempt == TRIES - 1:
                raise
            sleep(wait_before(attempt, e.headers.get("Retry-After") if e.headers else None))
        except urllib.error.URLError:
            if attempt == TRIES - 1:
                raise
            sleep(wait_before(attempt))
    raise AssertionError


def fingerprint(expression: str) -> str:
    return hashlib.sha256(expression.encode()).hexdigest()[:8]


def format_cursor(expression: str, start: str, end: str, mark: str) -> str:
    """A cursor bound to its query: a changed query can't go on from it."""
    return "|".join((fingerprint(expression), start, end, mark))


def parse_cursor(cursor: str | None, expression: str) -> tuple[str, str, str] | None:
    """(start, end, mark), or None where the cursor isn't whole, is empty, has a bad date or belongs to another query."""
    parts = (cursor or "").split("|")
    if len(parts) != 4 or parts[0] != fingerprint(expression) or not parts[3]:
        return None
    try:
        for day in parts[1:3]:
            time.strptime(day, "%Y-%m-%d")
    except ValueError:
        return None
    return parts[1], parts[2], parts[3]


def windowed_query(expression: str, start: str, end: str) -> str:
    """The expression with a range of update dates, which the server filters by."""
    return f"({expression}) AND (UPDATE_DATE:[{start} TO {end}])"


def doi_batches(dois: list[str], size: int = 50) -> list[list[str]]:
    """Distinct dois in their order, those with a delimiter of the query language left out, so many at a time."""
    good = [d for d in dict.fromkeys(dois) if d and not set(d) & set(",|")]
    return [good[i : i + size] for i in range(0, len(good), size)]


def recorded(path: str) -> Callable[[str | None], tuple[list[dict], str | None]]:
    """A transport over a JSON-lines file of pages {"records": [...], "next": cursor}, the first one's cursor being null."""

    pages: list[dict] = []

    def page(cursor: str | None) -> tuple[list[dict], str | None]:
        if not pages:  # read and parsed once
            with open(path, encoding="utf-8") as f:
                pages.extend(json.loads(line) for line in f if line.strip())
        at = 0 if cursor in (None, "") else int(cursor)
        return (pages[at]["records"], str(at + 1) if at + 1 < len(pages) else None) if at < len(pages) else ([], None)

    return page


def _transport(options: dict[str, str]) -> Callable[[str | None], tuple[list[dict], str | None]]:
    if "path" in options:
        return recorded(options["path"])
    if "transport" not in options:
        from bibliome.sources.transports import transport

        return transport(options.get("source", ""), options)
    module, _, name = options["transport"].rpartition(".")
    return getattr(importlib.import_module(module), name)(options)


def _rows(options: dict[str, str], records: list[dict]) -> Iterator[tuple]:
    key = options.get("source", "")
    for r in records:
        own, body = r if isinstance(r, tuple) else (r.get(options.get("id", "id"), ""), r)
        yield key, str(own), json.dumps(body, ensure_ascii=False, sort_keys=True)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One partition per expression: cursors chain pages, so a page can't be read before the last."""
        return [InputPartition(e) for e in self.options.get("expressions", "").split(";")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """All pages, from the option `cursor` on if it is given; a read that must stop at `max_pages` fails and names the cursor
        to go on from, since rows that are silently missing look like a whole source."""
        page, cursor, seen = _transport(self.options | {"expression": partition.value}), self.options.get("cursor") or None, set()
        most = int(self.options.get("max_pages", "0"))
        while True:
            records, nxt = page(cursor)
            yield from _rows(self.options, records)
            if nxt is None or nxt in seen:  # a cursor that comes back has stalled
                return
            seen.add(nxt)
            cursor = nxt
            if most and len(seen) >= most:
                raise RuntimeError(f"{most} pages read, more are left; go on from cursor {cursor!r}")


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["cursor"] == "end":
            return iter(()), start
        records, nxt = _transport(self.options)(start["cursor"] or None)
        return iter(list(_rows(self.options, records))), {"cursor": nxt or "end"}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        while start["cursor"] != end["cursor"]:
            rows, start = self.read(start)
            yield from rows


class PagedSource(DataSource):
    """format("bibliome_paged") with options source, id, and path (recorded pages) or transport (dotted factory name);
    with neither, the source's own transport."""

    @classmethod
    def name(cls) -> str:
        return "bibliome_paged"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(dict(self.options))

    def simpleStreamReader(self, schema: object) -> PagedStream:  # noqa: N802
        return PagedStream(dict(self.options))
