"""A Spark data source of paged searches, as a batch or as a stream, and the paging rules of four kinds of service.

A service is a function `get(parameters)` that sends one request and returns (status, payload);
tests give a fake one.  A pager turns it into `fetch(term, cursor)`, which returns a page of
records and the cursor of the next page, None after the last.  Nothing ends a search early in
silence: a service that stays busy, refuses or breaks raises.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Get = Callable[[dict], tuple[int, Mapping]]
Cursor = str | int | tuple | None
Fetch = Callable[[str, Cursor], tuple[list[Mapping], Cursor]]


class Busy(RuntimeError):
    """The service asks to come back later."""


class Refused(RuntimeError):
    """The service won't answer this request, however often it is asked."""


def answer(status: int, payload: Mapping) -> Mapping:
    if status == 429 or status >= 500:
        raise Busy(f"status {status}")
    if status >= 400:
        raise Refused(f"status {status}: {payload}")
    return payload


def _least(hits: str, most: int | None) -> int:
    """The number of hits that a service states, or `most` where that is given and less."""
    n = int(hits) if hits.isdigit() else 0
    return n if most is None else min(n, most)


def cursor_pages(get: Get, fields: str, criteria: str = "", size: int = 200) -> Fetch:
    """Pages that name the next one's cursor, from `*` on; an empty page is the last."""

    def fetch(term: str, cursor: Cursor) -> tuple[list[Mapping], Cursor]:
        asked = {"filter": criteria, "select": fields, "cursor": cursor or "*", "per-page": size}
        payload = answer(*get(asked | ({"search": term} if term else {})))
        found = payload.get("results", [])
        return found, (payload.get("meta") or {}).get("next_cursor") if found else None

    return fetch


def offset_pages(get: Get, fields: str, years: tuple[int, int], kinds: str = "JournalArticle,Article,Review", size: int = 100, most: int | None = None) -> Fetch:
    """Pages by offset, as long as they are full and, where `most` is given, the offset is below it."""

    def fetch(term: str, cursor: Cursor) -> tuple[list[Mapping], Cursor]:
        offset = cursor or 0
        payload = answer(*get({"query": term, "fields": fields, "limit": size, "offset": offset, "publicationTypes": kinds, "year": f"{years[0]}-{years[1]}"}))
        found = payload.get("data", [])
        after = offset + len(found)
        return found, after if len(found) >= size and (most is None or after < most) else None

    return fetch


def numbered_pages(get: Get, size: int = 100, most: int | None = None) -> Fetch:
    """Pages by number from 1, as long as they are full and hold less than all hits and, where it is given, than `most`; a lone hit may come bare."""

    def fetch(term: str, cursor: Cursor) -> tuple[list[Mapping], Cursor]:
        page = cursor or 1
        payload = answer(*get({"query": term, "format": "json", "resultType": "core", "pageSize": size, "page": page}))
        found = (payload.get("resultList") or {}).get("result", [])
        found = [found] if isinstance(found, dict) else list(found)
        hits = str(payload.get("hitCount", 0))
        before = (page - 1) * size
        seen = before + len(found)
        last = len(found) < size or seen >= _least(hits, most)
        return found[: None if most is None else max(0, most - before)], None if last else page + 1

    return fetch


TOO_LARGE = "Exceeds the maximum number allowed for the service level"


def sized_pages(get: Get, fields: str, sizes: tuple[int, int] = (200, 25), most: int | None = None) -> Fetch:
    """Pages by start, of the larger size until the service says that it is too large, then of the smaller."""

    def fetch(term: str, cursor: Cursor) -> tuple[list[Mapping], Cursor]:
        start, size = cursor or (0, sizes[0])
        while True:
            status, payload = get({"query": term, "field": fields, "count": size, "start": start, "sort": "-coverDate"})
            if status == 400 and size > sizes[1] and TOO_LARGE in str(((payload.get("service-error") or {}).get("status") or {}).get("statusText", "")):
                size = sizes[1]
                continue
            if status == 429:
                raise Refused("the quota is used up")
            break
        results = answer(status, payload).get("search-results", {})
        found, total = results.get("entry", []), str(results.get("opensearch:totalResults", "0"))
        if found and "error" in found[0]:
            raise Refused(str(found[0]["error"]))
        after = start + len(found)
        last = len(found) < size or after >= _least(total, most)
        return found, None if last else (after, size)

    return fetch


class PagedSource(DataSource):
    """Rows term, position and record (JSON) of a paged search; format name paged_search.

    Options: terms (JSON list, one partition each); fetcher (module:name of a Fetch, or of a
    function without arguments that makes one); most records of a term (all without it); pauses
    in seconds before a busy service is asked again; delay in seconds between pages;
    first_must_find (true: where the first term finds nothing the service counts as closed, which
    raises before any other term is asked).  For a stream also pages, at most so many in a batch
    (8), dealt over the terms in turn.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "term string, position long, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)


class _Pages:
    """The options of a paged search, and a page of it with the pauses that a busy service asks for."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.terms = json.loads(options["terms"])
        self.fetcher = options["fetcher"]
        self.most = int(options["most"]) if "most" in options else None
        self.pauses = [float(x) for x in options.get("pauses", "10,20,40,60").split(",")]
        self.delay = float(options.get("delay", "0"))
        self.first_must_find = options.get("first_must_find", "false") == "true"

    def _fetch(self) -> Fetch:
        from importlib import import_module

        module, _, name = self.fetcher.partition(":")
        found = getattr(import_module(module), name)
        return found() if getattr(found, "makes_fetch", False) else found

    def _page(self, fetch: Fetch, term: str, cursor: Cursor) -> tuple[list[Mapping], Cursor]:
        for pause in [*self.pauses, None]:
            try:
                return fetch(term, cursor)
            except Busy as e:
                if pause is None:
                    raise RuntimeError(f"the service stayed busy for {term!r} at {cursor!r}: {e}") from e
                time.sleep(pause)
        raise AssertionError


class PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        if self.first_must_find and self.terms and not self._page(self._fetch(), self.terms[0], None)[0]:
            raise Refused(f"nothing found for the first term, {self.terms[0]!r}")
        return [InputPartition(t) for t in self.terms]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, cursor, n = self._fetch(), None, 0
        while self.most is None or n < self.most:
            found, cursor = self._page(fetch, partition.value, cursor)
            for record in found[: None if self.most is None else self.most - n]:
                yield (partition.value, n, json.dumps(record))
                n += 1
            if cursor is None:
                return
            time.sleep(self.delay)


class PagedStream(_Pages, SimpleDataSourceStreamReader):
    """A search that goes on where its checkpoint stopped.

    The offset holds, for each term, the cursor of its next page, how many records came before, and
    whether its last page has been seen.  Every page is asked for once; after a failure the batch
    at hand is fetched again from its cursors, so nothing is left out or doubled as long as the
    service gives the same page for the same cursor.  A batch goes through the driver, as this kind
    of source does, and is bounded by its pages; terms added later begin at their first page.
    """

    def __init__(self, options: Mapping[str, str]) -> None:
        super().__init__(options)
        self.pages = int(options.get("pages", "8"))

    def initialOffset(self) -> dict:
        return {}

    def _walk(self, start: dict, end: dict | None = None) -> tuple[list[tuple], dict]:
        """Rows and offset from `start` on: by `pages` pages, or as far as `end` says."""
        fetch, rows, now, left = self._fetch(), [], {t: list(x) for t, x in start.items()}, self.pages
        open_ = lambda t: not now.setdefault(t, [None, 0, False])[2] and (end is None or now[t] != list(end.get(t, now[t])))
        while todo := [t for t in self.terms if open_(t)]:
            for term in todo:
                if end is None and not left:
                    return rows, now
                cursor, n, _ = now[term]
                found, after = self._page(fetch, term, tuple(cursor) if isinstance(cursor, list) else cursor)
                if self.first_must_find and term == self.terms[0] and not n and not found:
                    raise Refused(f"nothing found for the first term, {term!r}")
                kept = found if self.most is None else found[: self.most - n]
                rows += [(term, n + i, json.dumps(r)) for i, r in enumerate(kept)]
                n += len(kept)
                now[term] = [list(after) if isinstance(after, tuple) else after, n, after is None or n == self.most]
                left -= 1
                time.sleep(self.delay)
        return rows, now

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, now = self._walk(start)
        return iter(rows), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(start, end)[0])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
