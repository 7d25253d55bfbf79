"""Listing pages as a streaming source: cursors, result caps, stale cursors, newest-first realignment.

A listing is a function (cursor, page_size) -> ``Page``; a micro-batch is one page, or as many as the source is told. The stream's offset holds the cursor behind the last
page and what realignment needs, so it survives restarts with the query's checkpoint. No network code lives here: what fetches is injected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lumenlit.errors import PipelineAborted, StaleCursor

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "title", "abstract", "source_url", "metadata")])
#: Ids kept from the head and the tail of a newest-first listing.
KEPT_IDS = 25


@dataclass(frozen=True)
class Page:
    """Records of a page, the cursor behind it (None: the listing ends here) and whether the source cut the listing at its cap."""

    records: list[dict]
    next_cursor: str | None = None
    truncated: bool = False


Fetch = Callable[[str | None, int], Page]


def by_offset(fetch: Callable[[int, int], list[dict]], cap: int | None = None) -> Fetch:
    """A listing by decimal offsets, from a function (offset, page_size) -> records; ``cap`` is the source's greatest number of results."""

    def page(cursor: str | None, size: int) -> Page:
        at = int(cursor or 0)
        size = size if cap is None else min(size, max(cap - at, 0))
        rows = fetch(at, size) if size > 0 else []
        end = at + len(rows)
        full = cap is not None and end >= cap
        return Page(rows, None if full else str(end), full)

    return page


# The greatest number of results of sources that cut a listing short.
CAPS = {"pubmed": 9_999, "semantic_scholar": 1_000}


def by_token(fetch: Callable[[str | None, int], tuple[list[dict], str | None]], most: int = 200) -> Fetch:
    """A listing by opaque cursors, from a function (cursor, page_size) -> (records, next cursor); pages hold at most ``most`` records. A decimal
    cursor comes from another kind of listing and is stale here."""

    def page(cursor: str | None, size: int) -> Page:
        if cursor is not None and cursor.isdigit():
            raise StaleCursor(f"{cursor} is an offset, not a cursor of this source")
        rows, following = fetch(cursor, min(size, most))
        return Page(rows, following)

    return page


def realigned(saved: list[str], head_offset: int, ids: list[str], at: int) -> int | None:
    """Where a newest-first backlog lies now. ``saved``: ids at the head of the listing when ``head_offset`` rows of it were settled; ``ids``: those
    listed now from place ``at`` on. None: no saved id is among them, so newer entries fill this page and more."""
    places = {x: i for i, x in reversed(list(enumerate(saved)))}
    for i, x in enumerate(ids):
        if x in places:
            return head_offset + at + i - places[x]
    return None


class _Reader(SimpleDataSourceStreamReader):
    """Offset: cursor of the next page; ``run``, the run that wrote it; ``done``, whether that run reached the end; ``restarts`` within the run."""

    def __init__(self, fetch: Fetch, page_size: int, run: int, newest_first: bool, pages: int):
        self.fetch, self.page_size, self.run, self.newest_first, self.pages = fetch, page_size, run, newest_first, pages

    def initialOffset(self) -> dict:
        return {"cursor": None, "run": self.run, "done": False, "truncated": False, "restarts": 0, "found": False, "head": [], "head_offset": 0, "new_head": []}

    def _next(self, start: dict) -> tuple[list[dict], dict]:
        if start["run"] == self.run and start["done"]:
            return [], start
        now = dict(start)
        if start["run"] != self.run:
            now |= {"run": self.run, "done": False, "restarts": 0}
            if self.newest_first:
                # The head is read again from the start; the backlog behind it follows where it lies now.
                now |= {"cursor": None, "found": False, "new_head": []}
        try:
            page = self.fetch(now["cursor"], self.page_size)
        except StaleCursor as e:
            if now["restarts"]:
                raise PipelineAborted("the source refused a second cursor of this run", 0) from e
            now |= {"cursor": None, "restarts": 1}
            page = self.fetch(None, self.page_size)
        now = self._newest(now, page) if self.newest_first else now | {"cursor": page.next_cursor}
        if page.truncated:  # the next run starts from the first page
            now |= {"cursor": None, "done": True, "truncated": True, "head": [], "head_offset": 0}
        elif page.next_cursor is None or not page.records:
            now |= {"done": True, "truncated": False}
        return page.records, now

    def _newest(self, now: dict, page: Page) -> dict:
        """Pages from the head until a saved id shows how far the backlog moved, then from the backlog on."""
        ids, at = [r.get("record_id") for r in page.records], int(now["cursor"] or 0)
        end, new_head = at + len(ids), (now["new_head"] + ids)[:KEPT_IDS]
        if now["found"]:
            return now | {"head_offset": end, "cursor": str(end)}
        behind = realigned(now["head"], now["head_offset"], ids, at) if now["head"] else end
        if behind is None:
            return now | {"new_head": new_head, "cursor": str(end)}
        behind = max(behind, end)
        # What lies between this page and the backlog was read by earlier runs.
        return now | {"found": True, "head": new_head, "new_head": [], "head_offset": behind, "cursor": str(behind)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for _ in range(self.pages):
            more, following = self._next(end)
            rows += more
            if following == end:
                break
            end = following
        return iter([tuple(r.get(c) for c in RECORD.names) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]

    def commit(self, end: dict) -> None:
        pass


def paged_source(name: str, fetch: Fetch, page_size: int = 100, run: int = 0, newest_first: bool = False, pages: int = 1) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(...)``, then ``spark.readStream.format(name).load()``. ``run`` numbers the runs
    over one checkpoint; ``newest_first`` needs a listing by offsets; ``pages`` go into one micro-batch, which settles as one page."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return RECORD

        def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
            return _Reader(fetch, page_size, run, newest_first, pages)

    return PagedSource
