"""Spark data source "bibsearch": pages of a search service as rows of one entry's JSON.

Columns: position, entry, total (matches that the page reports) and remaining (requests left of the
quota after it). Offset paging asks for the first page on the driver, hands its entries on and deals the
other pages out as partitions, so no request is made for the total alone; cursor paging is sequential
and therefore one partition; mode "count" asks for the total only. With the option marker, a search
without a match gives one row at position 0 that has the total. Retries happen inside a request.
Requests cost quota, so write the result before using it twice.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citelake.errors import Capped
from citelake.plans.search import checked_limit, checked_page_size, checked_view
from citelake.sources.transport import Service, entries_of, total_of

HARD_CAP = 5000
MAX_CURSOR_PAGES = 100_000
PAGES_A_PARTITION = 5


@dataclass
class Pages(InputPartition):
    starts: tuple[tuple[int, int], ...]  # (start, count); a count below 0 goes on until a page is short
    rows: tuple[tuple, ...] = field(default=())  # of the first page


@dataclass
class CursorRun(InputPartition):
    pass


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = options.get
        self.service = Service(get("url", ""), get("apikey") or get("apiKey"), get("insttoken") or get("instToken"), float(get("timeout", "60")), int(get("maxtries", get("maxTries", "3"))), float(get("pause", "1")))
        self.query, self.date, self.view = get("query", ""), get("date"), checked_view(get("view", "STANDARD"))
        size = get("pagesize", get("pageSize"))
        self.page_size = checked_page_size(int(size) if size else None, self.view)
        limit = get("maxresults", get("maxResults"))
        self.limit = checked_limit(float(limit)) if limit else None
        self.mode, self.marker = get("mode", "offset"), get("marker", "false").lower() == "true"
        self.hard_cap = int(get("hardcap", get("hardCap", HARD_CAP)))
        self.max_pages = int(get("maxcursorpages", get("maxCursorPages", MAX_CURSOR_PAGES)))

    def partitions(self) -> list[InputPartition]:
        if self.mode != "offset":
            return [CursorRun()]
        most = min(x for x in (self.limit, self.hard_cap) if x is not None)
        asked = min(self.page_size, most)
        results, quota = self.service.page(self.query, asked, start=0, date=self.date, view=self.view)
        found, total = self._rows(results, quota.remaining, 0)
        first = Pages((), tuple(found or self._marker(results, quota.remaining)))
        if len(found) < asked:
            return [first]
        if total is None:  # without a total, pages must be asked for in turn
            return [first, Pages(((asked, -1),))]
        wanted = int(min(total, most))
        pages = [(s, min(self.page_size, wanted - s)) for s in range(asked, wanted, self.page_size)]
        return [first, *(Pages(tuple(pages[i : i + PAGES_A_PARTITION])) for i in range(0, len(pages), PAGES_A_PARTITION))]

    def _rows(self, results: dict, remaining: int | None, before: int) -> tuple[list[tuple], float | None]:
        total = total_of(results)
        return [(before + i + 1, json.dumps(e), total, remaining) for i, e in enumerate(entries_of(results))], total

    def _marker(self, results: dict, remaining: int | None) -> list[tuple]:
        return [(0, None, total_of(results), remaining)] if self.marker else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.mode == "count":
            results, quota = self.service.page(self.query, 1, start=0, date=self.date, view=self.view)
            total = total_of(results)
            yield 1, json.dumps({"total": total}), total, quota.remaining
        elif isinstance(partition, Pages):
            yield from partition.rows
            yield from self._offset(partition)
        else:
            yield from self._cursor()

    def _offset(self, partition: Pages) -> Iterator[tuple]:
        for start, count in partition.starts:
            at, end = start, start + count
            if count < 0:
                end = min(x for x in (self.limit, self.hard_cap) if x is not None)
            while at < end:
                asked = min(self.page_size, end - at)
                results, quota = self.service.page(self.query, asked, start=at, date=self.date, view=self.view)
                found, _ = self._rows(results, quota.remaining, at)
                yield from found
                if len(found) < asked:
                    return
                at += len(found)

    def _cursor(self) -> Iterator[tuple]:
        cursor, fetched, pages, total = "*", 0, 0, None
        while self.limit is None or fetched < self.limit:
            asked = self.page_size if self.limit is None else min(self.page_size, self.limit - fetched)
            results, quota = self.service.page(self.query, asked, cursor=cursor, date=self.date, view=self.view)
            found, said = self._rows(results, quota.remaining, fetched)
            total = said if total is None else total
            yield from found if found or fetched else self._marker(results, quota.remaining)
            fetched, pages = fetched + len(found), pages + 1
            following = (results.get("cursor") or {}).get("@next")
            if not found or (total is not None and fetched >= total) or not following or following == cursor:
                return
            if pages >= self.max_pages:
                warnings.warn(f"cursor paging stopped after {pages} pages", Capped, stacklevel=2)
                return
            cursor = following


class BibSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bibsearch"

    def schema(self) -> str:
        return "position int, entry string, total double, remaining int"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))


def read_search(spark: SparkSession, **options: object) -> DataFrame:
    spark.dataSource.register(BibSearch)
    return spark.read.format("bibsearch").options(**{k: str(v) for k, v in options.items() if v is not None}).load()
