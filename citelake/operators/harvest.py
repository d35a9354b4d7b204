"""Harvests: records with what is known about where they came from, kept beside the table.

A plan is run cell by cell. Each cell's pages are written as Parquet with a manifest that is written
last, so a half-written cell is never taken for a whole one and no request is made twice.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.errors import BadInput, CacheMismatch, CacheUnreadable, Capped, Shortfall
from citelake.operators import sets
from citelake.operators.normalise import entries_to_records
from citelake.plans.search import Cell, SearchPlan, checked_limit
from citelake.sources.search import HARD_CAP, read_search
from citelake.sources.storage import Folder

VERSION = "0.1.0"


@dataclass(frozen=True)
class Provenance:
    retrieved_at: datetime | None = None
    versions: tuple[str, ...] | None = None
    paging: str | None = None
    total_results: float | None = None
    quota_remaining: int | None = None

    @staticmethod
    def merge(parts: Sequence[Provenance]) -> Provenance:
        """Earliest stamp, all versions, a common paging; each only if every part has it."""
        stamps, versions, pagings = [p.retrieved_at for p in parts], [p.versions for p in parts], {p.paging for p in parts}
        left = [p.quota_remaining for p in parts if p.quota_remaining is not None]
        return Provenance(
            min(stamps) if stamps and None not in stamps else None,
            tuple(sorted({v for vs in versions for v in vs})) if versions and None not in versions else None,
            pagings.pop() if len(pagings) == 1 else None,
            quota_remaining=min(left, default=None),
        )


@dataclass(frozen=True)
class CellTotal:
    cell: int
    date: str | None
    n_records: int | None
    reported_total: float | None


@dataclass(frozen=True)
class Harvest:
    records: DataFrame
    provenance: Provenance = field(default_factory=Provenance)
    plan: SearchPlan | None = None
    cell_totals: tuple[CellTotal, ...] = ()
    combined: dict | None = None

    def __add__(self, other: Harvest) -> Harvest:
        return combine([self, other])

    def __repr__(self) -> str:
        known = sum(c.n_records or 0 for c in self.cell_totals) if self.cell_totals else "uncounted"
        return f"<Harvest: {known} records, {len(self.cell_totals)} cells>"


def combine(harvests: Sequence[Harvest], remove_duplicates: bool = False) -> Harvest:
    frames = [h.records for h in harvests]
    made = sets.combine(frames, remove_duplicates)
    counts = sets.accounting(frames, made) | {"deduplicated": remove_duplicates}
    return Harvest(made, Provenance.merge([h.provenance for h in harvests]), combined=counts)


def cell_name(cell: Cell) -> str:
    return f"cell={cell.cell:03d}-{cell.date or 'all'}"


@dataclass(frozen=True)
class Manifest:
    query: str
    date: str | None
    view: str
    page_size: int
    max_results: int | None
    complete: bool
    n_records: int
    total_results: float | None = None
    retrieved_at: str | None = None
    version: str = VERSION
    folder: str = "records"
    quota_remaining: int | None = None
    paging: str = "offset"

    def answers(self, cell: Cell, limit: int | None) -> bool:
        """Whether the checkpoint holds what the cell asks for: same request, and whole or capped no lower."""
        same = (self.query, self.date, self.view, self.page_size) == (cell.query, cell.date, cell.view, cell.page_size)
        enough = self.complete or (limit is not None and self.max_results is not None and limit <= self.max_results)
        return same and enough


def shortfall(cell: int, n: int, total: float | None, limit: int | None) -> bool:
    """Warns of a cell with fewer records than reported, unless the caller's limit explains it."""
    short = total is not None and n < total and not (limit is not None and n >= limit)
    if short:
        warnings.warn(f"cell {cell} gave {n} records of {total:.0f} reported; the harvest may be incomplete", Shortfall, stacklevel=3)
    return short


def run_plan(spark: SparkSession, plan: SearchPlan, cache_dir: str, url: str, max_results: float | None = None, resume: bool = True, **options: object) -> Harvest:
    """All cells of a plan, from checkpoints where they answer the request. max_results holds for each cell."""
    limit = checked_limit(max_results)
    parts, totals, provenances = [], [], []
    for cell in plan.cells():
        folder = Folder(spark, f"{cache_dir.rstrip('/')}/{cell_name(cell)}")
        manifest = _cached(folder, cell, limit) if resume else None
        if manifest is None:
            manifest = _fetch(spark, folder, cell, limit, url, options)
            shortfall(cell.cell, manifest.n_records, manifest.total_results, limit)
        records = spark.read.parquet(folder.path(manifest.folder))
        if limit is not None and manifest.n_records > limit:
            records = records.where(F.col("entry_number") <= limit)
        parts.append(records)
        totals.append(CellTotal(cell.cell, cell.date, min(manifest.n_records, limit or manifest.n_records), manifest.total_results))
        stamp = datetime.fromisoformat(manifest.retrieved_at) if manifest.retrieved_at else None
        provenances.append(Provenance(stamp, (manifest.version,), manifest.paging, quota_remaining=manifest.quota_remaining))
    reported = [t.reported_total for t in totals]
    merged = replace(Provenance.merge(provenances), total_results=None if None in reported else float(sum(reported)))
    return Harvest(sets.bind(parts), merged, plan, tuple(totals))


def _cached(folder: Folder, cell: Cell, limit: int | None) -> Manifest | None:
    try:
        text = folder.read_text("manifest.json")
        if text is None:
            return _unsigned(folder, cell)
        manifest = Manifest(**json.loads(text))
        folder.spark.read.parquet(folder.path(manifest.folder)).schema  # noqa: B018  Spark is lazy: touch it now
    except (OSError, ValueError, TypeError, PySparkException):
        warnings.warn(f"the checkpoint {folder.root} can't be read; its cell is fetched again", CacheUnreadable, stacklevel=3)
        return None
    if not manifest.answers(cell, limit):
        warnings.warn(f"the checkpoint {folder.root} answers another request; its cell is fetched again", CacheMismatch, stacklevel=3)
        return None
    return manifest


def _unsigned(folder: Folder, cell: Cell) -> Manifest | None:
    """A checkpoint of records without a manifest, as earlier versions left them: whole, if all its records answer the cell's query."""
    if not folder.exists("records/_SUCCESS"):
        return None
    found = folder.spark.read.parquet(folder.path("records")).agg(F.count("*").alias("n"), F.count_if(~F.col("query").eqNullSafe(cell.query)).alias("other")).first()
    if found["other"]:
        warnings.warn(f"the checkpoint {folder.root} answers another request; its cell is fetched again", CacheMismatch, stacklevel=4)
        return None
    return Manifest(cell.query, cell.date, cell.view, cell.page_size, None, True, found["n"])


def _fetch(spark: SparkSession, folder: Folder, cell: Cell, limit: int | None, url: str, options: dict, cursor: bool = False) -> Manifest:
    """The cell's pages, asked for once and written; the total and the quota are read off them."""
    place, paging = f"records-{uuid.uuid4().hex}", "cursor" if cursor else "offset"  # what an earlier harvest reads stays as it is
    asked = {"url": url, "query": cell.query, "date": cell.date, "view": cell.view, "pageSize": cell.page_size, **options}
    read_search(spark, **asked, mode=paging, maxResults=limit, marker=True).write.parquet(folder.path(f"pages-{place}"))
    pages = spark.read.parquet(folder.path(f"pages-{place}"))
    known = pages.agg(F.max("total").alias("total"), F.min("remaining").alias("remaining"), F.count("entry").alias("n")).first()
    entries_to_records(pages.where("entry IS NOT NULL"), cell.query, cell.view).write.parquet(folder.path(place))
    total, n = known["total"], known["n"]
    if not cursor:
        warn_capped(total, limit, int(options.get("hardCap", HARD_CAP)))
    complete = limit is None or n < limit or (total is not None and n >= total)
    manifest = Manifest(cell.query, cell.date, cell.view, cell.page_size, limit, complete, n, total, datetime.now(UTC).isoformat(), folder=place, quota_remaining=known["remaining"], paging=paging)
    folder.write_text("manifest.json", json.dumps(asdict(manifest)))
    return manifest


def fetch_records(
    spark: SparkSession, query: str, url: str, cache_dir: str, years: Iterable[int] | None = None, field: str | None = None, view: str = "STANDARD",
    page_size: int | None = None, max_results: float | None = None, cursor: bool = False, **options: object,
) -> Harvest:
    """The records of one query, written under cache_dir, with their stamp, version, total and quota."""
    plan, limit = SearchPlan.make(query, years, field, view, page_size), checked_limit(max_results)
    cell = plan.cells()[0]
    folder = Folder(spark, f"{cache_dir.rstrip('/')}/fetch-{uuid.uuid4().hex}")
    manifest = _fetch(spark, folder, cell, limit, url, options, cursor)
    shortfall(cell.cell, manifest.n_records, manifest.total_results, limit)
    known = Provenance(datetime.fromisoformat(manifest.retrieved_at), (manifest.version,), manifest.paging, manifest.total_results, manifest.quota_remaining)
    return Harvest(spark.read.parquet(folder.path(manifest.folder)), known)


def count(spark: SparkSession, query: str, url: str, date: str | None = None, **options: object) -> float | None:
    """The number of matching records that the service reports."""
    row = read_search(spark, url=url, query=query, date=date, mode="count", **options).first()
    return json.loads(row["entry"])["total"]


def warn_capped(total: float | None, limit: int | None, ceiling: int = HARD_CAP) -> None:
    """Offset paging ends at the ceiling; a caller who asked for no more isn't told so."""
    if total is not None and total > ceiling and (limit is None or limit > ceiling):
        warnings.warn(f"{total:.0f} records match, but offset paging ends after {ceiling}; use a cursor or a plan by year", Capped, stacklevel=3)


def fetch(spark: SparkSession, query: str, url: str, cursor: bool = False, max_results: float | None = None, **options: object) -> DataFrame:
    """The pages of one query as bibsearch gives them; write them before using them twice, or use fetch_records."""
    if not query.strip():
        raise BadInput("the query is blank")
    limit = checked_limit(max_results)
    if not cursor:
        plain = {k: v for k, v in options.items() if k != "hardCap"}
        warn_capped(count(spark, query, url, **plain), limit, int(options.get("hardCap", HARD_CAP)))
    return read_search(spark, url=url, query=query, mode="cursor" if cursor else "offset", maxResults=limit, **options)
