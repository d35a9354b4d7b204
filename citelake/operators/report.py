"""Search records: what a plan and a harvest prove about a search, and nothing else.

Fields that the objects don't hold are None and are said to be unknown. The sixteen checklist items
are split into those that the record supplies and those that the author must.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import functions as F

from citelake.errors import BadInput
from citelake.operators.harvest import CellTotal, Harvest
from citelake.plans.search import SearchPlan, years_of_limits

DATABASE, PLATFORM = "Scopus", "Elsevier Scopus Search API"
#: Fixed names and order of the PRISMA-S checklist.
ITEMS = (
    "Database name", "Multi-database searching", "Study registries", "Online resources and browsing", "Citation searching", "Contacts",
    "Other methods", "Full search strategies", "Limits and restrictions", "Search filters", "Prior work", "Updates", "Dates of searches",
    "Peer review", "Total records", "Deduplication",
)
#: Fixed English names, whatever the locale.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ALWAYS_AUTHOR = {
    2: "Other databases searched, and the strategy used in each.",
    3: "Study registries searched.",
    4: "Web sites and printed sources browsed.",
    5: "Citation searching, backward or forward.",
    6: "People and organisations asked for studies.",
    7: "Any other way of finding records.",
    10: "Published search filters used; this engine adds none.",
    11: "Earlier searches that this one builds on.",
    12: "Whether and when the search was repeated.",
    14: "Whether someone reviewed the strategy, and who.",
}
UNKNOWN = "not recorded"


@dataclass(frozen=True)
class Item:
    item: int
    name: str
    source: str  # record or author
    note: str


@dataclass(frozen=True)
class SearchReport:
    database: str
    platform: str
    query: str | None
    field: str | None
    expression: tuple[str, ...]
    view: str | None
    page_size: int | None
    paging: str | None
    partition: str | None
    n_cells: int | None
    years: str | None
    cells: tuple[CellTotal, ...]
    searched_at: datetime | None
    version: str | None
    n_records: int | None
    n_with_doi: int | None
    reported_total: float | None
    cells_reported: int
    records_combined: int | None
    duplicates_removed: int | None
    deduplicated: bool | None
    snippet: str | None
    prisma: tuple[Item, ...] = field(default=())

    def render(self, style: str = "report") -> str:
        if style == "paragraph":
            return _paragraph(self)
        if style not in ("report", "markdown"):
            raise BadInput("style is report, paragraph or markdown")
        return _full(self, style == "markdown")

    def __repr__(self) -> str:
        return self.render()


def number(n: float | None) -> str:
    return UNKNOWN if n is None else f"{int(n):,}"


def stamp(at: datetime) -> str:
    return at.strftime("%Y-%m-%d %H:%M:%S UTC")


def long_date(at: datetime) -> str:
    return f"{at.day} {MONTHS[at.month - 1]} {at.year}"


def cells_of(harvest: Harvest | None, plan: SearchPlan | None, n_records: int | None) -> tuple[CellTotal, ...]:
    """One entry a cell; counts only where the harvest's cells are the plan's."""
    totals = harvest.cell_totals if harvest else ()
    if plan:
        cells = plan.cells()
        fits = [t.cell for t in totals] == [c.cell for c in cells]
        return tuple(CellTotal(c.cell, c.date, totals[i].n_records if fits else None, totals[i].reported_total if fits else None) for i, c in enumerate(cells))
    return (CellTotal(1, None, n_records, harvest.provenance.total_results),) if harvest else ()


def complete(cell: CellTotal) -> bool | None:
    if cell.n_records is None or cell.reported_total is None:
        return None
    return cell.n_records >= cell.reported_total


def search_report(harvest: Harvest | None = None, plan: SearchPlan | None = None) -> SearchReport:
    if harvest is None and plan is None:
        raise BadInput("a report needs a harvest or a plan")
    plan = plan or (harvest.plan if harvest else None)
    counts = harvest.records.agg(F.count("*").alias("n"), F.count("doi").alias("d")).first() if harvest else None
    cells = cells_of(harvest, plan, counts["n"] if counts else None)
    totals = [c.reported_total for c in cells if c.reported_total is not None]
    if plan:
        expression: Sequence[str] = [plan.wrapped]
    else:
        expression = [r["query"] for r in harvest.records.where("query IS NOT NULL").groupBy("query").agg(F.min("entry_number").alias("o")).orderBy("o").collect()]
    merged, source = (harvest.combined or {} if harvest else {}), harvest.provenance if harvest else None
    made = SearchReport(
        DATABASE, PLATFORM, plan and plan.base_query, plan and plan.field, tuple(expression), plan and plan.view, plan and plan.page_size, source and source.paging,
        plan and plan.partition, len(plan.cells()) if plan else None, years_of_limits(c.date for c in cells), cells,
        source and source.retrieved_at, ", ".join(source.versions) if source and source.versions else None, counts and counts["n"], counts and counts["d"],
        float(sum(totals)) if cells and len(totals) == len(cells) else None, len(totals), merged.get("n_in"), merged.get("n_removed"), merged.get("deduplicated"), plan.to_code() if plan else None,
    )
    object.__setattr__(made, "prisma", prisma(made))
    return made


def prisma(x: SearchReport) -> tuple[Item, ...]:
    supplied: dict[int, str] = {1: f"{x.database}, through the {x.platform}."}
    if x.expression:
        supplied[8] = "Expression, field tag and year limit of each cell: " + "; ".join(x.expression) + "."
    if x.partition is not None:
        supplied[9] = f"Publication years {x.years}; no other limit." if x.years else "No limit."
    if x.searched_at:
        supplied[13] = f"{stamp(x.searched_at)}."
    if x.n_records is not None:
        supplied[15] = f"{number(x.n_records)} retrieved; reported as matching: {number(x.reported_total)}."
    if x.deduplicated and x.duplicates_removed is not None:
        supplied[16] = f"{number(x.duplicates_removed)} of {number(x.records_combined)} merged records removed, by record id, failing that by DOI."
    missing = "the plan wasn't run" if x.n_records is None else UNKNOWN
    notes = ALWAYS_AUTHOR | {k: f"To be stated: {missing}." for k in (8, 9, 13, 15, 16)}
    return tuple(Item(i, name, "record" if i in supplied else "author", supplied.get(i) or notes[i]) for i, name in enumerate(ITEMS, 1))


def pairs(x: SearchReport) -> list[tuple[str, str]]:
    run = x.n_records is not None
    years = x.years or ("no limit" if x.partition else UNKNOWN)
    found = lambda value: value if run else "the plan wasn't run"
    if x.reported_total is None:
        whole = UNKNOWN
    else:
        whole = "all reported records retrieved" if run and x.n_records >= x.reported_total else f"{number(x.n_records)} of {number(x.reported_total)} reported records retrieved"
    removed = f"{number(x.duplicates_removed)} of {number(x.records_combined)}" if x.deduplicated else "none: merged as they were" if x.deduplicated is False else UNKNOWN
    return [
        ("Database", f"{x.database} ({x.platform})"), ("Expression", "; ".join(x.expression) or UNKNOWN), ("Field tag", x.field or ("none" if x.partition else UNKNOWN)), ("Years", years),
        ("Cells", number(x.n_cells)), ("View", x.view or UNKNOWN), ("Page size", number(x.page_size)), ("Paging", x.paging or UNKNOWN),
        ("Searched", found(stamp(x.searched_at) if x.searched_at else UNKNOWN)), ("Software", f"citelake {x.version}" if x.version else UNKNOWN),
        ("Records", found(number(x.n_records))), ("Reported", found(number(x.reported_total))), ("Completeness", found(whole)), ("Duplicates removed", found(removed)),
        ("With a DOI", found(f"{number(x.n_with_doi)} of {number(x.n_records)}")),
    ]


def identified(x: SearchReport) -> int | None:
    """Records before duplicates were removed: what went into a merge, if one was recorded."""
    return x.records_combined if x.records_combined is not None else x.n_records


def _full(x: SearchReport, markdown: bool) -> str:
    say = {True: "yes", False: "no", None: UNKNOWN}
    head = (lambda t: f"## {t}") if markdown else (lambda t: t.upper())
    lines = [head("Search record"), ""]
    if markdown:
        lines += ["| Field | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in pairs(x)), "", head("Cells"), "", "| Cell | Limit | Retrieved | Reported | Complete |", "|---|---|---|---|---|"]
        lines += [f"| {c.cell} | {c.date or 'none'} | {number(c.n_records)} | {number(c.reported_total)} | {say[complete(c)]} |" for c in x.cells]
    else:
        lines += [*(f"{k}: {v}" for k, v in pairs(x)), "", head("Cells"), *(f"  {c.cell} ({c.date or 'no limit'}): retrieved {number(c.n_records)}, reported {number(c.reported_total)}, complete: {say[complete(c)]}" for c in x.cells)]
    lines += ["", head("Identification"), "", f"Records identified: {number(identified(x))}", f"Duplicates removed: {number(x.duplicates_removed)}", ""]
    for source, title in (("record", "Checklist items supplied here"), ("author", "Checklist items for the author")):
        lines += [head(title), "", *(f"{'- ' if markdown else '  '}{i.item} {i.name}. {i.note}" for i in x.prisma if i.source == source), ""]
    if x.snippet:
        lines += [head("To repeat the search"), "", *(["```python", x.snippet, "```"] if markdown else [x.snippet])]
    return "\n".join(lines).rstrip() + "\n"


def _paragraph(x: SearchReport) -> str:
    when = f" on {long_date(x.searched_at)}" if x.searched_at else ""
    parts = [f"{x.database} was searched through the {x.platform}{when}."]
    if x.expression:
        parts.append(f"The expression was {'; '.join(x.expression)}" + (f", for publication years {x.years}." if x.years else "."))
    if x.n_records is None:
        parts.append("The plan hasn't been run.")
    else:
        parts.append(f"{number(x.n_records)} records were retrieved; {number(x.n_with_doi)} have a DOI.")
    if x.reported_total is not None:
        parts.append(f"The service reported {number(x.reported_total)} matching records.")
    if x.deduplicated:
        parts.append(f"{number(x.duplicates_removed)} of {number(x.records_combined)} merged records were duplicates and were removed.")
    return " ".join(parts)
