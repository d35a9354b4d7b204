"""Abstracts, keywords and reference lists by identifier, and the corpus built from them.

Looking up an identifier is a paid request to a remote service, so it runs in mapInArrow and its
result must be written before it is used twice; everything after it is column expressions.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from citelake.errors import BadInput, DroppedRecords, Forbidden, IncompleteReferences, SearchError
from citelake.functions.text import identifier, keywords, trimmed
from citelake.schema import ABSTRACTS, REFERENCE
from citelake.sources.storage import Folder
from citelake.sources.transport import Service

VIEWS = ("META", "META_ABS", "REF", "FULL")
ROW = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ABSTRACTS.fields)}, authkeywords string, references array<{REFERENCE.simpleString()}>, reported_references int, status string, remaining int"


def checked_extras(include: Sequence[str], view: str | None) -> tuple[str, ...]:
    if view is not None and view not in VIEWS:
        raise BadInput(f"view must be one of {', '.join(VIEWS)}")
    if extra := set(include) - {"references", "keywords"}:
        raise BadInput(f"can't include {', '.join(sorted(extra))}")
    if "references" in include and view not in ("FULL", "REF"):
        raise BadInput("references need the view FULL or REF")
    if "keywords" in include and view != "FULL":
        raise BadInput("keywords need the view FULL")
    return tuple(sorted(set(include)))


def _path(value: object, *steps: str) -> object:
    for step in steps:
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _list(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value: object) -> str | None:
    if isinstance(value, list):
        value = "; ".join(map(str, value)) if value and all(isinstance(v, (str, int, float)) for v in value) else None
    return str(value) if isinstance(value, (str, int, float)) else None


def _whole(value: object) -> int | None:
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return None


def _year(value: object) -> int | None:
    text = _text(value) or ""
    return int(text[:4]) if text[:4].isascii() and text[:4].isdigit() and len(text) >= 4 else None


def keywords_of(found: dict) -> str | None:
    holder = found.get("authkeywords")
    items = _list(holder["author-keyword"] if isinstance(holder, dict) and "author-keyword" in holder else holder)
    words = [_text(i.get("$") if isinstance(i, dict) else i) for i in items]
    return "; ".join(w for w in words if w) or None


def references_of(found: dict, view: str) -> tuple[list[dict], int | None]:
    """The reference list, and how many references the answer says there are."""
    holder = found.get("references") if view == "REF" else _path(found, "item", "bibrecord", "tail", "bibliography")
    count = _whole(_path(holder, "@total-references" if view == "REF" else "@refcount"))
    return [_reference(r, view) for r in _list(_path(holder, "reference"))], count


def _reference(item: dict, view: str) -> dict:
    info = item.get("ref-info") or item
    short = view == "REF"
    people = _list(_path(info, "author-list", "author") if short else _path(info, "ref-authors", "author"))
    given = "ce:given-name" if short else "ce:initials"
    names = [", ".join(x for x in (a.get("ce:surname"), a.get(given)) if x) for a in people]
    ids = {i.get("@idtype"): i.get("$") for i in reversed(_list(_path(info, "refd-itemidlist", "itemid")))}
    return {
        "position": _text(item.get("@id")),
        "id": _text(info.get("scopus-id") if short else ids.get("SGR")),
        "doi": _text(info.get("ce:doi") if short else ids.get("DOI")),
        "title": _text(_path(info, "ref-title", "ref-titletext")),
        "authors": "; ".join(names) or None,
        "source": _text(info.get("ref-sourcetitle")),
        "year": _year(info.get("ref-coverdate") or info.get("prism:coverDate")) if short else _whole(_path(info, "ref-publicationyear", "@first")),
        "citedbycount": _whole(info.get("citedby-count")) if short else None,
    }


def abstract_row(key: str, found: dict, view: str | None, include: Sequence[str]) -> dict:
    core = found.get("coredata") or {}
    references, count = references_of(found, view) if "references" in include else (None, None)
    return {
        "id": key, "record_id": (_text(core.get("dc:identifier")) or "").removeprefix("SCOPUS_ID:") or None, "doi": _text(core.get("prism:doi")), "title": _text(core.get("dc:title")),
        "abstract": _text(core.get("dc:description")), "publication": _text(core.get("prism:publicationName")), "year": _year(core.get("prism:coverDate")), "citations": _whole(core.get("citedby-count")),
        "authkeywords": keywords_of(found) if "keywords" in include else None, "references": references, "reported_references": count, "status": "ok",
    }


def abstracts_of(answers: DataFrame, view: str | None = None, include: Sequence[str] = ()) -> DataFrame:
    """Rows like those of lookup() from answers that are at hand: (id, answer as JSON text)."""
    extras, schema = checked_extras(include, view), to_arrow_schema(StructType.fromDDL(ROW))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([abstract_row(key, json.loads(answer)["abstracts-retrieval-response"], view, extras) for key, answer in found], schema=schema)

    return answers.select("id", "answer").mapInArrow(read, ROW)


def lookup(ids: DataFrame, service: Service, by: str = "doi", view: str | None = None, include: Sequence[str] = (), parallel: int = 4) -> DataFrame:
    """A row for each row of ids (column id); a failed one has only id and its error in status.

    remaining is what the service said after the request about the quota.
    parallel bounds the requests made at a time. A partition stops at the first refusal (403).
    """
    extras = checked_extras(include, view)
    if by not in ("doi", "scopus_id"):
        raise BadInput("by must be doi or scopus_id")
    service.headers()  # a missing key fails here, not in every row

    schema = to_arrow_schema(StructType.fromDDL(ROW))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused = False
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                row = {"id": key}
                try:
                    if refused:
                        raise Forbidden("not asked after a refusal", 403)
                    found, quota = service.lookup(by, key, view)
                    row = abstract_row(key, found, view, extras) | {"remaining": quota.remaining}
                except SearchError as error:
                    refused = refused or isinstance(error, Forbidden)
                    row["status"] = type(error).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    clean = ids.select(identifier(trimmed(F.col("id"))).alias("id"))
    return clean.repartition(parallel).mapInArrow(ask, ROW)


def abstracts(spark: SparkSession, ids: DataFrame, service: Service, cache_dir: str, by: str = "doi", view: str | None = None, include: Sequence[str] = (), parallel: int = 4) -> DataFrame:
    """lookup() with a cache: identifiers found earlier aren't asked again, failures are.

    The cache is a Parquet folder for each view and choice of extras; rows carry their identifier.
    Raises Forbidden if the service refused; warns of reference lists that aren't whole.
    """
    extras = checked_extras(include, view)
    folder = Folder(spark, f"{cache_dir.rstrip('/')}/view={view or 'default'}-{'-'.join(extras) or 'none'}")
    wanted = ids.select(identifier(trimmed(F.col("id"))).alias("id")).where("id <> ''")
    index = folder.read_text("_parts.json")
    parts = json.loads(index) if index else []
    known = spark.read.parquet(*[folder.path(p) for p in parts]) if parts else spark.createDataFrame([], ROW)
    missing = wanted.distinct().join(known.where("status = 'ok'").select("id"), "id", "left_anti")
    part = f"part-{len(parts):05d}"
    lookup(missing, service, by, view, extras, parallel).write.mode("overwrite").parquet(folder.path(part))
    folder.write_text("_parts.json", json.dumps([*parts, part]))
    fresh = spark.read.parquet(folder.path(part))
    counts = fresh.agg(F.count_if(F.col("status") == "Forbidden").alias("refused"), F.count_if(F.size("references") != F.col("reported_references")).alias("short")).first()
    if counts["refused"]:
        raise Forbidden(f"the service refused {counts['refused']} of the identifiers", 403)
    if counts["short"]:
        warnings.warn(f"{counts['short']} reference lists are shorter or longer than reported", IncompleteReferences, stacklevel=2)
    found = known.where("status = 'ok'").unionByName(fresh)
    return wanted.join(found, "id", "left")


def corpus(records: DataFrame, found: DataFrame, by: str = "doi") -> DataFrame:
    """(entry_number, id, title, year, keywords, references): records with an identifier, enriched row by row.

    found holds one row for each identifier, so records that share one all keep their own row.
    """
    key = F.col("doi") if by == "doi" else F.col("record_id")
    keyed = records.select("entry_number", identifier(trimmed(key)).alias("id"), "title", "year")
    missing = keyed.agg(F.count_if(F.col("id").isNull()).alias("gone"), F.count("id").alias("kept")).first()
    if not missing["kept"]:
        raise BadInput("no record has an identifier")
    if missing["gone"]:
        warnings.warn(f"{missing['gone']} records without an identifier are left out", DroppedRecords, stacklevel=2)
    extra = found.select("id", "authkeywords", "references").dropDuplicates(["id"])
    joined = keyed.where("id IS NOT NULL").join(extra, "id", "left")
    empty = F.array().cast(f"array<{REFERENCE.simpleString()}>")
    return joined.select("entry_number", "id", "title", "year", keywords(F.col("authkeywords")).alias("keywords"), F.coalesce("references", empty).alias("references"))
