"""Record sets as files: CSV that reads back alike, and Parquet with its provenance beside it."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.errors import BadInput
from citelake.functions.text import whole_number
from citelake.operators.harvest import CellTotal, Harvest, Provenance
from citelake.plans.search import SearchPlan
from citelake.operators.report import SearchReport
from citelake.schema import KEYWORDS, RECORDS, is_records
from citelake.sources.storage import Folder

NULL = "NA"
FORMATS = {".csv": "csv", ".parquet": "parquet"}


def format_of(path: str) -> str:
    if not isinstance(path, str) or not path:
        raise BadInput("a path is a non-empty string")
    found = next((f for end, f in FORMATS.items() if path.lower().endswith(end)), None)
    if found is None:
        raise BadInput(f"a path ends in one of {', '.join(FORMATS)}")
    return found


def write_records(harvest: Harvest, path: str) -> None:
    """A .csv folder (header, quotes doubled, LF, nulls as NA) or a .parquet folder with provenance."""
    if format_of(path) == "csv":
        _csv(harvest.records.orderBy("entry_number"), path)
        return
    harvest.records.write.mode("overwrite").parquet(path)
    known = {"provenance": asdict(harvest.provenance), "plan": asdict(harvest.plan) if harvest.plan else None, "cell_totals": [asdict(c) for c in harvest.cell_totals], "combined": harvest.combined}
    stamp = harvest.provenance.retrieved_at
    known["provenance"]["retrieved_at"] = stamp.isoformat() if stamp else None
    Folder(harvest.records.sparkSession, path).write_text("_provenance.json", json.dumps(known))


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue=NULL, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_records(spark: SparkSession, path: str) -> Harvest:
    if format_of(path) == "csv":
        read = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return Harvest(coerced(read))
    text = Folder(spark, path).read_text("_provenance.json")
    records = spark.read.parquet(path)
    if not is_records(records):
        raise BadInput(f"{path} holds no records")
    known = json.loads(text) if text else {}
    source = dict(known.get("provenance") or {})
    if source.get("retrieved_at"):
        source["retrieved_at"] = datetime.fromisoformat(source["retrieved_at"])
    source["versions"] = tuple(source["versions"]) if source.get("versions") else None
    plan = dict(known["plan"]) if known.get("plan") else None
    if plan and plan["years"]:
        plan["years"] = tuple(plan["years"])
    return Harvest(records, Provenance(**source), SearchPlan(**plan) if plan else None, tuple(CellTotal(**c) for c in known.get("cell_totals") or ()), known.get("combined"))


def coerced(raw: DataFrame) -> DataFrame:
    """The fixed schema: missing columns null, whole numbers parsed, other columns dropped."""
    fields = [*RECORDS.fields, *([KEYWORDS] if KEYWORDS.name in raw.columns else [])]

    def column(f):
        if f.name not in raw.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        value = F.col(f.name)
        return (whole_number(value) if f.dataType.typeName() == "integer" else value.cast("string")).alias(f.name)

    return raw.select(*map(column, fields))


def write_dois(dois: DataFrame, path: str) -> None:
    """A one-column CSV folder."""
    _csv(dois.orderBy("entry_number").select("doi"), path)


def write_entries(entries: DataFrame, path: str) -> None:
    """A text folder of BibTeX or RIS entries in order, a blank line after each."""
    entries.orderBy("entry_number").select(F.concat("entry", F.lit("\n")).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_report(report: SearchReport, spark: SparkSession, path: str, style: str = "report") -> None:
    """The rendered report as one UTF-8 file."""
    if not isinstance(path, str) or not path.strip():
        raise BadInput("a path is a non-empty string")
    folder, _, name = path.rpartition("/")
    Folder(spark, folder or ".").write_text(name, report.render(style))
