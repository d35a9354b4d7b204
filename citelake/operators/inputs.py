"""What callers may hand over instead of a table of records."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.errors import BadInput
from citelake.operators.harvest import Harvest
from citelake.operators.normalise import entries_to_records
from citelake.schema import is_records
from citelake.sources.transport import entries_of


def doi_table(spark: SparkSession, given: Harvest | DataFrame | Sequence[str | None]) -> DataFrame:
    """(entry_number, doi) of a harvest, of any table with a column doi, or of a list of strings.

    A table without entry_number is numbered as it is read, so its order is that of its partitions.
    """
    if isinstance(given, Harvest):
        given = given.records
    if isinstance(given, DataFrame):
        if "doi" not in given.columns:
            raise BadInput("a table of DOIs has a column doi")
        number = F.col("entry_number") if "entry_number" in given.columns else F.monotonically_increasing_id() + 1
        return given.select(number.alias("entry_number"), F.col("doi").cast("string").alias("doi"))
    if isinstance(given, str) or not isinstance(given, Sequence) or not all(d is None or isinstance(d, str) for d in given):
        raise BadInput("DOIs are records, a table with a column doi, or a list of strings")
    return spark.createDataFrame([(i, d) for i, d in enumerate(given, 1)], "entry_number int, doi string")


def records_of(spark: SparkSession, given: Harvest | DataFrame | dict | Sequence[dict], query: str | None = None, view: str = "STANDARD") -> DataFrame:
    """Records of a parsed response, of its search-results object or of a list of entries; records stay as they are."""
    if isinstance(given, Harvest):
        return given.records
    if is_records(given):
        return given
    if isinstance(given, dict):
        given = entries_of(given.get("search-results", given))
    if isinstance(given, (str, DataFrame)) or not all(isinstance(e, dict) for e in given):
        raise BadInput("entries are objects as the service gives them")
    found = entries_of({"entry": list(given)})
    return entries_to_records(spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(found, 1)], "position int, entry string"), query, view)
