"""Fixed schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(**kinds: str) -> T.StructType:
    types = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType()}
    return T.StructType([T.StructField(n, types[k]) for n, k in kinds.items()])


RECORDS = _schema(entry_number="int", record_id="string", doi="string", title="string", authors="string", year="int", date="string", publication="string", citations="int", query="string")
KEYWORDS = T.StructField("authkeywords", T.StringType())
COMPARISON = _schema(query="string", query_type="string", abridged_query="string", year="int", n="double", reference_n="double", comparison_percentage="double", average_comparison_percentage="double")
REFERENCE = _schema(position="string", id="string", doi="string", title="string", authors="string", source="string", year="int", citedbycount="int")
ABSTRACTS = _schema(id="string", record_id="string", doi="string", title="string", abstract="string", publication="string", year="int", citations="int")


def records_schema(view: str = "STANDARD") -> T.StructType:
    return T.StructType([*RECORDS.fields, *([KEYWORDS] if view == "COMPLETE" else [])])


def empty_records(spark: SparkSession, view: str = "STANDARD") -> DataFrame:
    return spark.createDataFrame([], records_schema(view))


def is_records(df: object) -> bool:
    return isinstance(df, DataFrame) and df.columns[: len(RECORDS.names)] == RECORDS.names
