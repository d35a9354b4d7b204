"""Named queries over the driver tables, each with its DuckDB counterpart where SQL has one.

Record sets come from orders and their customers, topic counts from line items and their parts.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.errors import DroppedRecords
from citelake.functions import text
from citelake.functions.stats import share
from citelake.operators import abstracts, analyse, export, figures, harvest, report, sets
from citelake.operators.normalise import drop_sentinel, entries_to_records
from citelake.plans.search import SearchPlan
from citelake.query import FIELD_TAGS, query, wrap, wrap_unless_tagged
from citelake.sources import files

FLAGSHIP = "topic_share"
PLAN = SearchPlan.make("graphene", range(1994, 1998), "title", partition="year")
YEARS = range(1995, 2002)
REFERENCE, TERMS = query("widget"), [query("red"), query("blue")]
CONCEPTS = {"red": query("red"), "blue": query("blue"), "widget": query("widget")}
INTERSECTIONS = [("red", "widget"), ("blue", "widget")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    prefix = F.when(key % 3 == 0, "https://doi.org/").when(key % 3 == 1, "DOI: ").otherwise("")
    made = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.cast("int").alias("entry_number"),
        F.when(key % 7 != 0, key.cast("string")).alias("record_id"),
        F.when(key % 11 != 0, F.concat(prefix, F.lit("10.1/"), (key % 5000).cast("string"))).alias("doi"),
        F.col("c_name").alias("title"),
        F.concat("c_name", F.lit("; "), "c_mktsegment").alias("authors"),
        F.year("o_orderdate").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("publication"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"),
        F.lit("TITLE(orders)").alias("query"),
    )
    return sets.renumber(made)


RECORDS_SQL = """
    SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS entry_number,
           CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS record_id,
           CASE WHEN o_orderkey % 11 <> 0 THEN concat(CASE o_orderkey % 3 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'DOI: ' ELSE '' END,
                                                      '10.1/', CAST(o_orderkey % 5000 AS VARCHAR)) END AS doi,
           c_name AS title, concat(c_name, '; ', c_mktsegment) AS authors,
           CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS date,
           o_orderpriority AS publication, CAST(floor(o_totalprice / 1000) AS INTEGER) AS citations, 'TITLE(orders)' AS query
    FROM orders JOIN customer ON o_custkey = c_custkey
"""
WITH = f"WITH records AS ({RECORDS_SQL})"
CLEAN_SQL = r"nullif(trim(regexp_replace(regexp_replace(trim(doi), '^\s*(https?://)?(www\.)?(dx\.)?doi\.org/', '', 'i'), '^\s*doi:\s*', '', 'i')), '')"


def literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, title) of line items: the year shipped and the part's name."""
    items, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    counted = items.select("l_partkey", F.year("l_shipdate").alias("year"))
    return counted.join(part.select("p_partkey", F.col("p_name").alias("title")), F.col("l_partkey") == F.col("p_partkey")).select("year", "title")


def _fields() -> dict:
    return {None: F.col("title")}


LITERATURE = "lit AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_name AS title FROM lineitem JOIN part ON l_partkey = p_partkey)"
COUNTED = f"""
    WITH {LITERATURE}, years AS (SELECT CAST(range AS INTEGER) AS year FROM range(1995, 2002)),
    topics AS (SELECT * FROM (VALUES (0, 'reference', 'widget', 'widget', ''), (1, 'comparison', 'widget AND red', 'red', 'red'),
                                     (2, 'comparison', 'widget AND blue', 'blue', 'blue')) t(topic, query_type, query, abridged_query, word)),
    counts AS (SELECT topic, query, query_type, abridged_query, years.year, CAST(count(lit.title) AS DOUBLE) AS n
               FROM topics CROSS JOIN years LEFT JOIN lit ON lit.year = years.year AND contains(lit.title, 'widget') AND contains(lit.title, word)
               GROUP BY ALL),
    refs AS (SELECT counts.*, r.n AS reference_n FROM counts JOIN (SELECT year, n FROM counts WHERE topic = 0) r USING (year)),
    comparison AS (
        SELECT query, query_type, abridged_query, year, n, reference_n,
               CASE WHEN reference_n <> 0 THEN 100.0::DOUBLE * n / reference_n END AS comparison_percentage,
               100.0::DOUBLE * sum(n) OVER (PARTITION BY topic) / nullif(sum(reference_n) OVER (PARTITION BY topic), 0) AS average_comparison_percentage
        FROM refs)
"""


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.compare_topics(literature(spark, sf_dir), REFERENCE, TERMS, YEARS, _fields())


def topic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.ordered_comparison(comparison(spark, sf_dir))


def slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two pulls of the same search: all records, and all of them again with every fifth DOI new and every fourth id missing."""
    every = records(spark, sf_dir)
    number = F.col("entry_number")
    doi = F.when(number % 5 == 0, F.concat(F.lit("10.2/"), number.cast("string"))).otherwise(F.col("doi"))
    return every, every.withColumn("doi", doi).withColumn("record_id", F.when(number % 4 != 0, F.col("record_id")))


SLICES = """
    , old AS (SELECT * FROM records),
    new AS (SELECT * REPLACE (CASE WHEN entry_number % 5 = 0 THEN concat('10.2/', entry_number) ELSE doi END AS doi, CASE WHEN entry_number % 4 <> 0 THEN record_id END AS record_id) FROM records),
    both_ AS (SELECT 0 AS s, * FROM old UNION ALL SELECT 1, * FROM new),
    bound AS (SELECT * REPLACE (CAST(row_number() OVER (ORDER BY s, entry_number) AS INTEGER) AS entry_number) FROM both_),
    keyed AS (SELECT *, coalesce('id:' || record_id, 'doi:' || lower(doi), 'row:' || entry_number) AS k FROM bound),
    kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY entry_number) = 1)
"""
RECORD_COLUMNS = "entry_number, record_id, doi, title, authors, year, date, publication, citations, query"


def events_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search entries as JSON text: an event's properties inside the service's field names."""
    events = _table(spark, sf_dir, "events")
    entry = F.concat(
        F.lit('{"dc:identifier":"SCOPUS_ID:'), F.col("event_id").cast("string"), F.lit('","dc:title":"'), "event_type",
        F.lit('","prism:coverDate":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('","citedby-count":"'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")),
        F.lit('","dc:creator":["A","B"]}'),
    )
    return events.select(F.col("event_id").alias("position"), entry.alias("entry"))


def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = entries_to_records(events_as_entries(spark, sf_dir), "TITLE(events)")
    return made.select("record_id", "doi", "title", "authors", "year", "date", "citations", "query")


def cell_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each yearly cell against a declared total, and whether the cell is complete."""
    counted = records(spark, sf_dir).groupBy("year").agg(F.count("*").cast("int").alias("n_records"), F.max("entry_number").alias("m"))
    declared = F.when(F.col("year") != 1997, (F.col("n_records") + F.when(F.col("year") % 2 == 0, 5).otherwise(0)).cast("double"))
    return counted.select("year", "n_records", declared.alias("reported_total"), (F.col("n_records") >= declared).alias("complete"))


CELLS_SQL = f"""{WITH}, cells AS (SELECT year, CAST(count(*) AS INTEGER) AS n_records FROM records GROUP BY year),
    declared AS (SELECT *, CASE WHEN year <> 1997 THEN CAST(n_records + CASE WHEN year % 2 = 0 THEN 5 ELSE 0 END AS DOUBLE) END AS reported_total FROM cells)
"""


def reported_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cell_totals(spark, sf_dir)
    return cells.agg(
        analyse.all_or_nothing_sum("reported_total").alias("total"),
        F.count("reported_total").alias("cells_reported"),
        F.count_if("complete").alias("cells_complete"),
    )


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.keyword_counts(_table(spark, sf_dir, "documents"), "text", " ")


def bind_union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets with different columns bound; counts of what each column holds."""
    old, new = slices(spark, sf_dir)
    bound = sets.bind([old.drop("citations"), new.withColumn("authkeywords", F.lit("a | b"))])
    return bound.agg(*(F.count(c).alias(c) for c in ("entry_number", "doi", "citations", "authkeywords")), F.max("entry_number").alias("last"))


def topic_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = literature(spark, sf_dir).where(REFERENCE.to_column(_fields()))
    return analyse.trend(matches, [*YEARS, 2005], "widget")


def year_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records; those of 1997 have lost their year, which leaves a gap."""
    every = records(spark, sf_dir)
    return analyse.year_counts(every.withColumn("year", F.when(F.col("year") != 1997, F.col("year"))))


# -- sources, sinks, plans and figures over the same tables ---------------------------------------


def plan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLAN.table(spark)


def plan_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the plan's years, by its half-open range over the timestamp."""
    inside = _table(spark, sf_dir, "orders").where(PLAN.predicate(F.col("o_orderdate")))
    return inside.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


def complete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the view that has author keywords; every third event has none."""
    entries = events_as_entries(spark, sf_dir)
    marked = F.when(F.col("position") % 3 != 0, F.regexp_replace("entry", r"\}$", ',"authkeywords":"alpha | beta"}')).otherwise(F.col("entry"))
    made = entries_to_records(entries.withColumn("entry", marked), "TITLE(events)", "COMPLETE")
    return made.select("record_id", "title", "authkeywords")


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of up to three entries: every fourth has an error field, every second an id; lone errors go."""
    events, k = _table(spark, sf_dir, "events"), F.col("event_id")
    error, known = F.when(k % 4 == 0, '"error":"none"'), F.when(k % 2 == 0, F.concat(F.lit('"dc:identifier":"'), k.cast("string"), F.lit('"')))
    entry = F.concat(F.lit("{"), F.concat_ws(",", F.lit('"dc:title":"x"'), error, F.when(k % 8 != 0, known)), F.lit("}"))
    page = F.when(k % 16 == 0, -k).otherwise(F.floor(k / 3))  # every sixteenth is a page of its own
    return drop_sentinel(events.select(page.alias("page"), k.alias("position"), F.parse_json(entry).alias("entry"))).select("page", "position")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, answer): parts as abstracts in the service's shape, with a keyword list and one reference or two."""
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    text = k.cast("string")
    item = lambda kind, value: F.concat(F.lit(f'{{"@idtype":"{kind}","$":"'), value, F.lit('"}'))
    reference = F.concat(
        F.lit('{"@id":"1","ref-info":{"ref-authors":{"author":[{"ce:surname":"Roe","ce:initials":"R."},{"ce:surname":"Poe"}]},"refd-itemidlist":{"itemid":['),
        item("SGR", text), F.lit(","), item("DOI", F.concat(F.lit("10.3/"), text)), F.lit(']},"ref-title":{"ref-titletext":"'), "p_type",
        F.lit('"},"ref-sourcetitle":"J","ref-publicationyear":{"@first":"'), (1950 + k % 70).cast("string"), F.lit('"}}}'),
    )
    lone = F.lit('{"@id":"2","ref-info":{"refd-itemidlist":{"itemid":{"@idtype":"DOI","$":"10.4/x"}}}}')
    listed = F.when(k % 3 == 0, F.concat(F.lit("["), reference, F.lit(","), lone, F.lit("]"))).otherwise(reference)
    words = F.when(k % 4 == 0, F.lit("null")).when(k % 4 == 1, F.concat(F.lit('{"author-keyword":{"$":"'), "p_brand", F.lit('"}}'))).otherwise(F.concat(F.lit('{"author-keyword":[{"$":"'), "p_brand", F.lit('"},{"$":""},{"$":"'), "p_type", F.lit('"}]}')))
    answer = F.concat(
        F.lit('{"abstracts-retrieval-response":{"coredata":{"dc:identifier":"SCOPUS_ID:'), text, F.lit('","prism:doi":"10.1/'), text, F.lit('","dc:title":"'), "p_name",
        F.lit('","dc:description":"About '), "p_type", F.lit('","prism:publicationName":"'), "p_brand", F.lit('","prism:coverDate":"'), (1990 + k % 30).cast("string"), F.lit('-05-01","citedby-count":"'), F.col("p_size").cast("string"),
        F.lit('"},"authkeywords":'), words, F.lit(',"item":{"bibrecord":{"tail":{"bibliography":{"@refcount":"2","reference":'), listed, F.lit("}}}}}}"),
    )
    return part.select(F.concat(F.lit("10.1/"), text).alias("id"), answer.alias("answer"))


def abstract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = abstracts.abstracts_of(answers(spark, sf_dir), "FULL", ("keywords", "references"))
    first = F.get("references", F.lit(0))
    return made.select(
        "id", "record_id", "doi", "title", "abstract", "publication", "year", "citations", "authkeywords", F.size("references").cast("long").alias("n_references"), "reported_references",
        *(first[c].alias(f"first_{c}") for c in ("id", "doi", "title", "authors", "source", "year", "citedbycount")), F.get("references", F.lit(1))["doi"].alias("second_doi"),
    )


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a DOI, enriched by what parts say about it; records that share one keep their own rows."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DroppedRecords)  # records without a DOI are left out, as they should be
        found = abstracts.abstracts_of(answers(spark, sf_dir), "FULL", ("keywords", "references"))
        every = records(spark, sf_dir).withColumn("doi", text.clean_doi(F.col("doi")))
        made = abstracts.corpus(every, found)
    return made.select("entry_number", "id", "title", "year", F.array_join("keywords", "|").alias("keywords"), F.size("references").cast("long").alias("n_references"))


def share_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.share_lines(comparison(spark, sf_dir))


def size_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.positive_sizes(analyse.concept_sizes(literature(spark, sf_dir), CONCEPTS | {"none": query("no such word")}, INTERSECTIONS, _fields()))


def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = comparison(spark, sf_dir).where("query_type = 'comparison'").select("abridged_query", "year", F.col("comparison_percentage").alias("v"))
    return figures.spread_labels(ends.where("v IS NOT NULL").withColumn("v", F.col("v") + F.col("year") / 1e6), "v", 0.5)


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulls = slices(spark, sf_dir)
    return sets.accounting_table(pulls, sets.combine(pulls, remove_duplicates=True))


def diff_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered diff, with each status' place."""
    ordered = sets.ordered_diff(sets.doi_diff(*slices(spark, sf_dir)))
    return ordered.select("doi", "status", F.array_position(F.array(*map(F.lit, sets.STATUS_ORDER)), F.col("status")).cast("int").alias("place"))


def raw_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's columns, all text, some missing and some too many, in the fixed schema."""
    orders = _table(spark, sf_dir, "orders")
    year = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.year("o_orderdate").cast("string"))
    raw = orders.select(F.col("o_orderkey").cast("string").alias("entry_number"), year.alias("year"), F.col("o_totalprice").cast("string").alias("citations"), F.col("o_orderpriority").alias("title"), F.lit("x").alias("surplus"))
    return files.coerced(raw)


def _shared_file(spark: SparkSession, end: str) -> str:
    """A path in the folder that all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.gettempdir()}/citelake-files/{uuid.uuid4().hex}{end}"


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as CSV in the shared folder and read back."""
    path = _shared_file(spark, ".csv")
    files.write_records(harvest.Harvest(records(spark, sf_dir)), path)
    return files.read_records(spark, path).records


def doi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct DOIs written as a list and read back."""
    path = _shared_file(spark, "-dois")
    files.write_dois(ordered_dois(spark, sf_dir), path)
    return spark.read.csv(path, header=True)


def ris_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each tag in a file of RIS entries."""
    path = _shared_file(spark, ".ris")
    files.write_entries(export.as_ris(records(spark, sf_dir)), path)
    return spark.read.text(path).where("value <> ''").groupBy(F.substring("value", 1, 2).alias("tag")).agg(F.count("*").alias("n"))


def added_harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (harvest.Harvest(s) for s in slices(spark, sf_dir))
    return (old + new).records.select("entry_number", "record_id", "doi")


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's checklist items for a harvest of all records, and who supplies each."""
    made = report.search_report(harvest.Harvest(records(spark, sf_dir)), PLAN)
    return spark.createDataFrame([(i.item, i.name, i.source) for i in made.prisma], "item int, name string, source string")


def trend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_years(spark, sf_dir).groupBy("query").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))


def clamped_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three records of each year asked for, within the records' own span."""
    return sets.capped_per_year(records(spark, sf_dir), 3, (1980, 1995))


def ordered_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_dois(records(spark, sf_dir))


QUERIES = {
    "top_sources": lambda s, d: analyse.top(records(s, d), "source", 10),
    "top_authors": lambda s, d: analyse.top(records(s, d), "author", 10),
    "year_counts": year_gaps,
    "records_summary": lambda s, d: analyse.summary(records(s, d)),
    "clean_dois": lambda s, d: records(s, d).select("entry_number", text.clean_doi(F.col("doi")).alias("doi")),
    "distinct_dois": ordered_dois,
    "combine_records": lambda s, d: sets.combine(slices(s, d)),
    "combine_dedupe": lambda s, d: sets.combine(slices(s, d), remove_duplicates=True),
    "doi_diff": lambda s, d: sets.doi_diff(*slices(s, d)),
    "doi_diff_counts": lambda s, d: sets.diff_counts(sets.doi_diff(*slices(s, d))),
    "trend": topic_years,
    "topic_share": topic_share,
    "wilson_band": lambda s, d: analyse.with_band(comparison(s, d)),
    "concept_sizes": lambda s, d: analyse.concept_sizes(literature(s, d), CONCEPTS, INTERSECTIONS, _fields()),
    "boolean_query": lambda s, d: literature(s, d).where(query("widget", "red", operator="AND NOT").to_column(_fields())).groupBy("title").agg(F.count("*").alias("n")),
    "capped_per_year": lambda s, d: sets.capped_per_year(records(s, d), 5),
    "bibtex_keys": lambda s, d: export.citation_keys(records(s, d)).select("entry_number", "key"),
    "bibtex_escape": lambda s, d: _table(s, d, "documents").select("doc_id", text.bibtex_escaped(text.folded(F.col("text"))).alias("escaped")),
    "bibtex_entries": lambda s, d: export.as_bibtex(records(s, d)),
    "ris_entries": lambda s, d: export.as_ris(records(s, d)),
    "tagged_frame": lambda s, d: export.as_tagged(records(s, d)),
    "json_normalise": json_normalise,
    "keyword_counts": doc_words,
    "cell_totals": cell_totals,
    "reported_total": reported_total,
    "bind_union_columns": bind_union_columns,
    "plan_cells": plan_cells,
    "plan_years": plan_years,
    "complete_records": complete_records,
    "result_pages": result_pages,
    "abstract_rows": abstract_rows,
    "corpus_rows": corpus_rows,
    "share_chart": share_chart,
    "size_chart": size_chart,
    "label_places": label_places,
    "merge_counts": merge_counts,
    "diff_in_order": diff_in_order,
    "raw_strings": raw_strings,
    "csv_round_trip": csv_round_trip,
    "doi_file": doi_file,
    "ris_file": ris_file,
    "html_escaped": lambda s, d: _table(s, d, "pages").select("page_id", text.html_escaped(F.col("html")).alias("escaped")),
    "without_ansi": lambda s, d: _table(s, d, "documents").select("doc_id", text.without_ansi(F.concat(F.lit("\x1b[31m"), "source", F.lit("\x1b[0m:"), "lang")).alias("plain")),
    "added_harvests": added_harvests,
    "checklist": checklist,
    "trend_totals": trend_totals,
    "clamped_demo": clamped_demo,
    "plain_text": lambda s, d: _table(s, d, "documents").select("doc_id", text.plain_text(F.col("text")).alias("plain")),
    "file_safe": lambda s, d: _table(s, d, "pages").select("page_id", text.file_safe(F.col("url")).alias("name")),
    "wrapped_terms": lambda s, d: s.createDataFrame([(t, wrap_unless_tagged(t, "ALL"), wrap(t, "ALL")) for t in FIELD_TAGS], "tag string, once string, wrapped string").withColumn("tagged", F.col("once") == F.col("tag")),
    "yearly_share": lambda s, d: records(s, d).groupBy("year").agg(share(F.count_if(F.col("citations") > 100), F.count("*")).alias("cited_share")),
}

ESCAPE_SQL = "t"
for _plain, _made in (("\\", "\x01"), ("{", r"\{"), ("}", r"\}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\x01", r"\textbackslash{}")):
    ESCAPE_SQL = f"replace({ESCAPE_SQL}, {'chr(1)' if _plain == chr(1) else repr(_plain) if _plain != chr(92) else 'chr(92)'}, {'chr(1)' if _made == chr(1) else chr(39) + _made + chr(39)})"
KEYS_SQL = """
    , based AS (SELECT *, lower(regexp_replace(string_split_regex(string_split(authors, '; ')[1], '[ ,]')[1], '[^A-Za-z0-9]', '', 'g')) || CAST(year AS VARCHAR) AS base FROM records),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY entry_number) - 1 AS r FROM based),
    keys AS (SELECT *, CASE WHEN r = 0 THEN base WHEN r <= 26 THEN base || chr(CAST(96 + r AS INTEGER)) ELSE base || CAST(r AS VARCHAR) END AS key FROM ranked)
"""
_E = {c: c for c in ("title", "publication", "doi", "record_id")}
_ESC = lambda c: ESCAPE_SQL.replace("replace(t,", f"replace({c},", 1)

ORACLES = {
    "top_sources": f"{WITH} SELECT trim(publication) AS value, CAST(count(*) AS INTEGER) AS n FROM records WHERE trim(publication) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "top_authors": f"{WITH}, a AS (SELECT trim(unnest(string_split(authors, '; '))) AS value FROM records) SELECT value, CAST(count(*) AS INTEGER) AS n FROM a WHERE value <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "year_counts": f"{WITH}, r AS (SELECT * REPLACE (CASE WHEN year <> 1997 THEN year END AS year) FROM records), y AS (SELECT unnest(generate_series((SELECT min(year) FROM r), (SELECT max(year) FROM r))) AS year) SELECT CAST(y.year AS INTEGER) AS year, CAST(count(r.year) AS INTEGER) AS n FROM y LEFT JOIN r USING (year) GROUP BY 1",
    "records_summary": f"""{WITH}, s AS (SELECT publication, count(*) AS n FROM records GROUP BY 1)
        SELECT count(*) AS n_records, min(year) AS year_min, max(year) AS year_max, count(doi) AS n_with_doi, CAST(sum(citations) AS BIGINT) AS citations_total,
               (SELECT title FROM records WHERE citations IS NOT NULL ORDER BY citations DESC, entry_number LIMIT 1) AS top_cited, median(citations) AS citations_median,
               (SELECT count(*) FROM s) AS n_sources, (SELECT max(n) FROM s) AS top_source_n, (SELECT publication FROM s ORDER BY n DESC, publication LIMIT 1) AS top_source
        FROM records""",
    "clean_dois": f"{WITH} SELECT entry_number, {CLEAN_SQL} AS doi FROM records",
    "distinct_dois": f"{WITH}, c AS (SELECT entry_number, {CLEAN_SQL} AS doi FROM records) SELECT * FROM c WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(doi) ORDER BY entry_number) = 1",
    "combine_records": f"{WITH} {SLICES} SELECT {RECORD_COLUMNS} FROM bound",
    "combine_dedupe": f"{WITH} {SLICES} SELECT {RECORD_COLUMNS.replace('entry_number', 'CAST(row_number() OVER (ORDER BY entry_number) AS INTEGER) AS entry_number', 1)} FROM kept",
    "doi_diff": f"""{WITH} {SLICES}, o AS (SELECT {CLEAN_SQL} AS d, min(entry_number) AS e FROM old GROUP BY 1), n AS (SELECT {CLEAN_SQL} AS d, min(entry_number) AS e FROM new GROUP BY 1),
        o1 AS (SELECT lower(d) AS k, arg_min(d, e) AS doi FROM o WHERE d IS NOT NULL GROUP BY 1), n1 AS (SELECT lower(d) AS k, arg_min(d, e) AS doi FROM n WHERE d IS NOT NULL GROUP BY 1)
        SELECT coalesce(n1.doi, o1.doi) AS doi, CASE WHEN o1.doi IS NULL THEN 'added' WHEN n1.doi IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM o1 FULL JOIN n1 USING (k)""",
    "trend": f"WITH {LITERATURE}, y AS (SELECT CAST(unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001, 2005]) AS INTEGER) AS year) SELECT 'widget' AS query, y.year, CAST(count(lit.title) AS DOUBLE) AS n FROM y LEFT JOIN lit ON lit.year = y.year AND contains(lower(lit.title), 'widget') GROUP BY ALL",
    "topic_share": f"{COUNTED} SELECT * FROM comparison ORDER BY query_type <> 'reference', average_comparison_percentage DESC NULLS LAST, query, year",
    "wilson_band": f"""{COUNTED}, p AS (SELECT *, n / reference_n AS p, 1.96 * 1.96 AS zz FROM comparison),
        m AS (SELECT *, (p + zz / (2 * reference_n)) / (1 + zz / reference_n) AS mid, 1.96::DOUBLE * sqrt(p * (1 - p) / reference_n + zz / (4 * reference_n * reference_n)) / (1 + zz / reference_n) AS half FROM p)
        SELECT * EXCLUDE (p, zz, mid, half), least(100, greatest(0, 100 * (mid - half)))::DOUBLE AS low, least(100, greatest(0, 100 * (mid + half)))::DOUBLE AS high FROM m""",
    "concept_sizes": f"""WITH {LITERATURE}, c AS (SELECT count(*) FILTER (WHERE contains(title, 'red')) AS a, count(*) FILTER (WHERE contains(title, 'blue')) AS b, count(*) FILTER (WHERE contains(title, 'widget')) AS w,
        count(*) FILTER (WHERE contains(title, 'red') AND contains(title, 'widget')) AS aw, count(*) FILTER (WHERE contains(title, 'blue') AND contains(title, 'widget')) AS bw FROM lit)
        SELECT label, query, CAST(n AS DOUBLE) AS n, type, CAST(size AS INTEGER) AS size, members FROM (
            SELECT 'red' AS label, 'red' AS query, a AS n, 'concept' AS type, 1 AS size, 'red' AS members FROM c UNION ALL SELECT 'blue', 'blue', b, 'concept', 1, 'blue' FROM c UNION ALL SELECT 'widget', 'widget', w, 'concept', 1, 'widget' FROM c
            UNION ALL SELECT 'red × widget', 'red AND widget', aw, 'intersection', 2, 'red; widget' FROM c UNION ALL SELECT 'blue × widget', 'blue AND widget', bw, 'intersection', 2, 'blue; widget' FROM c)""",
    "boolean_query": f"WITH {LITERATURE} SELECT title, count(*) AS n FROM lit WHERE contains(title, 'widget') AND NOT contains(title, 'red') GROUP BY 1",
    "capped_per_year": f"{WITH}, k AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY year ORDER BY entry_number) <= 5) SELECT {RECORD_COLUMNS.replace('entry_number', 'CAST(row_number() OVER (ORDER BY entry_number) AS INTEGER) AS entry_number', 1)} FROM k",
    "bibtex_keys": f"{WITH} {KEYS_SQL} SELECT entry_number, key FROM keys",
    "bibtex_escape": f"WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, {ESCAPE_SQL} AS escaped FROM d",
    "bibtex_entries": f"""{WITH} {KEYS_SQL} SELECT entry_number, key, '@article{{' || key || ',' || chr(10) || concat_ws(chr(10),
            '  author = {{' || {_ESC("replace(authors, '; ', ' and ')")} || '}},', '  title = {{' || {_ESC("title")} || '}},', '  journal = {{' || {_ESC("publication")} || '}},',
            '  year = {{' || year || '}},', '  doi = {{' || {_ESC("doi")} || '}},', '  note = {{Scopus ID: ' || record_id || '}},') || chr(10) || '}}' AS entry FROM keys""",
    "ris_entries": f"""{WITH} SELECT entry_number, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, 'AU  - ' || replace(authors, '; ', chr(10) || 'AU  - '), 'PY  - ' || year, 'JO  - ' || publication,
            'DO  - ' || doi, 'N1  - Scopus ID: ' || record_id, 'ER  - ') AS entry FROM records""",
    "tagged_frame": f"{WITH} SELECT entry_number, upper(authors) AS AU, upper(title) AS TI, upper(publication) AS SO, doi AS DI, year AS PY, citations AS TC, record_id AS UT, 'SCOPUS' AS DB FROM records",
    "json_normalise": "SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS doi, event_type AS title, 'A; B' AS authors, CAST(year(ts) AS INTEGER) AS year, strftime(ts, '%Y-%m-%d') AS date, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS citations, 'TITLE(events)' AS query FROM events",
    "keyword_counts": "WITH w AS (SELECT trim(unnest(string_split(text, ' ')), ' ' || chr(9) || chr(10) || chr(13)) AS keyword FROM documents) SELECT keyword, count(*) AS n FROM w WHERE keyword <> '' GROUP BY 1",
    "cell_totals": f"{CELLS_SQL} SELECT year, n_records, reported_total, n_records >= reported_total AS complete FROM declared",
    "reported_total": f"{CELLS_SQL} SELECT CASE WHEN count(*) = count(reported_total) THEN sum(reported_total) END AS total, count(reported_total) AS cells_reported, count(*) FILTER (WHERE n_records >= reported_total) AS cells_complete FROM declared",
    "bind_union_columns": f"{WITH} {SLICES} SELECT count(*) AS entry_number, count(doi) AS doi, count(*) FILTER (WHERE s = 1 AND citations IS NOT NULL) AS citations, count(*) FILTER (WHERE s = 1) AS authkeywords, CAST(count(*) AS INTEGER) AS last FROM bound",
    "yearly_share": f"{WITH} SELECT year, 100.0::DOUBLE * count(*) FILTER (WHERE citations > 100) / count(*) AS cited_share FROM records GROUP BY 1",
}
ORACLES["doi_diff_counts"] = f"SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM ({ORACLES['doi_diff']})"
SHARE_BAND = ORACLES["wilson_band"]
ORACLES |= {
    "plan_cells": "SELECT CAST(y - 1993 AS INTEGER) AS cell, 'TITLE(graphene)' AS query, CAST(y AS VARCHAR) AS date, CAST(y AS INTEGER) AS year, 'STANDARD' AS view, CAST(200 AS INTEGER) AS page_size FROM range(1994, 1998) t(y)",
    "plan_years": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1997 GROUP BY 1",
    "complete_records": "SELECT CAST(event_id AS VARCHAR) AS record_id, event_type AS title, CASE WHEN event_id % 3 <> 0 THEN 'alpha | beta' END AS authkeywords FROM events",
    "result_pages": """WITH e AS (SELECT CASE WHEN event_id % 16 = 0 THEN -event_id ELSE CAST(floor(event_id / 3) AS BIGINT) END AS page, event_id AS position, event_id % 4 = 0 AND event_id % 8 = 0 AS lone FROM events)
        SELECT page, position FROM e QUALIFY NOT (count(*) OVER (PARTITION BY page) = 1 AND lone)""",
    "abstract_rows": """SELECT '10.1/' || p_partkey AS id, CAST(p_partkey AS VARCHAR) AS record_id, '10.1/' || p_partkey AS doi, p_name AS title, 'About ' || p_type AS abstract, p_brand AS publication,
        CAST(1990 + p_partkey % 30 AS INTEGER) AS year, CAST(p_size AS INTEGER) AS citations, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE p_brand || '; ' || p_type END AS authkeywords,
        CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_references, CAST(2 AS INTEGER) AS reported_references, CAST(p_partkey AS VARCHAR) AS first_id, '10.3/' || p_partkey AS first_doi, p_type AS first_title,
        'Roe, R.; Poe' AS first_authors, 'J' AS first_source, CAST(1950 + p_partkey % 70 AS INTEGER) AS first_year, CAST(NULL AS INTEGER) AS first_citedbycount, CASE WHEN p_partkey % 3 = 0 THEN '10.4/x' END AS second_doi FROM part""",
    "corpus_rows": f"""{WITH}, r AS (SELECT entry_number, {CLEAN_SQL} AS id, title, year FROM records)
        SELECT r.entry_number, r.id, r.title, r.year, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN p_brand || '|' || p_type WHEN 3 THEN p_brand || '|' || p_type ELSE '' END AS keywords,
               CAST(CASE WHEN p_partkey IS NULL THEN 0 WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_references
        FROM r LEFT JOIN part ON r.id = '10.1/' || p_partkey WHERE r.id IS NOT NULL""",
    "share_chart": f"""WITH b AS ({SHARE_BAND}) SELECT *, sum(n) OVER (PARTITION BY abridged_query) AS topic_total, year = max(year) OVER () AS last_year FROM b
        WHERE query_type = 'comparison' AND comparison_percentage IS NOT NULL""",
    "size_chart": f"SELECT * FROM ({ORACLES['concept_sizes']}) WHERE n > 0",
    "label_places": f"""{COUNTED}, e AS (SELECT abridged_query, year, comparison_percentage + year / 1e6::DOUBLE AS v FROM comparison WHERE query_type = 'comparison' AND comparison_percentage IS NOT NULL),
        r AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS k FROM e)
        SELECT abridged_query, year, v, max(v - 0.5::DOUBLE * k) OVER (ORDER BY k) + 0.5::DOUBLE * k AS label_at FROM r""",
    "merge_counts": f"{WITH} {SLICES} SELECT (SELECT count(*) FROM bound) AS n_in, (SELECT count(*) FROM kept) AS n_out, (SELECT count(*) FROM bound) - (SELECT count(*) FROM kept) AS n_removed",
    "diff_in_order": f"SELECT doi, status, CAST(CASE status WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END AS INTEGER) AS place FROM ({ORACLES['doi_diff']})",
    "raw_strings": """SELECT CAST(o_orderkey AS INTEGER) AS entry_number, CAST(NULL AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS doi, o_orderpriority AS title, CAST(NULL AS VARCHAR) AS authors,
        CAST(CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS publication, CAST(trunc(o_totalprice) AS INTEGER) AS citations, CAST(NULL AS VARCHAR) AS query FROM orders""",
    "csv_round_trip": f"{WITH} SELECT {RECORD_COLUMNS} FROM records",
    "doi_file": f"SELECT doi FROM ({ORACLES['distinct_dois']})",
    "ris_file": f"""{WITH} SELECT tag, n FROM (SELECT unnest(['TY', 'TI', 'AU', 'PY', 'JO', 'DO', 'N1', 'ER']) AS tag,
        unnest([count(*), count(title), 2 * count(authors), count(year), count(publication), count(doi), count(record_id), count(*)]) AS n FROM records)""",
    "html_escaped": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages",
    "without_ansi": "SELECT doc_id, source || ':' || lang AS plain FROM documents",
    "added_harvests": f"{WITH} {SLICES} SELECT entry_number, record_id, doi FROM bound",
    "checklist": "SELECT CAST(i AS INTEGER) AS item, name, CASE WHEN i IN (1, 8, 9, 15) THEN 'record' ELSE 'author' END AS source FROM (SELECT unnest(range(1, 17)) AS i, unnest(["
    + ", ".join(f"'{n}'" for n in report.ITEMS)
    + "]) AS name)",
    "trend_totals": f"WITH {LITERATURE} SELECT 'widget' AS query, CAST(count(*) AS DOUBLE) AS total FROM lit WHERE contains(lower(title), 'widget') AND (year BETWEEN 1995 AND 2001 OR year = 2005)",
    "clamped_demo": f"""{WITH}, span AS (SELECT min(year) AS a, max(year) AS b FROM records),
        k AS (SELECT records.* FROM records, span WHERE year BETWEEN least(greatest(1980, a), b) AND least(greatest(1995, a), b) QUALIFY row_number() OVER (PARTITION BY year ORDER BY entry_number) <= 3)
        SELECT {RECORD_COLUMNS.replace('entry_number', 'CAST(row_number() OVER (ORDER BY entry_number) AS INTEGER) AS entry_number', 1)} FROM k""",
    "plain_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, chr(8208) || chr(8209), '--'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS plain FROM documents",
    "file_safe": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS name FROM pages",
    "wrapped_terms": "SELECT t AS tag, 'ALL(' || t || ')' AS once, 'ALL(' || t || ')' AS wrapped, false AS tagged FROM (SELECT unnest(["
    + ", ".join(f"'{t}'" for t in FIELD_TAGS)
    + "]) AS t)",
}
