import json
import pickle
import warnings
from datetime import UTC, datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citelake import errors
from citelake.operators import abstracts, harvest, report
from citelake.plans.search import SearchPlan, requests_needed, terms_of
from citelake.query import query
from citelake.schema import RECORDS, empty_records
from citelake.sources import files, transport
from citelake.sources.search import read_search
from tests.mock_service import service

KEY = {"apiKey": "k", "pause": "0"}


def positions(df):
    return [r["position"] for r in df.collect()]


def test_offset_paging(spark):
    with service(450) as (url, asked):
        df = read_search(spark, url=url, query="x", **KEY)
        assert sorted(positions(df)) == list(range(1, 451)) and len(asked) == 3
        assert max(int(q["count"]) for q in asked) == 200 and all(q["key"] == "k" for q in asked)
        assert sorted(positions(read_search(spark, url=url, query="x", maxResults=30, **KEY))) == list(range(1, 31))
        with pytest.warns(errors.Capped):
            assert len(positions(harvest.fetch(spark, "x", url, hardCap=200, **KEY))) == 200
    with service(450, say_total=False) as (url, _):
        assert len(positions(read_search(spark, url=url, query="x", **KEY))) == 450
    with service(0) as (url, _):
        assert positions(read_search(spark, url=url, query="x", **KEY)) == []


def test_cursor_paging_and_count(spark):
    with service(450) as (url, asked):
        assert positions(read_search(spark, url=url, query="x", mode="cursor", **KEY)) == list(range(1, 451))
        assert len(asked) == 3
        assert harvest.count(spark, "x", url, **KEY) == 450.0
    with service(runaway=True) as (url, asked):
        assert len(positions(read_search(spark, url=url, query="x", mode="cursor", maxCursorPages=4, **KEY))) == 800


def test_retries_and_errors(spark):
    with service(10, fail_first=2) as (url, asked):
        assert len(positions(read_search(spark, url=url, query="x", **KEY))) == 10
        assert len(asked) == 3  # two failures, then the only page: nothing is asked for the total alone
    waits = []
    with service(10, fail_first=2) as (url, asked):
        transport.Service(url, "k", backoff=lambda n: waits.append(n) or 0).page("x", 1, start=0)
        assert waits == [1, 2]
    for status, kind in ((400, errors.BadRequest), (401, errors.Unauthorized), (403, errors.Forbidden), (404, errors.NotFound), (413, errors.TooLong), (500, errors.ServerFault)):
        with service(fail_first=9, status=status) as (url, asked), pytest.raises(kind) as caught:
            transport.Service(url, "k", pause=0).page("x", 1, start=0)
        assert caught.value.status == status and pickle.loads(pickle.dumps(caught.value)).status == status
        assert len(asked) == (3 if status in errors.TRANSIENT else 1)
    with service(body=b"<html>") as (url, _), pytest.raises(errors.Malformed):
        transport.Service(url, "k").page("x", 1)
    with pytest.raises(errors.NoKey):
        transport.Service("http://localhost:1").headers()
    with pytest.raises(errors.Offline):
        transport.Service("http://127.0.0.1:9", "k", pause=0, timeout=1).page("x", 1)
    with pytest.raises(errors.BadInput):
        transport.Service("http://localhost", "k").page("x", 1, start=0, cursor="*")
    assert "k3y" not in repr(transport.Service("u", "k3y"))
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert transport.retry_after("7") == 7 and transport.retry_after("Thu, 01 Jan 2026 00:00:30 GMT", now) == 30 and transport.retry_after("Thu, 01 Jan 2015 00:00:00 GMT") == 0


def test_plan_run_checkpoints_and_report(spark, tmp_path):
    plan = SearchPlan.make("graphene", range(2015, 2018), "title-abs-key", partition="year")
    assert [c.date for c in plan.cells()] == ["2015", "2016", "2017"] and plan.wrapped == "TITLE-ABS-KEY(graphene)"
    with service(450) as (url, asked):
        made = harvest.run_plan(spark, plan, str(tmp_path), url, **KEY)
        assert made.records.count() == 135 and made.provenance.total_results == 135.0 and made.records.columns == RECORDS.names
        assert sorted(r["entry_number"] for r in made.records.collect()) == list(range(1, 136))
        before = len(asked)
        again = harvest.run_plan(spark, plan, str(tmp_path), url, max_results=5, **KEY)
        assert len(asked) == before and again.records.count() == 15
        with pytest.warns(errors.CacheMismatch):
            harvest.run_plan(spark, SearchPlan.make("other", [2015], partition="year", field="title-abs-key"), str(tmp_path), url, **KEY)
        (tmp_path / "cell=002-2016" / "manifest.json").write_text("{")
        with pytest.warns(errors.CacheUnreadable):
            harvest.run_plan(spark, plan, str(tmp_path), url, resume=True, **KEY)
        old = SearchPlan.make("old", [2015], partition="year")
        made.records.withColumn("query", F.lit("old")).write.parquet(f"{tmp_path}/legacy/cell=001-2015/records")
        asked.clear()
        assert harvest.run_plan(spark, old, f"{tmp_path}/legacy", url, **KEY).records.count() == 135 and not asked
        with pytest.warns(errors.CacheMismatch):
            harvest.run_plan(spark, SearchPlan.make("new", [2015], partition="year"), f"{tmp_path}/legacy", url, **KEY)
    merged = harvest.combine([made, made], remove_duplicates=True)
    assert merged.combined == {"n_in": 270, "n_out": 45, "n_removed": 225, "deduplicated": True}
    assert (made + made).records.count() == 270
    x = report.search_report(made)
    assert x.reported_total == 135.0 and x.years == "2015 to 2017" and x.n_with_doi == 135
    assert [i.item for i in x.prisma if i.source == "record"] == [1, 8, 9, 13, 15]
    y = report.search_report(merged)
    assert 16 in [i.item for i in y.prisma if i.source == "record"] and report.identified(y) == 270
    z = report.search_report(plan=plan)
    assert z.n_records is None and [i.item for i in z.prisma if i.source == "record"] == [1, 8, 9]
    for style in ("report", "markdown", "paragraph"):
        assert "TITLE-ABS-KEY(graphene)" in x.render(style)
    scope: dict = {}
    exec(x.snippet, scope)  # noqa: S102
    assert scope["plan"] == plan


def test_snippets_rebuild_plans():
    for years in (None, [2019], [2015, 2018], range(2010, 2015)):
        for partition in ("none", "year") if years else ("none",):
            plan = SearchPlan.make('a "b"', years, None, "COMPLETE", 10, partition)
            scope: dict = {}
            exec(plan.to_code(), scope)  # noqa: S102
            assert scope["plan"] == plan


def test_validation():
    for bad in ({"query": " "}, {"query": "x", "years": [1699]}, {"query": "x", "years": [2000.5]}, {"query": "x", "field": "a b"}, {"query": "x", "page_size": 201}, {"query": "x", "view": "COMPLETE", "page_size": 26}, {"query": "x", "partition": "year"}, {"query": "x", "view": "none"}):
        with pytest.raises(errors.BadInput):
            SearchPlan.make(**bad)
    assert query("a", "b", operator="OR", field="title").to_string() == "TITLE(a) OR TITLE(b)"
    assert requests_needed(1000, None, 200, 5000) == 5 and requests_needed(1000, None, 25, 5000) == 40
    assert terms_of(" a, b,,a ") == ["a", "b"]
    assert harvest.shortfall(1, 5, 5, None) is False
    with pytest.warns(errors.Shortfall):
        assert harvest.shortfall(1, 4, 5, None)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert not harvest.shortfall(1, 4, 5, 4)
    a = harvest.Provenance(datetime(2026, 1, 2, tzinfo=UTC), ("1",), "offset")
    b = harvest.Provenance(datetime(2026, 1, 1, tzinfo=UTC), ("2",), "cursor")
    assert harvest.Provenance.merge([a, b]) == harvest.Provenance(b.retrieved_at, ("1", "2"), None)
    assert harvest.Provenance.merge([a, harvest.Provenance()]) == harvest.Provenance()


def test_abstracts_and_corpus(spark, tmp_path):
    ids = spark.createDataFrame([("10.1/a",), (" 10.1/b ",), ("10.1/missing",)], "id string")
    with service() as (url, asked):
        svc = transport.Service(url, "k", pause=0)
        with pytest.warns(errors.IncompleteReferences):
            got = {r["id"]: r for r in abstracts.abstracts(spark, ids, svc, str(tmp_path), view="FULL", include=["references", "keywords"]).collect()}
        assert got["10.1/a"]["abstract"] == "An abstract" and got["10.1/a"]["authkeywords"] == "alpha; beta" and got["10.1/a"]["record_id"] == "7"
        assert got["10.1/b"]["references"][0].asDict() == {"position": "1", "id": None, "doi": "10.1/r", "title": "Cited", "authors": "Roe, R.", "source": "J", "year": 1999, "citedbycount": None}
        assert got["10.1/a"]["remaining"] == 19999 and got["10.1/missing"]["remaining"] is None
        assert got["10.1/missing"]["status"] == "NotFound" and got["10.1/missing"]["title"] is None
        before = len(asked)
        found = abstracts.abstracts(spark, ids, svc, str(tmp_path), view="FULL", include=["keywords", "references"])
        assert len(asked) == before + 1  # only the failure is asked again
        with pytest.raises(errors.Forbidden):
            abstracts.abstracts(spark, spark.createDataFrame([("forbidden",)], "id string"), svc, str(tmp_path / "f"))
    records = spark.createDataFrame([(1, None, "10.1/a", "A"), (2, None, "10.1/a", "B"), (3, None, None, "C")], "entry_number int, record_id string, doi string, title string").selectExpr("*", "2020 AS year")
    with pytest.warns(errors.DroppedRecords):
        rows = sorted(abstracts.corpus(records, found).collect())
    assert [(r["entry_number"], r["keywords"], len(r["references"])) for r in rows] == [(1, ["alpha", "beta"], 1), (2, ["alpha", "beta"], 1)]
    short = {"references": {"@total-references": "1", "reference": {"@id": "1", "ref-info": {"author-list": {"author": [{"ce:surname": "A", "ce:given-name": "B"}]}, "ce:doi": "d", "scopus-id": "9", "citedby-count": "4", "ref-coverdate": "2001-02-03"}}}}
    assert abstracts.references_of(short, "REF") == ([{"position": "1", "id": "9", "doi": "d", "title": None, "authors": "A, B", "source": None, "year": 2001, "citedbycount": 4}], 1)
    for bad in ((["references"], None), (["keywords"], "REF"), (["x"], "FULL"), ([], "NONE")):
        with pytest.raises(errors.BadInput):
            abstracts.checked_extras(*bad)


def test_files_round_trip(spark, tmp_path):
    rows = [(1, "7", "10.1/a", 'A "tricky", title\nwith breaks', "É; B", 2020, "2020-01-01", "J", 5, "q"), (2, None, None, "", None, None, None, None, None, "q")]
    records = spark.createDataFrame(rows, RECORDS)
    made = harvest.Harvest(records, harvest.Provenance(datetime(2026, 1, 1, tzinfo=UTC), ("1",), "offset", 2.0))
    for end in ("csv", "parquet"):
        files.write_records(made, f"{tmp_path}/r.{end}")
        back = files.read_records(spark, f"{tmp_path}/r.{end}")
        assert sorted(map(tuple, back.records.collect())) == rows
    assert back.provenance == made.provenance
    plan = SearchPlan.make("q", [2015, 2016], partition="year")
    whole = harvest.Harvest(records, harvest.Provenance(None, ("1", "2"), None, None, 5), plan, (harvest.CellTotal(1, "2015", 1, 1.0), harvest.CellTotal(2, "2016", 1, None)), {"n_in": 3, "n_out": 2, "n_removed": 1, "deduplicated": True})
    files.write_records(whole, f"{tmp_path}/w.parquet")
    same = files.read_records(spark, f"{tmp_path}/w.parquet")
    assert (same.provenance, same.plan, same.cell_totals, same.combined) == (whole.provenance, whole.plan, whole.cell_totals, whole.combined)
    files.write_report(report.search_report(whole), spark, f"{tmp_path}/report.md", "markdown")
    assert (tmp_path / "report.md").read_text() == report.search_report(whole).render("markdown")
    files.write_records(harvest.Harvest(empty_records(spark)), f"{tmp_path}/e.parquet")
    assert files.read_records(spark, f"{tmp_path}/e.parquet").records.count() == 0
    with pytest.raises(errors.BadInput):
        files.format_of("x.rds")


def test_invalid_json_is_an_error(spark):
    from citelake.operators.normalise import drop_sentinel, entries_to_records

    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        entries_to_records(spark.createDataFrame([(1, "{")], "position int, entry string"), "q").collect()
    shapes = [{"dc:creator": ["A", "B"], "prism:coverDate": "c2020", "citedby-count": "12.7"}, {"dc:creator": [{"x": 1}], "prism:coverDate": "2020"}, {"dc:creator": {"x": 1}, "citedby-count": "many"}, {"dc:creator": [], "dc:title": None}, {"dc:creator": ["A", None]}]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "position int, entry string")
    got = [(r["authors"], r["year"], r["citations"]) for r in sorted(entries_to_records(df, "q").collect())]
    assert got == [("A; B", None, 12), (None, 2020, None), (None, None, None), (None, None, None), (None, None, None)]
    pages = spark.sql("""SELECT 1 AS page, 1 AS position, parse_json('{"error":"none"}') AS entry UNION ALL SELECT 2, 1, parse_json('{"error":"e","dc:identifier":"5"}')""")
    assert [r["page"] for r in drop_sentinel(pages).collect()] == [2]


def test_streams(spark, tmp_path):
    from citelake.streaming import tracking

    spark.createDataFrame([(1, "10.1/a"), (2, "10.1/b"), (3, "10.1/b")], "entry_number int, doi string").coalesce(1).write.parquet(f"{tmp_path}/in")
    base = spark.createDataFrame([(1, "10.1/b"), (2, "10.1/c")], "entry_number int, doi string")
    out = []
    stream = spark.readStream.schema("entry_number int, doi string").parquet(f"{tmp_path}/in")
    tracking.track_changes(stream, base, lambda df, n: out.extend(sorted(map(tuple, df.collect()))), f"{tmp_path}/cp").awaitTermination()
    assert out == [("10.1/a", "added"), ("10.1/b", "unchanged"), ("10.1/c", "removed")]
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/event*.parquet")
    q = tracking.deduplicated(events.selectExpr("CAST(ts AS timestamp) AS ts", "user_id"), "user_id", "ts", "365 days").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    assert spark.table("seen").count() == users
