import pytest

from citelake import errors
from citelake.operators import describe, harvest, inputs, remote, sets
from citelake.plans.search import SearchPlan
from citelake.schema import RECORDS
from citelake.sources.transport import Service
from tests.mock_service import entry, service

KEY = {"apiKey": "k", "pause": "0"}


def test_trend_asks_once_a_year(spark, tmp_path):
    with service(450) as (url, asked):
        made = remote.trend(spark, "graphene", [2016, 2015, 2016], Service(url, "k", pause=0), str(tmp_path), field="title")
        rows = sorted(map(tuple, made.table.collect()))
        assert rows == [("TITLE(graphene)", 2015, 45.0), ("TITLE(graphene)", 2016, 45.0)] and made.remaining == 19999
        made.table.count()
        assert len(asked) == 2 and {q["date"] for q in asked} == {"2015", "2016"} and all(q["count"] == "1" for q in asked)
        assert describe.trend_line(made.table) == "trend over 2 years: 90 records"
        for bad in ({"query": " ", "years": [2015]}, {"query": "x", "years": None}, {"query": "x", "years": [2015], "field": "a b"}):
            with pytest.raises(errors.BadInput):
                remote.trend(spark, service=Service(url, "k"), cache_dir=str(tmp_path), **bad)
    with service(5, say_total=False) as (url, _), pytest.warns(errors.MissingCounts):
        assert remote.trend(spark, "x", [2015], Service(url, "k", pause=0), str(tmp_path)).table.first()["n"] is None
    with pytest.raises(errors.NoKey):
        remote.trend(spark, "x", [2015], Service(url), str(tmp_path))


def test_comparison_from_counts(spark, tmp_path):
    def answer(q):
        return {"priming": {"2018": 0}.get(q["date"], 10), "priming AND t1": 5, "priming AND t2": 2}[q["query"]]

    with service(answer=answer) as (url, asked):
        made = remote.compare_topics(spark, "priming", ["t1", "t2"], range(2015, 2021), Service(url, "k", pause=0), str(tmp_path))
        rows = made.table.collect()
        assert len(asked) == 18 and len(rows) == 18 and made.remaining == 19999
    assert [r["query_type"] for r in rows[:6]] == ["reference"] * 6 and [r["abridged_query"] for r in rows[6:]] == ["t1"] * 6 + ["t2"] * 6
    assert {r["average_comparison_percentage"] for r in rows[6:12]} == {60.0} and {r["average_comparison_percentage"] for r in rows[12:]} == {24.0}
    assert [r["comparison_percentage"] for r in rows if r["year"] == 2018] == [None, None, None]
    assert describe.comparison_line(made.table) == "comparison of 2 terms with the reference, 2015 to 2020"
    for bad in ([], ["a", " "], "t1"):
        with pytest.raises(errors.BadInput):
            remote.compare_topics(spark, "x", bad, [2015], Service(url, "k"), str(tmp_path))


def test_intersections_from_counts(spark, tmp_path):
    sizes = {"TITLE(a)": 6600, "ABS(b)": 2100, "(TITLE(a)) AND (ABS(b))": 15}
    with service(answer=lambda q: sizes[q["query"]]) as (url, asked):
        svc = Service(url, "k", pause=0)
        made = remote.concept_sizes(spark, {"alpha": "a", "beta": "ABS(b)"}, [("alpha", "beta")], svc, str(tmp_path), [2015, 2017], "title", {"beta": "B"})
        assert [tuple(r) for r in made.table.collect()] == [
            ("alpha", "TITLE(a)", 6600.0, "concept", 1, "alpha"), ("beta", "ABS(b)", 2100.0, "concept", 1, "beta"), ("alpha × B", "(TITLE(a)) AND (ABS(b))", 15.0, "intersection", 2, "alpha; beta"),
        ]
        assert len(asked) == 3 and {q["date"] for q in asked} == {"2015-2017"}
        assert describe.sizes_line(made.table) == "2 concepts and 1 intersections"
        with pytest.raises(errors.BadInput):
            remote.concept_sizes(spark, {"a": "a"}, [("a", "z")], svc, str(tmp_path))
        assert len(asked) == 3  # checked before anything is asked


def test_refusals_reach_the_caller(spark, tmp_path):
    with service(fail_first=9, status=403) as (url, _), pytest.raises(Exception, match="403"):
        remote.trend(spark, "x", [2015], Service(url, "k", pause=0), str(tmp_path))


def test_fetch_in_one_call(spark, tmp_path):
    with service(1000) as (url, asked):
        made = harvest.fetch_records(spark, "graphene", url, str(tmp_path), field="title", **KEY)
        assert made.records.count() == 1000 and made.records.columns == RECORDS.names
        assert len(asked) == 5 and asked[0]["query"] == "TITLE(graphene)"  # a request a page, none for the total
        p = made.provenance
        assert (p.total_results, p.paging, p.versions, p.quota_remaining) == (1000.0, "offset", (harvest.VERSION,), 19999) and p.retrieved_at is not None
        some = harvest.fetch_records(spark, "x", url, str(tmp_path), years=[2015], max_results=30, cursor=True, **KEY)
        assert some.records.count() == 30 and some.provenance.paging == "cursor" and some.provenance.total_results == 100.0
        with pytest.warns(errors.Capped):
            assert harvest.fetch_records(spark, "x", url, str(tmp_path), hardCap=400, **KEY).records.count() == 400
    with service(0) as (url, asked):
        none = harvest.fetch_records(spark, "x", url, str(tmp_path), **KEY)
        assert none.records.count() == 0 and none.provenance.total_results == 0.0 and len(asked) == 1
    with service(450) as (url, asked):
        plan = SearchPlan.make("x", [2015, 2016], partition="year")
        assert harvest.run_plan(spark, plan, f"{tmp_path}/plan", url, **KEY).provenance.quota_remaining == 19999 and len(asked) == 2
    assert describe.plan_line(plan) == "plan of 2 cells for x, 2015 to 2016, 200 a page"


def test_inputs(spark):
    table = spark.createDataFrame([(1, "10.1/A"), (2, None)], "entry_number int, doi string")
    for given in (table, ["10.1/A", None], harvest.Harvest(table)):
        assert sorted(map(tuple, inputs.doi_table(spark, given).collect())) == [(1, "10.1/A"), (2, None)]
    assert inputs.doi_table(spark, table.select("doi")).count() == 2
    diff = sets.doi_diff(inputs.doi_table(spark, ["10.1/a", "10.1/b"]), inputs.doi_table(spark, ["https://doi.org/10.1/A", "10.1/c"]))
    assert describe.diff_line(diff) == "1 added, 1 removed, 1 unchanged"
    for bad in ("10.1/a", [1], 5, spark.range(1)):
        with pytest.raises(errors.BadInput):
            inputs.doi_table(spark, bad)
    page = {"search-results": {"entry": [entry(1), entry(2)]}}
    for given in (page, page["search-results"], [entry(1), entry(2)]):
        got = inputs.records_of(spark, given, "q")
        assert got.columns == RECORDS.names and [r["record_id"] for r in got.orderBy("entry_number").collect()] == ["1", "2"]
    assert inputs.records_of(spark, got) is got and inputs.records_of(spark, {"entry": [{"error": "none"}]}).count() == 0 and inputs.records_of(spark, []).count() == 0
    assert describe.records_line(got) == "2 records, 2 with a DOI, 2002 to 2003"
    for bad in ("x", ["x"]):
        with pytest.raises(errors.BadInput):
            inputs.records_of(spark, bad)


def test_keys_of_a_base_that_many_share(spark):
    from citelake.operators.export import citation_keys

    df = spark.range(1, 101).selectExpr("CAST(id AS int) AS entry_number", "CAST(NULL AS string) AS authors", "CAST(NULL AS int) AS year", "CAST(NULL AS string) AS record_id")
    want = [r["key"] for r in citation_keys(df).orderBy("entry_number").collect()]
    assert want[:3] == ["scopusrecord", "scopusrecorda", "scopusrecordb"] and want[-1] == "scopusrecord99"
    assert [r["key"] for r in citation_keys(df, block=7).orderBy("entry_number").collect()] == want
