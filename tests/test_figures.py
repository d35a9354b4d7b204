import pytest

from citelake import errors
from citelake.functions.stats import wilson
from citelake.operators import analyse, figures


def test_axis_numbers():
    assert figures.log_breaks(0.55, 400) == [1.0, 3.0, 10.0, 30.0, 100.0, 300.0]
    assert figures.log_breaks(1, 10**5) == [10.0**k for k in range(6)]
    low, high = figures.log_limits([10, 1000])
    assert round(low, 6) == round(10**0.8, 6) and round(high, 6) == round(10**3.2, 6)
    low, high = figures.log_limits([7])
    assert low < 7 < high
    with pytest.raises(errors.BadInput):
        figures.log_limits([0])
    assert figures.year_breaks([2015, 2016]) == [2015, 2016] and figures.year_breaks(range(1980, 2021)) == [1980, 1990, 2000, 2010, 2020]
    assert figures.upper_limit([12.1, None]) == 15 and figures.upper_limit([99.5]) == 100
    assert figures.free_quadrant([(0, 0), (1, 0), (1, 1)]) == ("upper", "left")
    assert figures.free_quadrant([(0, 1), (1, 0), (1, 1), (float("nan"), 0)]) == ("lower", "left")
    assert figures.free_quadrant([]) == ("upper", "left")


def test_tables(spark):
    counts = [(0, "r", "reference", "r", y, 10.0, 10.0) for y in (2015, 2016)]
    counts += [(1, "r AND t", "comparison", "t", 2015, 5.0, 10.0), (1, "r AND t", "comparison", "t", 2016, None, 10.0), (2, "r AND u", "comparison", "u", 2015, 2.0, 0.0)]
    df = analyse.shares(spark.createDataFrame(counts, "_topic int, query string, query_type string, abridged_query string, year int, n double, reference_n double")).drop("_topic")
    with pytest.warns(UserWarning, match="2 rows"):
        rows = figures.share_lines(df).collect()
    assert [(r["abridged_query"], r["comparison_percentage"], r["last_year"]) for r in rows] == [("t", 50.0, True)]
    assert rows[0]["low"] < 50 < rows[0]["high"]
    sizes = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("c", 1.0)], "label string, n double")
    with pytest.warns(UserWarning, match="1 rows"):
        assert [r["label"] for r in figures.positive_sizes(sizes).collect()] == ["c", "a"]
    ends = spark.createDataFrame([(1.0,), (1.5,), (1.6,), (9.0,)], "v double")
    assert [round(r["label_at"], 6) for r in figures.spread_labels(ends, "v", 1.0).orderBy("v").collect()] == [1.0, 2.0, 3.0, 9.0]


def test_documented_averages(spark):
    rows = [(0, "q", "comparison", "q", 2015 + i, n, r) for i, (n, r) in enumerate([(100.0, 1000.0), (500.0, None), (300.0, 2000.0)])]
    df = analyse.shares(spark.createDataFrame(rows, "_topic int, query string, query_type string, abridged_query string, year int, n double, reference_n double"))
    got = df.orderBy("year").collect()
    assert [r["comparison_percentage"] for r in got] == [10.0, None, 15.0]
    assert all(abs(r["average_comparison_percentage"] - 400 / 30) < 1e-9 for r in got)
    zero = spark.range(1).selectExpr("0D AS n", "0D AS of")
    low, high = wilson(zero["n"], zero["of"])
    assert zero.select(low.alias("a"), high.alias("b")).first() == (None, None)


def test_concept_checks():
    from citelake.query import query

    concepts = {"a": query("a"), "b": query("b")}
    assert analyse.check_concepts(concepts, [("a", "b")], {"a": "A"}) == [("A × b", ("a", "b"))]
    for bad in ([("a",)], [("a", "a")], [("a", "z")], [("a", "b"), ("a", "b")]):
        with pytest.raises(errors.BadInput):
            analyse.check_concepts(concepts, bad)
    with pytest.raises(errors.BadInput):
        analyse.check_concepts(concepts, [], {"z": "Z"})
