"""Series preparation, event detection and calendar mapping."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterline.operators import events as ev
from quarterline.operators import series as sr
from quarterline.plans import panel as pn


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n - 1)


def days(spark, *ns, name="date"):
    return spark.createDataFrame([(day(n),) for n in ns], f"{name} date").repartition(2)


def ordinal(d):
    return None if d is None else (d - dt.date(2020, 1, 1)).days + 1


def test_mapping(spark):
    cal, events = days(spark, 1, 3, 5), days(spark, -3, 1, 2, 3, 4, 5, 9, name="event_date")
    got = ev.map_strict_next(events, cal).orderBy("event_date").collect()
    assert [ordinal(r.date_mapped) for r in got] == [1, 3, 3, 5, 5, None, None]
    got = ev.map_on_or_after(events, cal).orderBy("event_date").collect()
    assert [ordinal(r.date_used) for r in got] == [1, 1, 3, 3, 5, 5, 5]
    none = ev.map_on_or_after(events, cal.where("false")).collect()
    assert all(r.date_used is None for r in none)
    one = ev.map_strict_next(events, days(spark, 4)).orderBy("event_date").collect()
    assert [ordinal(r.date_mapped) for r in one] == [4, 4, 4, 4, None, None, None]


def test_centered_change_edges(spark):
    series = spark.createDataFrame(
        [(day(1), 1.0), (day(2), None), (day(3), 4.0), (day(5), 9.0)], "date date, value double"
    )
    events = days(spark, 1, 2, 4, 30, name="event_date")
    got = ev.centered_change(events, series).orderBy("event_date").collect()
    assert [(r.S_policy, r.S_policy_available) for r in got] == [(0, 0), (8.0, 1), (0, 0), (0, 0)]


def test_collapse(spark):
    df = days(spark, 1, 2, 2, 3, 7).withColumn("event_type", F.lit("x"))
    got = ev.collapse_consecutive_days(df).orderBy("date").collect()
    assert [ordinal(r.date) for r in got] == [1, 7]


def test_change_points(spark):
    values = [1.0, 1.0, 2.0, None, 2.0, 3.0]
    rows = [("r", day(i + 1), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "indicator string, date date, value double").repartition(3)
    assert sorted(ordinal(r.date) for r in ev.change_points(df).collect()) == [3, 6]


@pytest.mark.parametrize("dense,want", [(500, [1, 2, 4]), (2, [4])])
def test_sparsest_indicator(spark, dense, want):
    cells = [("a", 1, [1, 1, None, 5]), ("b", 2, [1, 2, 3, 4])]
    rows = [("T", n, r, day(i + 1), None if v is None else float(v)) for n, r, vs in cells for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_type string, indicator string, row int, date date, value double")
    assert sorted(ordinal(r.date) for r in ev.indicator_event_dates(df, dense=dense).collect()) == want


@pytest.mark.parametrize("scale,share", [("equal", 0.5), ("none", 1.0)])
def test_spread(spark, scale, share):
    cal = days(spark, 1, 3, 5)
    events = spark.createDataFrame([(day(1), 2.0), (day(5), 4.0), (day(1), 1.0)], "date_mapped date, v double")
    got = ev.spread_event_window(cal, events, ["v"], 1, scale).orderBy("date").collect()
    assert [r.v for r in got] == [3 * share, 3 * share, 4 * share]
    with pytest.raises(ValueError):
        ev.spread_event_window(cal, events, ["v"], 1, "half")


def test_forecast(spark):
    rows = [(3.0, 1.0, 2.0), (3.0, None, 2.0), (3.0, None, None), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "actual double, median double, mean double").coalesce(1)
    got = [(r.S_gdp, r.forecast_available) for r in ev.forecast_surprise(df).collect()]
    assert got == [(2.0, 1), (1.0, 1), (0.0, 0), (None, 1)]


def test_union_dummies(spark):
    df = spark.createDataFrame([("a", day(1)), ("b", day(1)), ("b", day(2))], "event_type string, date date")
    got = [tuple(r)[1:] for r in ev.event_union_dummies(df, ["a", "b", "c"]).orderBy("date").collect()]
    assert got == [(1, 1, 0, 1), (0, 1, 0, 1)]


def test_event_delta_shock(spark):
    rows = [(day(i + 1), v, e) for i, (v, e) in enumerate([(1.0, 1), (9.0, 0), (3.0, 1), (2.0, 1)])]
    df = spark.createDataFrame(rows, "date date, level double, e int")
    got = ev.event_delta_shock(df, {"level": "shock"}, "e", standardize=False).orderBy("date").collect()
    assert [r.shock for r in got] == [0.0, 0.0, 2.0, -1.0]


def test_forward_cumulative(spark):
    rows = [("s", day(i + 1), v) for i, v in enumerate([1.0, 2.0, 3.0])]
    rows += [("t", day(i + 1), v) for i, v in enumerate([1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "series string, date date, v double").repartition(4)
    got = sr.forward_cumulative(df, "v", [1], by=["series"]).orderBy("series", "date").collect()
    assert [r.cum_1 for r in got] == [3.0, 5.0, None, None, None, None]


def test_fill_and_quarterly(spark):
    rows = [(day(1), None), (day(2), 2.0), (day(3), None), (day(95), 5.0)]
    df = spark.createDataFrame(rows, "date date, v double").repartition(3)
    got = sr.forward_fill(df, ["v"]).orderBy("date").collect()
    assert [r.v for r in got] == [None, 2.0, 2.0, 5.0]
    got = sr.quarterly_aggregate(df, {"v": "last"}).orderBy("quarter").collect()
    assert [(r.year, r.quarter, r.v) for r in got] == [(2020, 1, 2.0), (2020, 2, 5.0)]


def test_validated_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, b string")
    assert [tuple(r) for r in sr.validated_join(a, b, ["k"]).collect()] == [(1, "x", "p")]
    with pytest.raises(Exception, match="repeated key"):
        sr.validated_join(a.union(a), b, ["k"]).collect()


def test_controls(spark):
    rows = [("单位", "x", "元"), ("2020-01-02", "--", "7.0"), ("2020-01-01", "2.0", "6.5")]
    df = spark.createDataFrame(rows, "`指标名称` string, `SHIBOR:1周` string, `美元兑人民币` string")
    got = sr.daily_controls(df, "指标名称").orderBy("date").collect()
    assert [(r.short_rate, r.short_rate_chg, r.usdcny_chg) for r in got] == [(2.0, None, None), (2.0, 0.0, 0.5)]
    assert got[1].ib_minus_shibor is None
    with pytest.raises(ValueError):
        sr.daily_controls(df.drop("美元兑人民币"), "指标名称")


def test_panel_without_events(spark):
    returns = days(spark, 1, 2, 3).withColumn("SH", F.lit(0.1))
    reports = spark.createDataFrame([(2020, 1, day(1)), (2020, 2, day(3))], "year int, quarter int, report_date date")
    tone = spark.createDataFrame([(2020, 1, 2.0, 1.0), (2020, 2, 3.0, 3.0)], "year int, quarter int, t double, s double")
    got = pn.daily_panel(returns, reports, tone, ["t"], {"s": "S"}, {("x", "d"): None}).orderBy("date").collect()
    assert [(r.x, r.d, r.D_report, r.t) for r in got] == [(0, 0, 0, 0), (0, 0, 1, 2), (0, 0, 0, 0)]
    assert got[1].S == pytest.approx(-0.70710678)
