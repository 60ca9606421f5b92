"""Daily and quarterly series."""

from pyspark.sql import functions as F

from quarterline.catalog.base import LEVELS, QUARTERLY, levels, quarterly, query, r6, table
from quarterline.functions.coerce import period_label
from quarterline.operators import series as sr


def gappy(spark, sf):
    """Daily levels per series with every third day of the month missing."""
    value = F.when(F.dayofmonth("date") % 3 != 0, F.col("value"))
    return levels(spark, sf).withColumn("value", value)


GAPPY = f"{LEVELS}, gappy AS (SELECT series, date, CASE WHEN day(date) % 3 <> 0 THEN value END AS value FROM levels)"


@query(
    "forward_fill",
    f"""WITH {GAPPY} SELECT series, date, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS value FROM gappy""",
)
def forward_fill(spark, sf):
    filled = sr.forward_fill(gappy(spark, sf), ["value"], by=["series"])
    return filled.withColumn("value", F.round("value", 2))


def rates(spark, sf):
    """Daily sheet with the raw column names of a data vendor, some cells unreadable."""
    d = F.to_date("l_shipdate")
    daily = table(spark, sf, "lineitem").groupBy(d.alias("d")).agg(
        F.avg("l_discount").alias("a"), F.avg("l_quantity").alias("b"), F.avg("l_tax").alias("c")
    )
    hide = F.when(F.dayofmonth("d") % 5 == 0, "--").otherwise(F.round("a", 6).cast("string"))
    return daily.select(
        F.col("d").cast("string").alias("指标名称"),
        hide.alias("SHIBOR:1周"),
        F.round("b", 6).cast("string").alias("中间价:美元兑人民币"),
        F.round("c", 6).cast("string").alias("7天回购利率:加权"),
    )


RATES = """
daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN day(l_shipdate) % 5 <> 0 THEN round(avg(l_discount), 6) END AS s0,
         round(avg(l_quantity), 6) AS usdcny_mid, round(avg(l_tax), 6) AS ib_7d
  FROM lineitem GROUP BY CAST(l_shipdate AS DATE), day(l_shipdate)),
filled AS (
  SELECT *, last_value(s0 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shibor_1w FROM daily),
short AS (SELECT *, coalesce(shibor_1w, ib_7d) AS short_rate FROM filled),
controls AS (
  SELECT date, usdcny_mid, usdcny_mid - lag(usdcny_mid) OVER (ORDER BY date) AS usdcny_chg,
         ln(usdcny_mid / lag(usdcny_mid) OVER (ORDER BY date)) AS fx_ret, shibor_1w, ib_7d, short_rate,
         short_rate - lag(short_rate) OVER (ORDER BY date) AS short_rate_chg, ib_7d - shibor_1w AS ib_minus_shibor FROM short)"""
_CONTROLS = ("usdcny_mid", "usdcny_chg", "fx_ret", "shibor_1w", "ib_7d", "short_rate", "short_rate_chg", "ib_minus_shibor")


def controls(spark, sf):
    return sr.daily_controls(rates(spark, sf), "指标名称")


@query("daily_controls", f"WITH {RATES} SELECT date, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in _CONTROLS)} FROM controls")
def daily_controls(spark, sf):
    return r6(controls(spark, sf))


@query(
    "diff_logret_spread",
    f"""WITH {LEVELS}, w AS (SELECT series, date, value / 31415.93e0 AS v FROM levels)
SELECT series, date, round(v - lag(v) OVER s, 6) + 0e0 AS diff, round(ln(v / lag(v) OVER s), 6) + 0e0 AS ret,
       round(v - 2 * v, 6) AS spread, CAST(NULL AS DOUBLE) AS absent FROM w WINDOW s AS (PARTITION BY series ORDER BY date)""",
)
def diff_logret_spread(spark, sf):
    rows = levels(spark, sf).select(
        "series", "date", (F.col("value") / 31415.93).alias("v"), (2 * F.col("value") / 31415.93).alias("u")
    )
    out = sr.add_changes(
        rows, {"diff": "v"}, {"ret": "v"}, {"spread": ("v", "u"), "absent": ("v", "nope")}, by=["series"]
    )
    return r6(out.drop("v", "u"))


@query(
    "quarterly_aggregate",
    f"""WITH {GAPPY} SELECT series, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
  round(max(value), 2) AS top, round(avg(value) / 1e5, 6) AS mean, round(arg_max(value, date) FILTER (WHERE value IS NOT NULL), 2) AS last
FROM gappy GROUP BY ALL""",
)
def quarterly_aggregate(spark, sf):
    rows = gappy(spark, sf).select(
        "series", "date", F.col("value").alias("top"), (F.col("value") / 100000).alias("mean"),
        F.col("value").alias("last"),
    )
    out = sr.quarterly_aggregate(rows, {"top": "max", "mean": "mean", "last": "last"}, by=["series"])
    return out.withColumns(
        {"top": F.round("top", 2), "mean": F.round("mean", 6), "last": F.round("last", 2)}
    )


@query(
    "daily_to_quarter_mean",
    f"""WITH {RATES} SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, round(avg(short_rate), 6) AS short_rate_level
FROM short WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL""",
)
def daily_to_quarter_mean(spark, sf):
    return r6(
        sr.daily_to_quarter_mean(
            controls(spark, sf), "short_rate", "short_rate_level", "1996-01-01", "2000-12-31"
        )
    )


@query(
    "quarterly_join",
    f"""WITH {RATES}, {QUARTERLY},
r AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, avg(short_rate) AS level FROM short
      WHERE date BETWEEN DATE '1995-04-01' AND DATE '2001-03-31' GROUP BY ALL)
SELECT concat(q.year, 'Q', q.quarter) AS period, q.year, q.quarter, round(tone_policy, 6) AS gdp_yoy, round(level, 6) AS short_rate_level
FROM quarterly q JOIN r ON r.year = q.year AND r.quarter = q.quarter""",
)
def quarterly_join(spark, sf):
    rate = sr.daily_to_quarter_mean(
        controls(spark, sf), "short_rate", "short_rate_level", "1995-04-01", "2001-03-31"
    )
    macro = quarterly(spark, sf).select("year", "quarter", "tone_policy")
    columns = ["year", "quarter", "gdp_yoy", "short_rate_level"]
    out = sr.join_quarterly([macro, rate], ["year", "quarter"], columns, {"tone_policy": "gdp_yoy"})
    return r6(out.withColumn("period", period_label()))


@query(
    "period_change",
    f"WITH {QUARTERLY} SELECT year, quarter, round(tone_policy - lag(tone_policy) OVER (ORDER BY year, quarter), 6) + 0e0 AS change FROM quarterly",
)
def period_change(spark, sf):
    rows = quarterly(spark, sf).select("year", "quarter", "tone_policy")
    return r6(sr.period_change(rows, "tone_policy", "change").drop("tone_policy"))


@query(
    "validated_join",
    """SELECT o_orderkey, o_custkey, c.lines FROM orders o
JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) c ON c.l_orderkey = o.o_orderkey""",
)
def validated_join(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines")
    )
    return sr.validated_join(orders, lines, ["o_orderkey"])


@query(
    "lag_columns",
    f"""WITH {LEVELS}, w AS (SELECT series, date, round(value, 2) AS v FROM levels),
l AS (SELECT *, lag(v, 1) OVER s AS v_l1, lag(v, 2) OVER s AS v_l2 FROM w WINDOW s AS (PARTITION BY series ORDER BY date))
SELECT * FROM l WHERE v_l1 IS NOT NULL AND v_l2 IS NOT NULL""",
)
def lag_columns(spark, sf):
    rows = levels(spark, sf).select("series", "date", F.round("value", 2).alias("v"))
    return sr.add_lags(rows, ["v"], [1, 2], "date", ["series"], drop_missing=True)


_H = tuple(range(11))


@query(
    "forward_cumulative",
    f"""WITH {GAPPY}, v AS (SELECT series, date, CASE WHEN year(date) % 2 = 0 THEN value ELSE coalesce(value, 1e5) END / 3141593e0 AS v FROM gappy)
SELECT series, date, {', '.join(f'CASE WHEN count(v) OVER w{h} = {h + 1} THEN round(sum(v) OVER w{h}, 6) END AS cum_{h}' for h in _H)}
FROM v WINDOW {', '.join(f'w{h} AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)' for h in _H)}""",
)
def forward_cumulative(spark, sf):
    even = F.year("date") % 2 == 0
    v = F.when(even, F.col("value")).otherwise(F.coalesce("value", F.lit(1e5))) / 3141593.0
    rows = gappy(spark, sf).select("series", "date", v.alias("v"))
    return r6(sr.forward_cumulative(rows, "v", _H, by=["series"]).drop("v"))
