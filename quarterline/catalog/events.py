"""Event detection, calendar mapping and the daily panel."""

from pyspark.sql import functions as F

from quarterline.catalog.base import (
    CALENDAR, LEVELS, QUARTERLY, RETURNS, SHIPMENTS, calendar, levels, quarterly, query, r6, returns,
    shipments, table,
)
from quarterline.catalog.series import RATES, controls
from quarterline.operators import events as ev
from quarterline.plans import panel as pn


def flags(spark, sf):
    """Days with two announcement flags."""
    daily = shipments(spark, sf).groupBy("event_date").agg(F.count("*").alias("n"))
    return daily.select(
        F.col("event_date").alias("date"),
        (F.col("n") % 2).cast("int").alias("rate_policy"),
        (F.col("n") % 3 == 0).cast("int").alias("slf"),
    )


FLAGS = f"""{SHIPMENTS},
flags AS (SELECT event_date AS date, count(*) % 2 AS rate_policy, CASE WHEN count(*) % 3 = 0 THEN 1 ELSE 0 END AS slf FROM ships GROUP BY ALL),
flagged AS (SELECT 'RateAdj' AS event_type, date FROM flags WHERE rate_policy = 1 UNION ALL SELECT 'SLF', date FROM flags WHERE slf = 1),
steps AS (SELECT *, lag(date) OVER (PARTITION BY event_type ORDER BY date) AS before FROM flagged),
starts AS (SELECT event_type, date FROM steps WHERE before IS NULL OR date - before > 1)"""


def run_starts(spark, sf):
    dated = ev.flagged_dates(flags(spark, sf), {"rate_policy": "RateAdj", "slf": "SLF"})
    return ev.collapse_consecutive_days(dated)


@query("collapse_consecutive_days", f"WITH {FLAGS} SELECT * FROM starts")
def collapse_consecutive_days(spark, sf):
    return run_starts(spark, sf)


def sheet(spark, sf):
    """Daily cells of five indicators for three tools; some cells empty."""
    kind, day = F.col("event_type"), F.to_date("ts")
    daily = table(spark, sf, "events").groupBy(kind, day.alias("date")).agg(F.count("*").alias("n"))
    value = F.when(~((kind.isin("view", "purchase")) & (F.col("n") % 4 == 0)), F.col("n") % 3 * 1.0)
    tool = F.when(kind.isin("click", "view"), "A").when(kind.isin("error", "purchase"), "B").otherwise("C")
    name = F.when(kind == "error", F.concat(kind, F.lit(":公告日期"))).otherwise(kind)
    return daily.select(
        tool.alias("event_type"), name.alias("indicator"), F.ascii(kind).alias("row"), "date",
        value.alias("value"),
    )


SHEET = """
cells AS (SELECT event_type AS kind, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL),
sheet AS (
  SELECT CASE WHEN kind IN ('click', 'view') THEN 'A' WHEN kind IN ('error', 'purchase') THEN 'B' ELSE 'C' END AS event_type,
         CASE WHEN kind = 'error' THEN 'error:公告日期' ELSE kind END AS indicator, ascii(kind) AS "row", date,
         CASE WHEN NOT (kind IN ('view', 'purchase') AND n % 4 = 0) THEN (n % 3) * 1e0 END AS value FROM cells),
moves AS (
  SELECT *, abs(value - lag(value) OVER (PARTITION BY indicator ORDER BY date)) > 1e-12 AS moved FROM sheet WHERE value IS NOT NULL)"""


@query("sparse_row_events", f"WITH {SHEET} SELECT indicator, date FROM sheet WHERE value IS NOT NULL")
def sparse_row_events(spark, sf):
    return ev.sparse_row_events(sheet(spark, sf))


@query("change_points", f"WITH {SHEET} SELECT indicator, date, value FROM moves WHERE moved")
def change_points(spark, sf):
    return ev.change_points(sheet(spark, sf)).select("indicator", "date", "value")


TOOL_EVENTS = f"""{SHEET},
stats AS (SELECT event_type, indicator, count(value) AS c, min("row") AS r FROM sheet GROUP BY ALL),
picks AS (
  SELECT event_type, bool_or(contains(indicator, '公告日期') OR contains(indicator, '公布日期')) AS ann,
         arg_min(indicator, c * 1000 + r) AS sparsest, min(c) AS fewest FROM stats GROUP BY ALL),
tool_events AS (
  SELECT DISTINCT m.event_type, date, CASE WHEN ann THEN 'announcement' WHEN fewest > 28 THEN 'change_points' ELSE 'sparse_row' END AS how
  FROM moves m JOIN picks p ON p.event_type = m.event_type
  WHERE (ann AND (contains(indicator, '公告日期') OR contains(indicator, '公布日期')))
     OR (NOT ann AND indicator = sparsest AND (fewest <= 28 OR moved)))"""


@query("indicator_event_dates", f"WITH {TOOL_EVENTS} SELECT * FROM tool_events")
def indicator_event_dates(spark, sf):
    return ev.indicator_event_dates(sheet(spark, sf), dense=28)


@query(
    "event_union_dummies",
    f"""WITH {FLAGS}, {QUARTERLY}, e AS (SELECT * FROM starts UNION ALL SELECT 'RRR', report_date FROM quarterly)
SELECT date, CAST(max(CASE WHEN event_type = 'RRR' THEN 1 ELSE 0 END) AS INTEGER) AS "D_RRR",
       CAST(max(CASE WHEN event_type = 'RateAdj' THEN 1 ELSE 0 END) AS INTEGER) AS "D_RateAdj",
       CAST(max(CASE WHEN event_type = 'SLF' THEN 1 ELSE 0 END) AS INTEGER) AS "D_SLF", 1 AS "D_policy" FROM e GROUP BY date""",
)
def event_union_dummies(spark, sf):
    extra = quarterly(spark, sf).select(
        F.lit("RRR").alias("event_type"), F.col("report_date").alias("date")
    )
    return ev.event_union_dummies(
        run_starts(spark, sf).unionByName(extra), ["RRR", "RateAdj", "SLF"], "D_policy"
    )


# ---- calendar mapping -----------------------------------------------------------------
def line_events(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("event_date")
    )


MAPS = f"""{CALENDAR},
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS event_date FROM lineitem),
maps AS (
  SELECT event_date, (SELECT min(date) FROM cal WHERE date > event_date) AS strict,
         coalesce((SELECT min(date) FROM cal WHERE date >= event_date), (SELECT max(date) FROM cal)) AS on_or_after FROM days)"""


@query(
    "asof_on_or_after",
    f"WITH {MAPS} SELECT l_orderkey, l_linenumber, l_partkey, event_date, on_or_after AS date_used FROM lineitem JOIN maps ON event_date = CAST(l_shipdate AS DATE)",
)
def asof_on_or_after(spark, sf):
    return ev.map_on_or_after(line_events(spark, sf), calendar(spark, sf))


@query(
    "asof_strict_next",
    f"WITH {MAPS} SELECT l_orderkey, l_linenumber, l_partkey, event_date, strict AS date_mapped FROM lineitem JOIN maps ON event_date = CAST(l_shipdate AS DATE)",
)
def asof_strict_next(spark, sf):
    return ev.map_strict_next(line_events(spark, sf), calendar(spark, sf))


@query(
    "centered_change",
    f"""WITH {LEVELS}, s AS (SELECT series, date, value / 31415.93e0 AS value FROM levels),
steps AS (SELECT series, date, lead(value) OVER w - lag(value) OVER w AS step FROM s WINDOW w AS (PARTITION BY series ORDER BY date)),
d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS event_date FROM lineitem),
m AS (SELECT event_date, n.series, coalesce((SELECT min(date) FROM s WHERE s.series = n.series AND date >= event_date), (SELECT max(date) FROM s WHERE s.series = n.series)) AS date_used
  FROM d, (SELECT DISTINCT series FROM s) n)
SELECT l_orderkey, l_linenumber, m.series, m.event_date, date_used, round(coalesce(step, 0), 6) + 0e0 AS "S_policy", CASE WHEN step IS NULL THEN 0 ELSE 1 END AS "S_policy_available"
FROM lineitem JOIN m ON m.event_date = CAST(l_shipdate AS DATE) JOIN steps ON date = date_used AND steps.series = m.series""",
)
def centered_change(spark, sf):
    """Every line item against each of the three daily series."""
    rows = levels(spark, sf).select("series", "date", (F.col("value") / 31415.93).alias("value"))
    events = line_events(spark, sf).select("l_orderkey", "l_linenumber", "event_date")
    each = [
        ev.centered_change(events, rows.where(F.col("series") == s).select("date", "value")).withColumn("series", F.lit(s))
        for s in ("F", "O", "P")
    ]
    return r6(each[0].unionByName(each[1]).unionByName(each[2]))


@query(
    "forecast_surprise",
    """WITH t AS (SELECT event_id, value AS actual, CASE WHEN event_id % 3 <> 0 THEN user_id / 2 END AS median,
  CASE WHEN event_id % 4 <> 0 THEN user_id / 3 END AS mean FROM events)
SELECT event_id, round(coalesce(median, mean), 6) AS forecast, CASE WHEN coalesce(median, mean) IS NULL THEN 0 ELSE 1 END AS forecast_available,
       round(CASE WHEN coalesce(median, mean) IS NULL THEN 0 ELSE actual - coalesce(median, mean) END, 6) + 0e0 AS "S_gdp", 1 AS "D_gdp" FROM t""",
)
def forecast_surprise(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("actual"),
        F.when(i % 3 != 0, u / 2).alias("median"), F.when(i % 4 != 0, u / 3).alias("mean"),
    )
    return r6(ev.forecast_surprise(rows).drop("actual", "median", "mean"))


@query(
    "dedup_keep_last",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def dedup_keep_last(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return ev.dedup_keep_last(rows, ["o_custkey"], ["day", "o_orderkey"])


MAPPED = f"""{MAPS}, {SHIPMENTS},
inside AS (SELECT s.*, strict FROM ships s JOIN maps m ON m.event_date = s.event_date
  WHERE s.event_date BETWEEN (SELECT min(date) FROM cal) AND (SELECT max(date) FROM cal) AND strict IS NOT NULL)"""


def mapped_ships(spark, sf):
    cal = calendar(spark, sf)
    return ev.map_strict_next(ev.within_sample(shipments(spark, sf), cal, "event_date"), cal)


@query(
    "mapped_event_agg",
    f"WITH {MAPPED} SELECT strict AS date, round(sum(shock), 6) + 0e0 AS shock, CAST(max(dummy) AS INTEGER) AS dummy FROM inside GROUP BY strict",
)
def mapped_event_agg(spark, sf):
    return r6(ev.aggregate_mapped(mapped_ships(spark, sf), sums=["shock"], maxes=["dummy"]))


@query(
    "mapped_event_mean",
    f"WITH {MAPPED} SELECT strict AS date, round(avg(shock), 6) + 0e0 AS shock FROM inside GROUP BY strict",
)
def mapped_event_mean(spark, sf):
    return r6(ev.aggregate_mapped(mapped_ships(spark, sf), means=["shock"]))


@query(
    "left_join_default",
    f"""WITH {CALENDAR}, {QUARTERLY},
m AS (SELECT (SELECT min(date) FROM cal WHERE date > report_date) AS date, tone_policy FROM quarterly),
a AS (SELECT date, sum(tone_policy) AS shock FROM m WHERE date IS NOT NULL GROUP BY date)
SELECT c.date, round(coalesce(shock, CASE WHEN month(c.date) = 12 THEN 7 END, 0), 6) + 0e0 AS shock FROM cal c LEFT JOIN a ON a.date = c.date""",
)
def left_join_default(spark, sf):
    cal = calendar(spark, sf).withColumn("shock", F.when(F.month("date") == 12, 7.0))
    reports = quarterly(spark, sf).select("report_date", F.col("tone_policy").alias("shock"))
    mapped = ev.map_strict_next(reports, cal, "report_date")
    return r6(ev.left_join_default(cal, ev.aggregate_mapped(mapped, sums=["shock"]), ["shock"]))


REPORTS = f"""{QUARTERLY},
scored_q AS (
  SELECT year, quarter, tone_policy, tone_macro,
         (similarity_prev - avg(similarity_prev) OVER ()) / stddev_samp(similarity_prev) OVER () AS "Similarity",
         (avg_sent_len - avg(avg_sent_len) OVER ()) / stddev_samp(avg_sent_len) OVER () AS "Readability" FROM quarterly),
attrs AS (
  SELECT q.year, q.quarter, q.report_date, coalesce(s.tone_policy, 0) AS tone_policy, coalesce(s.tone_macro, 0) AS tone_macro,
         coalesce("Similarity", 0) AS "Similarity", coalesce("Readability", 0) AS "Readability"
  FROM quarterly q LEFT JOIN scored_q s ON s.year = q.year AND s.quarter = q.quarter AND NOT (s.year = 1997 AND s.quarter = 2))"""
PLAIN, ZSCORED = ["tone_policy", "tone_macro"], {"similarity_prev": "Similarity", "avg_sent_len": "Readability"}


def report_tables(spark, sf):
    """Report calendar and quarterly attributes; one quarter has no attributes."""
    rows = quarterly(spark, sf)
    return rows.select("year", "quarter", "report_date"), rows


def attributes(spark, sf):
    reports, rows = report_tables(spark, sf)
    out = ev.quarter_attributes(reports, rows, PLAIN, ZSCORED)
    blank = (F.col("year") == 1997) & (F.col("quarter") == 2)
    return out.withColumns({c: F.when(blank, 0.0).otherwise(F.col(c)) for c in [*PLAIN, *ZSCORED.values()]})


_ATTR = ("tone_policy", "tone_macro", '"Similarity"', '"Readability"')


@query(
    "quarter_attrs_to_events",
    f"WITH {REPORTS} SELECT year, quarter, report_date, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in _ATTR)} FROM attrs",
)
def quarter_attrs_to_events(spark, sf):
    return r6(attributes(spark, sf))


SPREAD = f"""{REPORTS}, {CALENDAR},
ord AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM cal),
mapped AS (SELECT *, (SELECT min(date) FROM cal WHERE date > report_date) AS date_mapped FROM attrs),
spread AS (SELECT o.ord + k AS ord, tone_policy, "Readability" FROM mapped JOIN ord o ON o.date = date_mapped, (SELECT unnest([0, 1, 2]) AS k)),
sums AS (SELECT ord, sum(tone_policy / 3) AS tone_policy, sum("Readability" / 3) AS "Readability" FROM spread GROUP BY ord)"""


@query(
    "spread_event_window",
    f"""WITH {SPREAD} SELECT o.date, round(coalesce(tone_policy, 0), 6) + 0e0 AS tone_policy, round(coalesce("Readability", 0), 6) + 0e0 AS "Readability"
FROM ord o LEFT JOIN sums s ON s.ord = o.ord""",
)
def spread_event_window(spark, sf):
    cal = calendar(spark, sf)
    mapped = ev.map_strict_next(attributes(spark, sf), cal, "report_date")
    return r6(ev.spread_event_window(cal, mapped, ["tone_policy", "Readability"], 2, "equal"))


# ---- the panel --------------------------------------------------------------------------
def panel(spark, sf, window=1):
    ships = shipments(spark, sf)

    def family(flag, shock, dummy):
        rows = ships.where(F.col("flag") == flag)
        return rows.select("event_date", F.col("shock").alias(shock), F.col("dummy").alias(dummy))

    reports, rows = report_tables(spark, sf)
    families = {
        ("S_gdp", "D_gdp"): family("R", "S_gdp", "D_gdp"),
        ("S_policy", "D_policy"): family("A", "S_policy", "D_policy"),
        ("S_other", "D_other"): family("N", "S_other", "D_other"),
    }
    return pn.daily_panel(
        returns(spark, sf), reports, rows, PLAIN, ZSCORED, families, controls(spark, sf), window
    )


def _family_sql(flag, shock, dummy, name):
    return f"""{name} AS (
  SELECT (SELECT min(date) FROM returns WHERE date > event_date) AS date, sum(shock) AS "{shock}", max(dummy) AS "{dummy}"
  FROM (SELECT event_date, sum(shock) AS shock, max(dummy) AS dummy FROM ships WHERE flag = '{flag}'
        AND event_date BETWEEN (SELECT min(date) FROM returns) AND (SELECT max(date) FROM returns) GROUP BY event_date)
  GROUP BY 1)"""


PANEL = f"""{RETURNS}, {RATES}, {SHIPMENTS}, {QUARTERLY},
{_family_sql('R', 'S_gdp', 'D_gdp', 'fam_r')}, {_family_sql('A', 'S_policy', 'D_policy', 'fam_a')},
{_family_sql('N', 'S_other', 'D_other', 'fam_n')},
scored_q AS (
  SELECT year, quarter, report_date, tone_policy, tone_macro,
         coalesce((similarity_prev - avg(similarity_prev) OVER ()) / stddev_samp(similarity_prev) OVER (), 0) AS "Similarity",
         coalesce((avg_sent_len - avg(avg_sent_len) OVER ()) / stddev_samp(avg_sent_len) OVER (), 0) AS "Readability" FROM quarterly),
ord AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM returns),
placed AS (
  SELECT o.ord + k AS ord, q.* FROM (SELECT *, (SELECT min(date) FROM returns WHERE date > report_date) AS m FROM scored_q
    WHERE report_date BETWEEN (SELECT min(date) FROM returns) AND (SELECT max(date) FROM returns)) q
  JOIN ord o ON o.date = m, (SELECT unnest([0, 1]) AS k)),
sums AS (SELECT ord, sum(0.5e0) AS "D_report", sum("Similarity" / 2) AS "Similarity", sum("Readability" / 2) AS "Readability",
  sum(tone_policy / 2) AS tone_policy, sum(tone_macro / 2) AS tone_macro FROM placed GROUP BY ord),
panel AS (
  SELECT r.date, r."F", r."O", r."P", coalesce("S_gdp", 0e0) AS "S_gdp", coalesce("D_gdp", 0) AS "D_gdp",
         coalesce("S_policy", 0e0) AS "S_policy", coalesce("D_policy", 0) AS "D_policy",
         coalesce("S_other", 0e0) AS "S_other", coalesce("D_other", 0) AS "D_other", coalesce("D_report", 0e0) AS "D_report",
         coalesce("Similarity", 0e0) AS "Similarity", coalesce("Readability", 0e0) AS "Readability",
         coalesce(tone_policy, 0e0) AS tone_policy, coalesce(tone_macro, 0e0) AS tone_macro,
         usdcny_mid, usdcny_chg, fx_ret, shibor_1w, ib_7d, short_rate, short_rate_chg, ib_minus_shibor
  FROM returns r LEFT JOIN controls c ON c.date = r.date LEFT JOIN fam_r ON fam_r.date = r.date LEFT JOIN fam_a ON fam_a.date = r.date LEFT JOIN fam_n ON fam_n.date = r.date
  JOIN ord o ON o.date = r.date LEFT JOIN sums s ON s.ord = o.ord)"""
_PANEL = (
    '"F"', '"O"', '"P"', '"S_gdp"', '"D_gdp"', '"S_policy"', '"D_policy"', '"S_other"', '"D_other"', '"D_report"', '"Similarity"', '"Readability"',
    "tone_policy", "tone_macro", "usdcny_mid", "usdcny_chg", "fx_ret", "shibor_1w", "ib_7d", "short_rate", "short_rate_chg",
    "ib_minus_shibor",
)


@query("daily_panel", f"WITH {PANEL} SELECT date, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}' for c in _PANEL)} FROM panel")
def daily_panel(spark, sf):
    return r6(panel(spark, sf))


@query(
    "panel_checks",
    f"""WITH {PANEL} SELECT count(*) FILTER (WHERE "D_report" <> 0) AS "nonzero_D_report", count(*) FILTER (WHERE tone_policy <> 0) AS nonzero_tone_policy,
  round(stddev_samp("Similarity"), 6) AS "sd_Similarity", round(stddev_samp("Readability"), 6) AS "sd_Readability" FROM panel""",
)
def panel_checks(spark, sf):
    return r6(pn.panel_checks(panel(spark, sf), ["D_report", "tone_policy"], ["Similarity", "Readability"]))


@query(
    "report_event_columns",
    f"""WITH {RETURNS}, {QUARTERLY},
m AS (SELECT (SELECT min(date) FROM returns WHERE date > report_date) AS date, avg(tone_policy) AS tone, avg(avg_sent_len) AS read
  FROM quarterly WHERE report_date >= (SELECT min(date) FROM returns) GROUP BY 1)
SELECT r.date, round(coalesce(tone, 0), 6) + 0e0 AS "ToneEvent", round(coalesce(tone, 0), 6) + 0e0 AS "ToneGuidEvent",
       round(coalesce(read, 0), 6) + 0e0 AS "ReadabilityEvent", 0e0 AS "PolicySurpriseEvent" FROM returns r LEFT JOIN m ON m.date = r.date""",
)
def report_event_columns(spark, sf):
    reports, rows = report_tables(spark, sf)
    tone = rows.withColumnRenamed("tone_policy", "tone_guid_z").drop("report_date")
    names = {
        "tone_z": "ToneEvent", "tone_guid_z": "ToneGuidEvent", "avg_sent_len": "ReadabilityEvent",
        "surprise_prev": "PolicySurpriseEvent",
    }
    days = returns(spark, sf).select("date")
    return r6(pn.report_event_columns(days, tone, reports, names))
