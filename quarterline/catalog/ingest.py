"""Sources, coercion and periods."""

import uuid

from pyspark.sql import functions as F

from quarterline.catalog.base import SP, query, r6, table
from quarterline.functions import coerce as co
from quarterline.profiles import CONTROL_KEYWORDS
from quarterline.session import ensure_checkpoint_dir
from quarterline.sources.columns import require_columns, resolve_columns
from quarterline.sources.files import allow_charset, distinct_words, scan_csv


@query(
    "scan_csv_typed",
    "SELECT o_orderkey, o_totalprice, concat('优先级', o_orderpriority) AS label FROM orders",
)
def scan_csv_typed(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/orders_csv_{uuid.uuid4().hex}"
    label = F.concat(F.lit("优先级"), "o_orderpriority").alias("label")
    allow_charset(spark, "GBK")
    (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_totalprice", label)
        .write.option("header", True)
        .option("encoding", "GBK")
        .csv(path)
    )
    schema = "o_orderkey bigint, o_totalprice double, label string"
    return scan_csv(spark, path, schema, encoding="GBK")


@query(
    "stopword_table",
    rf"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents),
w AS (SELECT regexp_replace(l, '^{SP}+|{SP}+$', '', 'g') AS word FROM lines)
SELECT DISTINCT word FROM w WHERE word <> ''""",
)
def stopword_table(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return distinct_words(lines, "value")


@query(
    "resolve_columns",
    """
SELECT CAST(l_shipdate AS DATE) AS date, l_discount AS shibor_1w, l_extendedprice AS usdcny_mid,
       l_tax AS ib_7d, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
       l_orderkey, l_linenumber
FROM lineitem""",
)
def resolve_columns_query(spark, sf):
    d = F.to_date("l_shipdate")
    raw = table(spark, sf, "lineitem").select(
        d.alias("指标名称"),
        F.col("l_discount").alias("SHIBOR:1周"),
        F.col("l_extendedprice").alias("中间价:美元兑人民币"),
        F.col("l_tax").alias("7天回购利率:加权"),
        F.year(d).alias("Year"),
        F.quarter(d).alias("Quarter"),
        "l_orderkey",
        "l_linenumber",
    )
    named = resolve_columns(
        raw, {"Year": "year", "Quarter": "quarter"}, CONTROL_KEYWORDS, date_fallback="date"
    )
    return require_columns(named, ["date", "year", "quarter", *CONTROL_KEYWORDS])


@query(
    "round_all",
    """
SELECT event_id, event_type, round_even(value / 7, 6) AS a, round_even(value / 3 - 20, 6) AS b
FROM events""",
)
def round_all(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", "event_type", (F.col("value") / 7).alias("a"), (F.col("value") / 3 - 20).alias("b")
    )
    return co.round_all(raw)


@query(
    "coerce_numeric",
    "SELECT event_id, CASE WHEN event_id % 6 IN (1, 5) THEN value END AS number FROM events",
)
def coerce_numeric(spark, sf):
    k, v = F.col("event_id") % 6, F.col("value").cast("string")
    dirty = (
        F.when(k == 0, "--")
        .when(k == 1, F.concat(F.lit(" "), v, F.lit("　")))
        .when(k == 2, "NA")
        .when(k == 3, F.col("props"))
        .when(k == 4, "")
        .otherwise(v)
    )
    events = table(spark, sf, "events").withColumn("dirty", dirty)
    return events.dropna(subset=["dirty"]).select("event_id", co.to_number(F.col("dirty")).alias("number"))


@query(
    "coerce_date",
    """
WITH t AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 1 THEN strftime(o_orderdate, '13/%d/%Y') WHEN 2 THEN 'n/a'
    ELSE ' ' || strftime(o_orderdate, '%m/%d/%Y') END AS raw FROM orders)
SELECT o_orderkey, CAST(try_strptime(trim(raw), '%m/%d/%Y') AS DATE) AS day FROM t""",
)
def coerce_date(spark, sf):
    k, text = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "MM/dd/yyyy")
    raw = (
        F.when(k == 0, text)
        .when(k == 1, F.date_format("o_orderdate", "'13/'dd/yyyy"))
        .when(k == 2, "n/a")
        .otherwise(F.concat(F.lit(" "), text))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", co.to_day(raw, "MM/dd/yyyy").alias("day")
    )


@query(
    "drop_metadata_rows",
    """
SELECT event_id, CAST(event_id AS VARCHAR) AS label, value FROM events
WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""",
)
def drop_metadata_rows(spark, sf):
    i = F.col("event_id")
    label = F.when(i % 11 == 0, "单位").when(i % 13 == 0, "数据来源：x").otherwise(i.cast("string"))
    events = table(spark, sf, "events").select("event_id", label.alias("label"), "value")
    return co.drop_metadata_rows(events, "label")


@query(
    "period_from_date",
    """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
       concat(year(l_shipdate), 'Q', quarter(l_shipdate)) AS label, count(*) AS n,
       round(avg(l_discount), 6) AS mean
FROM lineitem
WHERE year(l_shipdate) * 4 + quarter(l_shipdate) BETWEEN 1996 * 4 + 2 AND 2000 * 4 + 3
GROUP BY ALL""",
)
def period_from_date(spark, sf):
    rows = co.with_period(table(spark, sf, "lineitem"), "l_shipdate")
    rows = co.period_slice(rows, (1996, 2), (2000, 3))
    out = rows.groupBy("year", "quarter", co.period_label().alias("label")).agg(
        F.count("*").alias("n"), F.avg("l_discount").alias("mean")
    )
    return r6(out)


@query(
    "period_from_text",
    """
WITH t AS (SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN concat(2001 + doc_id % 24, '第', CASE doc_id % 3 WHEN 0 THEN '一' WHEN 1 THEN '三' ELSE '五' END, '季度.pdf')
    WHEN 1 THEN concat('x_', 2001 + doc_id % 24, 'q', 1 + doc_id % 5, '_', source)
    WHEN 2 THEN concat(source, '.pdf') ELSE concat('Q2 第四季度 19', 10 + doc_id % 80) END AS name
  FROM documents),
p AS (SELECT doc_id, regexp_extract(name, '20[0-9]{2}') AS y, regexp_extract(name, '[Qq]([1-4])', 1) AS q,
             regexp_extract(name, '第([一二三四])季度', 1) AS c FROM t)
SELECT doc_id, TRY_CAST(y AS INTEGER) AS year,
       CAST(coalesce(TRY_CAST(q AS INTEGER), CASE c WHEN '一' THEN 1 WHEN '二' THEN 2 WHEN '三' THEN 3 WHEN '四' THEN 4 END) AS INTEGER) AS quarter
FROM p""",
)
def period_from_text(spark, sf):
    i = F.col("doc_id")
    year = (2001 + i % 24).cast("string")
    numeral = F.when(i % 3 == 0, "一").when(i % 3 == 1, "三").otherwise("五")
    name = (
        F.when(i % 4 == 0, F.concat(year, F.lit("第"), numeral, F.lit("季度.pdf")))
        .when(i % 4 == 1, F.concat(F.lit("x_"), year, F.lit("q"), (1 + i % 5).cast("string"), F.lit("_"), "source"))
        .when(i % 4 == 2, F.concat("source", F.lit(".pdf")))
        .otherwise(F.concat(F.lit("Q2 第四季度 19"), (10 + i % 80).cast("string")))
    )
    named = table(spark, sf, "documents").select("doc_id", name.alias("name"))
    y, q = co.period_from_text(F.col("name"))
    return named.select("doc_id", y.alias("year"), q.alias("quarter"))


@query(
    "unpivot_indicators",
    """
SELECT event_type AS indicator, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value
FROM events WHERE NOT (event_type = 'view' AND day(ts) % 3 = 0) GROUP BY ALL""",
)
def unpivot_indicators(spark, sf):
    kept = F.when(~((F.col("event_type") == "view") & (F.dayofmonth("ts") % 3 == 0)), F.col("value"))
    sheet = (
        table(spark, sf, "events")
        .select(F.col("event_type").alias("indicator"), F.to_date("ts").cast("string").alias("day"), kept.alias("v"))
        .groupBy("indicator")
        .pivot("day")
        .agg(F.avg("v"))
    )
    return r6(co.unpivot_dates(sheet, ["indicator"]))


@query(
    "coalesce_columns",
    """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value WHEN event_id % 4 <> 0 THEN value * 2 END AS forecast
FROM events""",
)
def coalesce_columns(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    events = table(spark, sf, "events").select(
        "event_id", F.when(i % 3 != 0, v).alias("median"), F.when(i % 4 != 0, v * 2).alias("mean")
    )
    out = co.coalesce_present(events, ["consensus", "median", "mean"], "forecast")
    return out.select("event_id", "forecast")
