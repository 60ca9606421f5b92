"""Shared inputs of the catalogue: the driver tables shaped like the data the operators expect.

Each input exists twice, as a DataFrame and as SQL text for the comparison run. Every input
uses all rows of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.functions.text import add_once
from quarterline.functions.tokens import latin_tokens

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+$"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL when there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, dealt by the first one over the session's shuffle partitions.

    A file with one row group is one task of the scan, whatever its size; the text rules after it
    cost far more than moving the narrow rows once.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, name).select(*columns).repartition(parts, columns[0])


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Round double columns (all of them by default) to six digits."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 6) for c in names})


# ---- periods of documents: 96 quarters with one quarter missing ------------------------
def document_period(doc_id: str = "doc_id") -> dict[str, Column]:
    slot = F.col(doc_id) % 96
    slot = slot + F.when(slot >= 40, 1).otherwise(0)
    return {
        "year": (2001 + F.floor(slot / 4)).cast("int"),
        "quarter": (slot % 4 + 1).cast("int"),
    }


DOC_PERIOD = """
  CAST(2001 + ((doc_id % 96) + CASE WHEN doc_id % 96 >= 40 THEN 1 ELSE 0 END) // 4 AS INTEGER) AS year,
  CAST(((doc_id % 96) + CASE WHEN doc_id % 96 >= 40 THEN 1 ELSE 0 END) % 4 + 1 AS INTEGER) AS quarter"""


# ---- sentences of the documents ------------------------------------------------------
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """``id, doc_id, report_id, lang, sent_no, text, year, quarter`` of all documents."""
    docs = texts(spark, sf, "documents", "doc_id", "source", "lang", "text")
    parts = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    rows = docs.select(
        "doc_id", F.col("source").alias("report_id"), "lang",
        F.posexplode(parts).alias("sent_no", "raw"),
    )
    text = F.trim(F.regexp_replace("raw", r"[ \t\n\f\r]+", " "))
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("sent_no")).alias("id"),
        "doc_id", "report_id", "lang", "sent_no", text.alias("text"),
    ).withColumns(document_period())


SENTENCES = rf"""
raw_sents AS (
  SELECT doc_id, source AS report_id, lang,
         unnest(regexp_extract_all(text, '{SENTENCE}')) AS raw,
         generate_subscripts(regexp_extract_all(text, '{SENTENCE}'), 1) - 1 AS sent_no
  FROM documents),
sents AS (
  SELECT doc_id * 100000 + sent_no AS id, doc_id, report_id, lang,
         CAST(sent_no AS INTEGER) AS sent_no,
         trim(regexp_replace(raw, '[ \t\n\f\r]+', ' ', 'g')) AS text,{DOC_PERIOD}
  FROM raw_sents)"""


def tokenised(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with their lower-case a-z words."""
    return add_once(sentences(spark, sf), {"tokens": latin_tokens(F.col("text"))})


TOKENISED = (
    SENTENCES
    + """,
toks AS (
  SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM sents),
tok AS (
  SELECT id, doc_id, report_id, year, quarter, len(tokens) AS n_tokens,
         unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos
  FROM toks)"""
)


# ---- scored sentences: one row per event ---------------------------------------------
SECTIONS = {"click": "S1", "view": "S2", "error": "S3", "purchase": "S4", "signup": "S5"}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``id, year, quarter, section, neg_prob`` (some NULL) and two topic scores."""
    ev = table(spark, sf, "events")
    day = F.dayofmonth("ts")
    section = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in SECTIONS.items()])
    prob = F.round(F.col("value") / (F.col("value") + 50.0), 6)
    return ev.select(
        F.col("event_id").alias("id"),
        (2001 + F.floor((day - 1) / 4)).cast("int").alias("year"),
        ((day - 1) % 4 + 1).cast("int").alias("quarter"),
        section.alias("section"),
        F.when(F.col("event_id") % 7 != 0, prob).alias("neg_prob"),
        (F.col("user_id") % 101 / 100.0).alias("score_policy"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 100.0).alias("score_macro"),
    )


SCORED = """
scored AS (
  SELECT event_id AS id,
         CAST(2001 + (day(ts) - 1) // 4 AS INTEGER) AS year,
         CAST((day(ts) - 1) % 4 + 1 AS INTEGER) AS quarter,
         CASE event_type WHEN 'click' THEN 'S1' WHEN 'view' THEN 'S2' WHEN 'error' THEN 'S3'
              WHEN 'purchase' THEN 'S4' WHEN 'signup' THEN 'S5' END AS section,
         CASE WHEN event_id % 7 <> 0 THEN round(value / (value + 50e0), 6) END AS neg_prob,
         (user_id % 101) / 1e2 AS score_policy,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 1e2 AS score_macro
  FROM events),
topped AS (
  SELECT *, CASE WHEN score_policy >= score_macro THEN 'policy' ELSE 'macro' END AS top1_label,
         CASE WHEN score_policy >= score_macro THEN score_policy ELSE score_macro END AS top1_score,
         CASE WHEN score_policy >= score_macro THEN score_macro ELSE score_policy END AS top2_score
  FROM scored),
gapped AS (
  SELECT *, CASE WHEN top1_score - top2_score >= 1e-1 THEN 1e0
                 WHEN top1_score - top2_score <= 0 THEN 0e0
                 ELSE (top1_score - top2_score) / 1e-1 END AS gap_factor
  FROM topped),
weighted AS (
  SELECT *, CASE WHEN top1_label = 'policy' THEN coalesce(top1_score * gap_factor, 0e0) ELSE 0e0 END AS weight_policy_raw,
         CASE WHEN top1_label = 'macro' THEN coalesce(top1_score * gap_factor, 0e0) ELSE 0e0 END AS weight_macro_raw
  FROM gapped)"""


# ---- trading calendar and returns ----------------------------------------------------
def levels(spark: SparkSession, sf: str) -> DataFrame:
    """Long daily levels ``series, date, value``: order value per status."""
    orders = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return (
        orders.groupBy(F.col("o_orderstatus").alias("series"), day.alias("date"))
        .agg(F.sum("o_totalprice").alias("value"))
    )


LEVELS = """
levels AS (
  SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value
  FROM orders GROUP BY ALL)"""


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Wide daily log returns ``date, F, O, P`` on the trading calendar."""
    from quarterline.operators.series import add_changes

    names = ["F", "O", "P"]
    wide = levels(spark, sf).groupBy("date").agg(
        *[F.max(F.when(F.col("series") == s, F.col("value"))).alias(f"lv_{s}") for s in names]
    )
    out = add_changes(wide, log_returns={s: f"lv_{s}" for s in names})
    return out.select("date", *names)


RETURNS = (
    LEVELS
    + """,
wide AS (
  SELECT date, max(value) FILTER (WHERE series = 'F') AS lv_f,
         max(value) FILTER (WHERE series = 'O') AS lv_o,
         max(value) FILTER (WHERE series = 'P') AS lv_p
  FROM levels GROUP BY date),
returns AS (
  SELECT date, ln(lv_f / lag(lv_f) OVER (ORDER BY date)) AS "F",
         ln(lv_o / lag(lv_o) OVER (ORDER BY date)) AS "O",
         ln(lv_p / lag(lv_p) OVER (ORDER BY date)) AS "P"
  FROM wide)"""
)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct weekdays with orders."""
    day = F.to_date("o_orderdate")
    orders = table(spark, sf, "orders").where(F.dayofweek(day).between(2, 6))
    return orders.select(day.alias("date")).distinct()


CALENDAR = """
cal AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) <= 5)"""


# ---- events, reports, quarterly attributes -----------------------------------------
def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """``event_date, flag, shock, dummy``: one event per line item."""
    return table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("event_date"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_discount") - F.col("l_tax")).alias("shock"),
        F.lit(1).alias("dummy"),
    )


SHIPMENTS = """
ships AS (
  SELECT CAST(l_shipdate AS DATE) AS event_date, l_returnflag AS flag,
         l_discount - l_tax AS shock, 1 AS dummy
  FROM lineitem)"""


def quarterly(spark: SparkSession, sf: str) -> DataFrame:
    """One row per quarter of orders: attributes standing in for the text indicators."""
    orders = table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    base = orders.groupBy(F.year(d).alias("year"), F.quarter(d).alias("quarter")).agg(
        (F.avg("o_totalprice") / 100000).alias("tone_policy"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("tone_macro"),
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 100000)).alias("similarity_prev"),
        F.avg(F.col("o_custkey") % 100 / 10.0).alias("avg_sent_len"),
        F.date_add(F.max(d), 12).alias("report_date"),
    )
    return base


QUARTERLY = """
quarterly AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         avg(o_totalprice) / 1e5 AS tone_policy,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS tone_macro,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 1e5 END) AS similarity_prev,
         avg((o_custkey % 100) / 1e1) AS avg_sent_len,
         CAST(max(o_orderdate) AS DATE) + 12 AS report_date
  FROM orders GROUP BY ALL)"""


def macro(spark: SparkSession, sf: str, by_priority: bool = False) -> DataFrame:
    """Quarterly tone and macro columns, for the whole table or per order priority."""
    orders = table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    keys = [F.col("o_orderpriority").alias("entity")] if by_priority else []
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return orders.groupBy(*keys, F.year(d).alias("year"), F.quarter(d).alias("quarter")).agg(
        (F.avg("o_totalprice") / 100000).alias("tone"),
        share(F.col("o_orderstatus") == "F").alias("tone2"),
        share(F.col("o_orderstatus") == "P").alias("gdp"),
        F.avg(F.col("o_custkey") % 10 / 1.0).alias("cpi"),
        F.avg(F.col("o_orderkey") % 7 / 1.0).alias("m2"),
        F.avg(F.dayofmonth(d) / 1.0).alias("rate"),
    )


def macro_sql(by_priority: bool = False) -> str:
    key = "o_orderpriority AS entity, " if by_priority else ""
    return f"""
macro AS (
  SELECT {key}CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         avg(o_totalprice) / 1e5 AS tone,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS tone2,
         avg(CASE WHEN o_orderstatus = 'P' THEN 1e0 ELSE 0e0 END) AS gdp,
         avg((o_custkey % 10) / 1e0) AS cpi,
         avg((o_orderkey % 7) / 1e0) AS m2,
         avg(day(o_orderdate) / 1e0) AS rate
  FROM orders GROUP BY ALL)"""


# ---- SQL counterparts of the text functions (no look-around in that dialect) --------------
SP = r"[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SP = "[^" + SP[1:]
ND = r"\p{Nd}"
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def normal_sql(x: str) -> str:
    """Line clean-up for text without CJK characters."""
    def sub(e, pattern, to, flags="g"):
        return f"regexp_replace({e}, '{pattern}', '{to}', '{flags}')"

    e = strip_sql(x)
    e = sub(e, rf"^(?:[.·•…]|{SP}){{3,}}{SP}*{ND}+{SP}*", "")
    e = strip_sql(sub(e, rf"(\.{{3,}}|…{{2,}}){SP}*{ND}+{SP}*$", ""))
    e = strip_sql(sub(e, rf"(\.{{3,}}|…{{2,}}){SP}*{ND}+{SP}+", " "))
    e = sub(e, r"(\.{3,}|…{2,})", "")
    e = strip_sql(sub(e, rf"(?i)(第{SP}*{ND}+{SP}*页|Page{SP}*{ND}+)", " "))
    e = sub(e, rf"^{ND}{{1,3}}{SP}+([（(])", r"\1")
    return strip_sql(sub(e, rf"{SP}+", " "))


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def lines_sql(x: str) -> str:
    return f"regexp_split_to_array({x}, '{BREAKS}')"
