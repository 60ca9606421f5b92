"""Series of any length: windows in chunks of rows, calendars by series."""

from pyspark.sql import functions as F

from quarterline.catalog import regress_sql as sql
from quarterline.catalog.base import query, r6, table
from quarterline.operators import events as ev
from quarterline.operators import regress as rg
from quarterline.operators import series as sr

#: Line items in time order as one series.
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Small enough that the test tables have many chunks.
CHUNK = 1000
_ALONG = f"OVER (ORDER BY {', '.join(LINE_ORDER)})"


@query(
    "lag_long",
    f"""SELECT {', '.join(LINE_ORDER)}, lag(l_extendedprice, 1) {_ALONG} AS l_extendedprice_l1, lag(l_extendedprice, 5) {_ALONG} AS l_extendedprice_l5
FROM lineitem""",
)
def lag_long(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINE_ORDER, "l_extendedprice")
    return sr.lag_long(rows, ["l_extendedprice"], [1, 5], LINE_ORDER, chunk=CHUNK).drop("l_extendedprice")


@query(
    "cumulative_long",
    f"""SELECT {', '.join(LINE_ORDER)}, l_quantity - lag(l_quantity) OVER w AS d_l_quantity,
  CASE WHEN count(l_quantity) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 THEN sum(l_quantity) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS cum_3
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY {', '.join(LINE_ORDER)})""",
)
def cumulative_long(spark, sf):
    """Changes and forward sums of three series of line items."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", *LINE_ORDER, "l_quantity")
    rows = sr.change_long(rows, ["l_quantity"], LINE_ORDER, ["l_returnflag"], CHUNK)
    out = sr.cumulative_long(rows, "l_quantity", [3], LINE_ORDER, ["l_returnflag"], chunk=CHUNK)
    return out.drop("l_returnflag", "l_quantity")


_XS = ["quantity", "tax"]
LONG = f"""lines AS (SELECT {', '.join(LINE_ORDER)}, l_extendedprice / 1e4 AS price, l_quantity AS quantity, l_tax * 10 AS tax FROM lineitem)"""


@query("newey_west_long", f"WITH {LONG}, {sql.newey_west_sql('a_', 'lines', 'price', _XS, [], LINE_ORDER)} {sql.table_sql('a_', _XS, [])}")
def newey_west_long(spark, sf):
    """Prices of all line items in time order, errors correlated over four neighbours."""
    rows = table(spark, sf, "lineitem").select(
        *LINE_ORDER, (F.col("l_extendedprice") / 10000).alias("price"), F.col("l_quantity").alias("quantity"), (F.col("l_tax") * 10).alias("tax")
    )
    return r6(rg.newey_west(rows, "price", _XS, LINE_ORDER, long=True))


#: Four calendars of order days, three of them with years missing.
_OPEN = "(s = 0 OR (s = 1 AND year(d) NOT IN (1994, 1995, 1996)) OR (s = 2 AND year(d) % 2 = 0) OR (s = 3 AND year(d) = 1997))"
KEYED = f"""cal AS (SELECT DISTINCT s, d FROM (SELECT o_orderkey % 4 AS s, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders) WHERE {_OPEN}),
ev AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 5 AS s, CAST(l_shipdate AS TIMESTAMP) + to_seconds(l_linenumber % 3 * 7919) AS t FROM lineitem)"""


@query(
    "asof_keyed",
    f"""WITH {KEYED}, ends AS (SELECT s, max(d) AS e FROM cal GROUP BY s),
a AS (SELECT ev.*, cal.d AS at_or_after FROM ev ASOF LEFT JOIN cal ON ev.s = cal.s AND ev.t <= cal.d),
b AS (SELECT a.*, cal.d AS after FROM a ASOF LEFT JOIN cal ON a.s = cal.s AND a.t < cal.d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, b.s, coalesce(at_or_after, e) AS at_or_after, after FROM b LEFT JOIN ends ON ends.s = b.s""",
)
def asof_keyed(spark, sf):
    """Line items by time stamp on one of four calendars; a fifth series has none."""
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("s"), F.col("o_orderdate").alias("d"))
    calendar = orders.where(F.expr(_OPEN))
    seconds = F.make_dt_interval(secs=F.col("l_linenumber") % 3 * 7919)
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 5).alias("s"), (F.col("l_shipdate") + seconds).alias("t")
    )
    rows = ev.asof_next(rows, calendar, ["s"], "t", "d", "at_or_after")
    return ev.asof_next(rows, calendar, ["s"], "t", "d", "after", strict=True).drop("t")
