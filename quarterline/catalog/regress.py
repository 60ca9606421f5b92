"""Regressions, dynamic responses and mixed-frequency terms."""

from pyspark.sql import functions as F

from quarterline.catalog import regress_sql as sql
from quarterline.catalog.base import (
    QUARTERLY, RETURNS, levels, macro, macro_sql, quarterly, query, r6, returns,
    table,
)
from quarterline.operators import events as ev
from quarterline.operators import regress as rg
from quarterline.operators.series import add_changes, add_lags

PERIOD = ["year", "quarter"]
MACRO = ["gdp", "cpi", "m2", "rate"]


# ---- rows of line items: one model per return flag ----------------------------------
LINES = """
lines AS (SELECT l_returnflag AS flag, l_extendedprice / 1e4 AS price, l_quantity AS quantity, l_discount * 10 AS discount, l_tax * 10 AS tax FROM lineitem)"""
XS = ["quantity", "discount", "tax"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        (F.col("l_extendedprice") / 10000).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_discount") * 10).alias("discount"),
        (F.col("l_tax") * 10).alias("tax"),
    )


@query("ols", f"WITH {LINES}, {sql.ols_sql('a_', 'lines', 'price', XS, ['flag'])} {sql.table_sql('a_', XS, ['flag'])}")
def ols(spark, sf):
    return r6(rg.ols(lines(spark, sf), "price", XS, ["flag"]))


@query(
    "ols_hc1",
    f"WITH {LINES}, {sql.hc1_sql('a_', 'lines', 'price', XS, ['flag'])} {sql.table_sql('a_', XS, ['flag'], f'sqrt(n / (n - {len(XS) + 1}))')}",
)
def ols_hc1(spark, sf):
    return r6(rg.ols_hc1(lines(spark, sf), "price", XS, ["flag"]))


# ---- quarterly equations: one model per order priority --------------------------------
def _lagged(columns, keys="entity", extra=""):
    part = f"PARTITION BY {keys} " if keys else ""
    lags = ", ".join(f"lag({c}) OVER ({part}ORDER BY year, quarter) AS {c}_l1" for c in columns)
    return f"lagged AS (SELECT *, {lags}{extra} FROM macro)"


NW_XS = ["tone_l1", *MACRO]
NW = f"WITH {macro_sql(True)}, {_lagged(['tone'])}, {sql.newey_west_sql('a_', 'lagged', 'tone', NW_XS, ['entity'], PERIOD)}"


@query("newey_west", f"{NW} {sql.table_sql('a_', NW_XS, ['entity'])}")
def newey_west(spark, sf):
    rows = add_lags(macro(spark, sf, True), ["tone"], [1], PERIOD, ["entity"])
    return r6(rg.newey_west(rows, "tone", NW_XS, PERIOD, ["entity"]))


@query("tone_response", f"{NW} {sql.table_sql('a_', NW_XS, ['entity'])}")
def tone_response(spark, sf):
    rows = macro(spark, sf, True)
    keys = ["entity", *PERIOD]
    return r6(rg.tone_response(rows.select(*keys, "tone"), rows.select(*keys, *MACRO), "tone", MACRO, ["entity"]))


D_XS = ["d_tone_l1", *MACRO, "tone2"]
DIFF = f"""WITH {macro_sql(True)},
d AS (SELECT *, tone - lag(tone) OVER (PARTITION BY entity ORDER BY year, quarter) AS d_tone FROM macro),
lagged AS (SELECT *, lag(d_tone) OVER (PARTITION BY entity ORDER BY year, quarter) AS d_tone_l1 FROM d),
{sql.newey_west_sql('a_', 'lagged', 'd_tone', D_XS, ['entity'], PERIOD)}"""


def _difference(spark, sf):
    return rg.difference_regression(macro(spark, sf, True), "tone", MACRO, ["tone2"], ["entity"])


@query("difference_regression", f"{DIFF} {sql.table_sql('a_', D_XS, ['entity'])}")
def difference_regression(spark, sf):
    return r6(_difference(spark, sf)[0])


@query("difference_regression_shock", f"{DIFF} SELECT entity, year, quarter, round(u, 6) + 0e0 AS comm_shock FROM a_res")
def difference_regression_shock(spark, sf):
    return r6(_difference(spark, sf)[1].select("entity", *PERIOD, "comm_shock"))


O1, O2 = ["tone_l1", *MACRO], ["tone2_l1", *MACRO, "info_shock"]
ORTH = f"""WITH {macro_sql(True)}, {_lagged(['tone', 'tone2'])},
{sql.fit_sql('a_', 'lagged', 'tone', O1, ['entity'], PERIOD)},
second AS (SELECT l.*, a.u AS info_shock FROM lagged l JOIN a_res a ON a.entity = l.entity AND a.year = l.year AND a.quarter = l.quarter),
{sql.newey_west_sql('b_', 'second', 'tone2', O2, ['entity'], PERIOD)}"""


def _orthogonal(spark, sf):
    return rg.orthogonalised_shock(macro(spark, sf, True), "tone", "tone2", MACRO, ["entity"])


@query("orthogonalised_shock", f"{ORTH} {sql.table_sql('b_', O2, ['entity'])}")
def orthogonalised_shock(spark, sf):
    return r6(_orthogonal(spark, sf)[0])


@query(
    "orthogonalised_shock_rows",
    f"""{ORTH} SELECT s.entity, s.year, s.quarter, round(info_shock, 6) + 0e0 AS info_shock, round(u, 6) + 0e0 AS policy_shock
FROM b_res b JOIN second s ON s.entity = b.entity AND s.year = b.year AND s.quarter = b.quarter""",
)
def orthogonalised_shock_rows(spark, sf):
    rows = _orthogonal(spark, sf)[1]
    return r6(rows.select("entity", *PERIOD, "info_shock", "policy_shock"))


R_XS = ["tone_l1", *[f"{m}_l1" for m in MACRO]]
RESIDUAL = f"""WITH {macro_sql(True)}, {_lagged(['tone', *MACRO])},
{sql.fit_sql('a_', 'lagged', 'tone', R_XS, ['entity'], PERIOD)},
du AS (SELECT *, u - lag(u) OVER (PARTITION BY entity ORDER BY year, quarter) AS d FROM a_res),
st AS (SELECT entity, stddev_pop(u) AS sd, sum(u * u) AS rss, sum(d * d) AS dd FROM du GROUP BY entity)"""


def _residual(spark, sf):
    return rg.residual_shocks(macro(spark, sf, True), "tone", MACRO, ["entity"])


@query(
    "residual_shock",
    f"{RESIDUAL} SELECT d.entity, year, quarter, round(u, 6) + 0e0 AS shock_raw, round(u / sd, 6) + 0e0 AS shock_z FROM du d JOIN st ON st.entity = d.entity",
)
def residual_shock(spark, sf):
    return r6(_residual(spark, sf)[0].select("entity", *PERIOD, "shock_raw", "shock_z"))


@query(
    "residual_shock_report",
    f"{RESIDUAL} SELECT f.entity, n AS n_used, round(1 - rss / tss, 6) AS r2, round(b_1, 6) + 0e0 AS rho, round(dd / rss, 6) AS dw FROM a_fit f JOIN st ON st.entity = f.entity",
)
def residual_shock_report(spark, sf):
    return r6(_residual(spark, sf)[1])


# ---- daily panel with weekly event days ---------------------------------------------
def event_days(spark, sf):
    """All days of the level series with daily tone levels, a control and an event flag on Mondays."""
    d = F.to_date("l_shipdate")
    tone = table(spark, sf, "lineitem").groupBy(d.alias("date")).agg(
        (F.avg("l_discount") * 10).alias("tone_policy"),
        (F.avg("l_tax") * 10).alias("tone_macro"),
        (F.avg("l_quantity") / 25).alias("rate"),
    )
    days = levels(spark, sf).select("date").distinct().join(tone, "date", "left")
    days = add_changes(days, {"rate_chg": "rate"})
    return days.withColumn("is_event", (F.dayofweek("date") == 2).cast("int"))


DAYS = f"""{RETURNS},
tone_days AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_discount) * 10 AS tone_policy, avg(l_tax) * 10 AS tone_macro, avg(l_quantity) / 25 AS rate
  FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
cal AS (SELECT DISTINCT date FROM levels),
days AS (
  SELECT c.date, tone_policy, tone_macro, rate - lag(rate) OVER (ORDER BY c.date) AS rate_chg, CASE WHEN isodow(c.date) = 1 THEN 1 ELSE 0 END AS is_event
  FROM cal c LEFT JOIN tone_days t ON t.date = c.date),
ev AS (
  SELECT date, coalesce(tone_policy - lag(tone_policy) OVER (ORDER BY date), 0) AS dp, coalesce(tone_macro - lag(tone_macro) OVER (ORDER BY date), 0) AS dm
  FROM days WHERE is_event <> 0),
evz AS (SELECT date, (dp - avg(dp) OVER ()) / stddev_samp(dp) OVER () AS dp, (dm - avg(dm) OVER ()) / stddev_samp(dm) OVER () AS dm FROM ev),
shocked AS (SELECT d.*, coalesce(dp, 0) AS d_tone_policy, coalesce(dm, 0) AS d_tone_macro FROM days d LEFT JOIN evz e ON e.date = d.date)"""
SHOCKS = {"tone_policy": "d_tone_policy", "tone_macro": "d_tone_macro"}


def shocked_days(spark, sf):
    return ev.event_delta_shock(event_days(spark, sf), SHOCKS, "is_event")


@query(
    "event_delta_shock",
    f"WITH {DAYS} SELECT date, is_event, round(d_tone_policy, 6) + 0e0 AS d_tone_policy, round(d_tone_macro, 6) + 0e0 AS d_tone_macro FROM shocked",
)
def event_delta_shock(spark, sf):
    return r6(shocked_days(spark, sf).select("date", "is_event", *SHOCKS.values()))


_LP_H = tuple(range(11))
_LP_XS = ["d_tone_policy", "d_tone_macro", "rate_chg", *[f"ret_l{i}" for i in range(1, 6)]]


def _lp_sql():
    horizons = " UNION ALL ".join(
        f"SELECT series, {h} AS h, CASE WHEN c{h} = {h + 1} THEN s{h} END AS y, {', '.join(_LP_XS)} FROM wide_lp WHERE is_event <> 0"
        for h in _LP_H
    )
    frames = ", ".join(
        f"w{h} AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)" for h in _LP_H
    )
    sums = ", ".join(f"sum(ret) OVER w{h} AS s{h}, count(ret) OVER w{h} AS c{h}" for h in _LP_H)
    lags = ", ".join(f"lag(ret, {i}) OVER w AS ret_l{i}" for i in range(1, 6))
    return f"""{DAYS},
longr AS (
  SELECT s.*, 'F' AS series, "F" AS ret FROM shocked s JOIN returns r ON r.date = s.date UNION ALL
  SELECT s.*, 'O', "O" FROM shocked s JOIN returns r ON r.date = s.date UNION ALL SELECT s.*, 'P', "P" FROM shocked s JOIN returns r ON r.date = s.date),
wide_lp AS (SELECT *, {sums}, {lags} FROM longr WINDOW {frames}, w AS (PARTITION BY series ORDER BY date)),
lp AS ({horizons}),
{sql.hc1_sql('a_', 'lp', 'y', _LP_XS, ['series', 'h'])},
res AS (
  SELECT series, CAST(h AS INTEGER) AS h, 'd_tone_policy' AS shock, b_1 AS beta, sqrt(w_1) * sqrt(n / (n - {len(_LP_XS) + 1})) AS se, n AS nobs FROM a_se
  UNION ALL
  SELECT series, CAST(h AS INTEGER), 'd_tone_macro', b_2, sqrt(w_2) * sqrt(n / (n - {len(_LP_XS) + 1})), n FROM a_se),
grid AS (SELECT DISTINCT series, CAST(h AS INTEGER) AS h, unnest(['d_tone_policy', 'd_tone_macro']) AS shock FROM lp),
whole AS (SELECT g.*, beta, se, coalesce(nobs, 0) AS nobs FROM grid g LEFT JOIN res r ON r.series = g.series AND r.h = g.h AND r.shock = g.shock)
SELECT series, h, shock, round(CASE WHEN nobs >= 30 THEN beta END, 6) + 0e0 AS beta, round(CASE WHEN nobs >= 30 THEN se END, 6) AS se, nobs,
  {', '.join(f'round(CASE WHEN nobs >= 30 THEN beta - {z}e0 * se END, 6) + 0e0 AS lo_{lv}, round(CASE WHEN nobs >= 30 THEN beta + {z}e0 * se END, 6) + 0e0 AS hi_{lv}' for lv, z in rg.BAND_QUANTILES.items())}
FROM whole"""


def long_returns(spark, sf):
    return returns(spark, sf).unpivot(["date"], ["F", "O", "P"], "series", "ret")


@query("local_projections", f"WITH {_lp_sql()}")
def local_projections(spark, sf):
    panel = long_returns(spark, sf).join(shocked_days(spark, sf), "date")
    return r6(
        rg.local_projections(
            panel, "series", "ret", "is_event", list(SHOCKS.values()), ["rate_chg"], _LP_H
        )
    )


# ---- mixed frequencies and model choice -------------------------------------------------
MIDAS_THETA = (0.1, -0.05)


def _midas_sql(name, theta1, theta2, column, source, extra=""):
    """Quarter terms as a self-join on row positions."""
    w = f"exp({theta1} * (a.o - b.o) + {theta2} * (a.o - b.o) * (a.o - b.o))"
    return f"""{name} AS (
  SELECT a.year, a.quarter{extra}, sum({w} * b.{column}) / sum({w}) AS x, count(*) AS k
  FROM {source} a JOIN {source} b ON a.o - b.o BETWEEN 0 AND 7 GROUP BY ALL)"""


ORDERED = f"{QUARTERLY}, ordered AS (SELECT *, row_number() OVER (ORDER BY year, quarter) AS o FROM quarterly)"


@query("midas_term", f"WITH {ORDERED}, {_midas_sql('t', '0.1e0', '-0.05e0', 'tone_policy', 'ordered')} SELECT year, quarter, round(x, 6) AS midas FROM t")
def midas_term(spark, sf):
    rows = quarterly(spark, sf).select(*PERIOD, "tone_policy")
    return r6(rg.midas_term(rows, "tone_policy", 8, MIDAS_THETA).drop("tone_policy"))


GRID = [(a / 4, -b / 10) for a in range(-2, 3) for b in range(0, 4)]
ROUNDS, STEP = 4, (0.125, 0.05)


def _midas_search_sql():
    """Every round as a comparison of all points on the days themselves."""
    parts = [f"""l AS (SELECT date, 'F' AS series, "F" AS ret FROM returns UNION ALL SELECT date, 'O', "O" FROM returns UNION ALL SELECT date, 'P', "P" FROM returns),
points0 AS (SELECT series, theta1, theta2 FROM (SELECT DISTINCT series FROM l), (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in GRID)}) g(theta1, theta2))"""]
    for r in range(ROUNDS):
        if r:
            h1, h2 = STEP[0] / 2 ** (r - 1), STEP[1] / 2 ** (r - 1)
            parts.append(f"""points{r} AS (SELECT series, theta1 + i * {h1}::DOUBLE AS theta1, theta2 + j * {h2}::DOUBLE AS theta2
  FROM best{r - 1}, range(-2, 3) a(i), range(-2, 3) b(j))""")
        w = "exp(a.theta1 * (a.o - b.o) + a.theta2 * (a.o - b.o) * (a.o - b.o))"
        parts.append(f"""og{r} AS (SELECT year, quarter, tone_policy, o, series, theta1, theta2 FROM ordered, points{r}),
t{r} AS (SELECT a.year, a.quarter, a.series, a.theta1, a.theta2, sum({w} * b.tone_policy) / sum({w}) AS x
  FROM og{r} a JOIN og{r} b ON a.series = b.series AND a.theta1 = b.theta1 AND a.theta2 = b.theta2 AND a.o - b.o BETWEEN 0 AND 7 GROUP BY ALL),
s{r} AS (SELECT l.series, theta1, theta2, count(*) AS n, regr_syy(ret * ret, x) - pow(regr_sxy(ret * ret, x), 2) / regr_sxx(ret * ret, x) AS ssr
  FROM l JOIN t{r} t ON t.series = l.series AND t.year = year(l.date) AND t.quarter = quarter(l.date) WHERE ret IS NOT NULL GROUP BY ALL),
best{r} AS (SELECT * FROM s{r} QUALIFY row_number() OVER (PARTITION BY series ORDER BY ssr, theta1, theta2) = 1)""")
    return f"{ORDERED}, {RETURNS}, {', '.join(parts)}"


MIDAS = _midas_search_sql()


def midas_inputs(spark, sf):
    days = long_returns(spark, sf).withColumns({"year": F.year("date"), "quarter": F.quarter("date")})
    return days, quarterly(spark, sf).select(*PERIOD, "tone_policy")


def midas_best(spark, sf):
    days, quarters = midas_inputs(spark, sf)
    return rg.midas_weight_search(days, quarters, "ret", "tone_policy", GRID, by=["series"], rounds=ROUNDS, step=STEP)


def six_digits(c):
    """Six significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 5)
    return F.round(c / scale, 0) * scale


def six_digits_sql(c):
    return f"round({c} / pow(1e1, floor(log10(abs({c}))) - 5), 0) * pow(1e1, floor(log10(abs({c}))) - 5)"


@query(
    "midas_weight_search",
    f"WITH {MIDAS} SELECT series, theta1, theta2, n, {six_digits_sql('ssr')} AS ssr FROM best{ROUNDS - 1}",
)
def midas_weight_search(spark, sf):
    """The best weights for each of three series, searched in ever finer grids."""
    out = midas_best(spark, sf)
    return out.withColumns({"n": F.col("n").cast("bigint"), "ssr": six_digits(F.col("ssr"))})


@query(
    "midas_daily",
    f"""WITH {MIDAS}
SELECT l.date, l.series, round(l.ret, 6) AS ret, round(t.x, 6) AS midas FROM l LEFT JOIN best{ROUNDS - 1} b ON b.series = l.series
LEFT JOIN t{ROUNDS - 1} t ON t.series = l.series AND t.theta1 = b.theta1 AND t.theta2 = b.theta2 AND t.year = year(l.date) AND t.quarter = quarter(l.date)""",
)
def midas_daily(spark, sf):
    """Every day of three series with the term of its quarter."""
    days, quarters = midas_inputs(spark, sf)
    out = rg.midas_daily(days, quarters, midas_best(spark, sf), "tone_policy", by=["series"])
    return r6(out.select("date", "series", "ret", "midas"))


ARMA_LONG = 8


def _arma_sql():
    """The long autoregression's residuals as regressors; every order fitted on its own."""
    own = [f"l{i}" for i in range(1, ARMA_LONG + 1)]
    lags = ", ".join(f"lag(ret, {i}) OVER (PARTITION BY series ORDER BY l.date) AS l{i}" for i in range(1, ARMA_LONG + 1))
    parts = [f"""tone_days AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_discount) * 10 AS x FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
longr AS (SELECT date, 'F' AS series, "F" AS ret FROM returns UNION ALL SELECT date, 'O', "O" FROM returns UNION ALL SELECT date, 'P', "P" FROM returns),
lagged AS (SELECT l.date, series, ret, x, {lags} FROM longr l LEFT JOIN tone_days t ON t.date = l.date)""",
             sql.fit_sql("z_", "lagged", "ret", ["x", *own], ["series"], ["date"]),
             "second AS (SELECT series, date, y AS ret, x1 AS x, x2 AS l1, x3 AS l2, lag(u) OVER (PARTITION BY series ORDER BY date) AS u1 FROM z_res)",
             "used AS (SELECT * FROM second WHERE u1 IS NOT NULL)"]
    union = []
    for p, q in rg.ARMA_ORDERS:
        xs = ["x", *["l1", "l2"][:p], *["u1"][:q]]
        parts.append(sql.fit_sql(f"m{p}{q}_", "used", "ret", xs, ["series"]))
        union.append(f"SELECT series, {p} AS p, {q} AS q, {len(xs) + 1} AS k, count(*) AS n, sum(u * u) AS rss FROM m{p}{q}_res GROUP BY series")
    return f"""WITH {RETURNS}, {', '.join(parts)},
every AS ({' UNION ALL '.join(union)}),
b AS (SELECT *, n * (ln(rss / n) + ln(2 * pi()) + 1) + ln(n) * k AS bic FROM every)
SELECT series, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, n, round(rss, 6) AS rss, round(bic, 6) AS bic,
       CASE WHEN bic = min(bic) OVER (PARTITION BY series) THEN 1 ELSE 0 END AS best FROM b"""


def toned_returns(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((F.avg("l_discount") * 10).alias("x"))
    return long_returns(spark, sf).join(x, "date", "left")


@query("arma_order_by_bic", _arma_sql())
def arma_order_by_bic(spark, sf):
    return r6(rg.arma_order_by_bic(toned_returns(spark, sf), "ret", ["x"], ["date"], ["series"], long_order=ARMA_LONG))


def _ar_sql():
    """Eliminating the leading regressors of the Gram matrix leaves the residual sum of
    squares in the response's diagonal cell."""
    cols = ["1e0", "x", "l1", "l2", "ret"]
    k = len(cols)
    gram = ", ".join(f"sum({cols[i]} * {cols[j]}) AS m_{i}_{j}" for i in range(k) for j in range(k))
    steps, prev = [], "g"
    for s in range(4):
        cells = ", ".join(
            f"m_{i}_{j} - m_{i}_{s} * m_{s}_{j} / m_{s}_{s} AS m_{i}_{j}"
            for i in range(s + 1, k) for j in range(s + 1, k)
        )
        steps.append(f"e{s} AS (SELECT series, n, {cells} FROM {prev})")
        prev = f"e{s}"
    union = " UNION ALL ".join(
        f"SELECT series, {p} AS p, n, m_4_4 AS rss FROM e{p + 1}" for p in range(3)
    )
    return f"""WITH {RETURNS},
tone_days AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_discount) * 10 AS x FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
longr AS (SELECT date, 'F' AS series, "F" AS ret FROM returns UNION ALL SELECT date, 'O', "O" FROM returns UNION ALL SELECT date, 'P', "P" FROM returns),
lagged AS (SELECT l.*, x, lag(ret, 1) OVER (PARTITION BY series ORDER BY l.date) AS l1, lag(ret, 2) OVER (PARTITION BY series ORDER BY l.date) AS l2
  FROM longr l LEFT JOIN tone_days t ON t.date = l.date),
g AS (SELECT series, count(*) AS n, {gram} FROM lagged WHERE ret IS NOT NULL AND x IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL GROUP BY series),
{', '.join(steps)},
u AS ({union}),
b AS (SELECT *, n * (ln(rss / n) + ln(2 * pi()) + 1) + ln(n) * (p + 2) AS bic FROM u)
SELECT series, CAST(p AS INTEGER) AS p, n, round(rss, 6) AS rss, round(bic, 6) AS bic,
       CASE WHEN bic = min(bic) OVER (PARTITION BY series) THEN 1 ELSE 0 END AS best FROM b"""


@query("ar_order_by_bic", _ar_sql())
def ar_order_by_bic(spark, sf):
    return r6(rg.ar_order_by_bic(toned_returns(spark, sf), "ret", ["x"], "date", ["series"]))


def odd_lines(spark, sf):
    """A response with gaps, one plain regressor, one with NaN, infinity and NULL, and one constant."""
    odd = (
        F.when(F.col("l_orderkey") % 10 == 0, float("nan")).when(F.col("l_orderkey") % 15 == 5, float("inf"))
        .when(F.col("l_orderkey") % 5 != 0, F.col("l_tax"))
    )
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).alias("y"),
        F.col("l_discount").alias("a"), odd.alias("b"), F.lit(3.0).alias("c"),
    )


@query(
    "clean_regressors",
    "SELECT l_quantity AS y, l_discount AS a, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax ELSE 0 END AS b FROM lineitem WHERE l_partkey % 9 <> 0",
)
def clean_regressors(spark, sf):
    """Rows with a response, regressors made finite, the constant one dropped."""
    return rg.clean_regressors(odd_lines(spark, sf), "y", ["a", "b", "c"])


@query(
    "regressor_report",
    """WITH t AS (SELECT l_discount AS a, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax ELSE 0 END AS b, 3e0 AS c FROM lineitem WHERE l_partkey % 9 <> 0)
SELECT 'a' AS "column", count(*) FILTER (WHERE a <> 0) AS nonzero, count(DISTINCT a) AS "distinct", round(stddev_samp(a), 6) AS sd, 1 AS kept FROM t
UNION ALL SELECT 'b', count(*) FILTER (WHERE b <> 0), count(DISTINCT b), round(stddev_samp(b), 6), 1 FROM t
UNION ALL SELECT 'c', count(*) FILTER (WHERE c <> 0), count(DISTINCT c), round(stddev_samp(c), 6), 0 FROM t""",
)
def regressor_report(spark, sf):
    """Report on regressors where the response exists; NaN, infinity and NULL count as 0."""
    return r6(rg.regressor_report(odd_lines(spark, sf).where("y IS NOT NULL"), ["a", "b", "c"]), "sd")


