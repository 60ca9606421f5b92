"""Regressions from cross-products summed on the cluster.

All models of a call are one grouped aggregation: rows become sums of products per model
key (combined on the map side, so a huge model does not load one task), and only k-by-k
matrices are inverted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarterline.functions import linalg
from quarterline.functions.halo import over_chunks
from quarterline.operators.series import add_lags, forward_cumulative, lag_long
from quarterline.session import checkpoint

# ---- Fixed values: normal quantiles of two-sided 90 and 95 percent bands ---------------
BAND_QUANTILES = {90: 1.6448536269514722, 95: 1.959963984540054}
#: Model tables of up to so many rows (they are counted) are sent to the tasks.
BROADCAST_MODELS = 10_000


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without NULL or NaN in the listed columns."""
    return df.dropna(subset=list(columns))


def _symmetric(k: int, cell) -> Column:
    """Row-major array of a symmetric matrix of SQL aggregates; each pair is computed once.

    Written as one SQL text: a dozen regressors make thousands of column calls otherwise.
    """
    cells = ", ".join(f"'c{i}_{j}', {cell(i, j)}" for i in range(k) for j in range(i, k))
    return F.expr(f"named_struct({cells})")


def _mirrored(k: int, column: str) -> Column:
    """The whole row-major array from the struct that ``_symmetric`` makes."""
    return F.array(*[F.col(f"{column}.c{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])


def _sql_names(xs: Sequence[str]) -> list[str]:
    """The regressors as SQL terms, constant first."""
    return ["1D", *[f"cast(`{x}` as double)" for x in xs]]


def fit(
    df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), min_n: int | None = None
) -> DataFrame:
    """One row per model: ``n``, ``tss``, ``means``, ``gram``, ``xty``, ``inv`` and ``beta``.

    The matrices are those of a constant and the centred regressors: centred moments keep their
    digits at any mean, and merge in one pass. ``beta`` has the constant of the design as it was
    first, and NULL for a regressor that is constant or redundant given those before it. Models
    with fewer than ``min_n`` rows have NULL arrays.
    """
    cols, target = _sql_names(xs), f"cast(`{y}` as double)"
    k = len(cols)

    def moment(i: int, j: int) -> str:
        if i == 0:
            return "cast(count(*) as double)" if j == 0 else "0D"
        return f"covar_pop({cols[i]}, {cols[j]}) * count(*)"

    rows = complete_cases(df, [y, *xs])
    xty = [f"avg({target}) * count(*)", *[f"covar_pop({c}, {target}) * count(*)" for c in cols[1:]]]
    means = ", ".join(f"avg({c})" for c in cols[1:]) or "0D"
    moments = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.expr(f"covar_pop({target}, {target}) * count(*)").alias("tss"),
        F.expr(f"array({means})").alias("means"),
        _symmetric(k, moment).alias("gram"),
        F.expr(f"array({', '.join(xty)})").alias("xty"),
    )
    moments = moments.withColumn("gram", _mirrored(k, "gram"))
    usable = F.col("n") >= (min_n if min_n is not None else k)
    solved = moments.withColumn("inv", linalg.inverse(F.when(usable, F.col("gram"))))
    slopes = [
        f"CASE WHEN inv[{i * k + i}] > 0 THEN " + " + ".join(f"inv[{i * k + j}] * xty[{j}]" for j in range(k)) + " END"
        for i in range(1, k)
    ]
    solved = solved.withColumn("b", F.expr(f"array({', '.join(slopes)})") if slopes else F.expr("cast(array() as array<double>)"))
    constant = " - ".join(["xty[0] / n", *[f"coalesce(b[{i}], 0D) * means[{i}]" for i in range(k - 1)]])
    return solved.withColumn(
        "beta", F.expr(f"CASE WHEN inv IS NOT NULL THEN concat(array({constant}), b) END")
    ).drop("b")


def with_model(
    df: DataFrame, model: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (),
    out: str = "resid",
) -> DataFrame:
    """Complete rows with their residual and their model as the struct ``model``.

    Without keys the one model enters as a scalar.
    """
    rows = complete_cases(df, [y, *xs])
    packed = F.struct(*[c for c in model.columns if c not in keys]).alias("model")
    if keys:
        rows = rows.join(_small(model, model.select(*keys, packed)), list(keys))
    else:
        rows = rows.withColumn("model", model.select(packed).scalar())
    fitted = " + ".join(f"coalesce(model.beta[{i}], 0D) * {c}" for i, c in enumerate(_sql_names(xs)))
    resid = F.expr(f"cast(`{y}` as double) - ({fitted})")
    return rows.withColumn(out, F.when(F.col("model.beta").isNotNull(), resid))


def _fixed(model: DataFrame) -> DataFrame:
    """The model table, fixed: it is joined before and after the sums over rows."""
    fixed = checkpoint(model)
    fixed._models = fixed.count()
    return fixed


def _small(model: DataFrame, side: DataFrame) -> DataFrame:
    """``side`` with a broadcast hint if its model table was counted and has at most BROADCAST_MODELS rows."""
    return F.broadcast(side) if getattr(model, "_models", BROADCAST_MODELS + 1) <= BROADCAST_MODELS else side


def _centred(xs: Sequence[str]) -> list[str]:
    """The constant and the centred regressors of rows made by ``with_model``, as SQL terms."""
    names = _sql_names(xs)
    return [names[0], *[f"({c} - model.means[{i}])" for i, c in enumerate(names[1:])]]


def with_residuals(
    df: DataFrame, model: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (),
    out: str = "resid",
) -> DataFrame:
    """Complete rows with their residual."""
    return with_model(df, model, y, xs, keys, out).drop("model")


def _summary(both: DataFrame, xs: Sequence[str], keys: Sequence[str], correct: bool) -> DataFrame:
    """Long table per model and term, from ``n, tss, rss, means, inv, beta`` and ``meat``."""
    k = len(xs) + 1
    free = F.col("n") - F.coalesce(F.size(F.filter("beta", lambda x: x.isNotNull())), F.lit(k))
    free = F.when(F.col("beta").isNotNull(), free).otherwise(F.col("n") - k)
    se = linalg.sandwich_se("inv", "meat", "means")
    factor = F.sqrt(F.col("n") / free) if correct else F.lit(1.0)
    names = F.array(*[F.lit(t) for t in ("const", *xs)])
    absent = F.array_repeat(F.lit(None).cast("double"), k)
    cells = F.arrays_zip(
        names.alias("term"),
        F.coalesce("beta", absent).alias("beta"),
        F.coalesce(F.col("se0"), absent).alias("se0"),
    )
    long = both.withColumn("se0", se).select(
        *keys, "n", free.alias("df"), (1 - F.col("rss") / F.col("tss")).alias("r2"),
        factor.alias("__f"), F.inline(cells),
    )
    long = long.withColumn("se", F.col("se0") * F.col("__f")).withColumn(
        "t", F.col("beta") / F.col("se")
    )
    return long.withColumn("p", linalg.t_pvalue(F.col("t"), F.col("df").cast("double"))).select(
        *keys, "term", "beta", "se", "t", "p", "n", "df", "r2"
    )


def _from_rows(
    resid: DataFrame, model: DataFrame, xs: Sequence[str], keys: Sequence[str], cell
) -> DataFrame:
    """The models with the sums over rows made by ``with_model`` that need residuals.

    Only numbers are summed: a model carried through the sums would have every row sorted first.
    """
    k = len(xs) + 1
    sums = resid.groupBy(*keys).agg(
        F.sum(F.col("resid") * F.col("resid")).alias("rss"),
        _symmetric(k, lambda i, j: f"sum({cell(i, j)})").alias("meat"),
        F.count("*").alias("__rows"),
    )
    sums = sums.withColumn("meat", _mirrored(k, "meat"))
    if keys:
        return sums.drop("__rows").join(_small(model, model), list(keys))
    whole = model.select(F.struct(*model.columns)).scalar()
    return sums.withColumn("model", F.when(F.col("__rows") > 0, whole)).select("rss", "meat", "model.*")


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Coefficients with classical standard errors, t, p and centred R2, in one aggregation."""
    model = fit(df, y, xs, keys)
    explained = " + ".join(["0D", *[f"coalesce(beta[{i}], 0D) * xty[{i}]" for i in range(1, len(xs) + 1)]])
    rank = F.size(F.filter("beta", lambda x: x.isNotNull()))
    both = model.withColumn("rss", F.expr(f"greatest(tss - ({explained}), 0D)"))
    variance = F.col("rss") / F.nullif(F.col("n") - rank, F.lit(0))
    both = both.withColumn("meat", F.transform("gram", lambda g: g * variance))
    return _summary(both, xs, keys, correct=False)


def ols_hc1(
    df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), min_n: int | None = None
) -> DataFrame:
    """Coefficients with heteroskedasticity-robust errors times n/(n-k)."""
    model = _fixed(fit(df, y, xs, keys, min_n))
    resid = with_model(df, model, y, xs, keys)
    cols = _centred(xs)
    both = _from_rows(resid, model, xs, keys, lambda i, j: f"resid * resid * {cols[i]} * {cols[j]}")
    return _summary(both, xs, keys, correct=True)


def newey_west(
    df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str], keys: Sequence[str] = (),
    lags: int = 4, long: bool = False,
) -> DataFrame:
    """Coefficients with Newey-West errors (Bartlett weights, no small-sample factor).

    Each series is in ``order`` with one row per period, so its window is bounded by the
    calendar; ``long`` series of any length are cut into chunks of rows instead.
    """
    model = _fixed(fit(df, y, xs, keys))
    resid = with_model(df, model, y, xs, keys)
    k = len(xs) + 1
    scores = [f"resid * {c}" for c in _centred(xs)]
    resid = resid.withColumn("__v", F.expr(f"array({', '.join(scores)})"))
    # missing leads at the start of a series count as zero
    zeros = F.expr(f"array({', '.join(['0D'] * k)})")

    def lagged(along: WindowSpec) -> dict[str, Column]:
        return {f"__v{ell}": F.coalesce(F.lag("__v", ell).over(along), zeros) for ell in range(1, lags + 1)}

    if long:
        resid = over_chunks(resid.select(*keys, *order, "resid", "__v"), order, lagged, before=lags, by=keys)
    else:
        resid = resid.withColumns(lagged(W.partitionBy(*keys).orderBy(*order)))

    def cell(i: int, j: int) -> str:
        parts = [f"__v[{i}] * __v[{j}]"]
        for ell in range(1, lags + 1):
            weight = repr(1 - ell / (lags + 1)) + "D"
            parts.append(f"{weight} * (__v[{i}] * __v{ell}[{j}] + __v[{j}] * __v{ell}[{i}])")
        return " + ".join(parts)

    return _summary(_from_rows(resid, model, xs, keys, cell), xs, keys, correct=False)


def tone_response(
    tone: DataFrame, macro: DataFrame, measure: str, controls: Sequence[str],
    keys: Sequence[str] = (), lags: int = 4,
) -> DataFrame:
    """Tone on its own lag and macro controls, Newey-West errors."""
    period = ["year", "quarter"]
    lagged = add_lags(tone.select(*keys, *period, measure), [measure], [1], period, keys)
    rows = lagged.join(macro.select(*keys, *period, *controls), [*keys, *period])
    rows = checkpoint(rows)  # a period table that the fit reads several times
    return newey_west(rows, measure, [f"{measure}_l1", *controls], period, keys, lags)


def difference_regression(
    df: DataFrame, measure: str, controls: Sequence[str], levels: Sequence[str] = (),
    keys: Sequence[str] = (), lags: int = 4, resid: str = "comm_shock",
) -> tuple[DataFrame, DataFrame]:
    """Change of tone on its own lagged change, macro controls and optional levels.

    Returns the coefficient table and the rows with the residual as shock column.
    """
    period = ["year", "quarter"]
    along = W.partitionBy(*keys).orderBy(*period)
    d = f"d_{measure}"
    rows = df.withColumn(d, F.col(measure) - F.lag(measure).over(along))
    rows = checkpoint(add_lags(rows, [d], [1], period, keys))
    xs = [f"{d}_l1", *controls, *levels]
    table = newey_west(rows, d, xs, period, keys, lags)
    return table, with_residuals(rows, fit(rows, d, xs, keys), d, xs, keys, resid)


def orthogonalised_shock(
    df: DataFrame, first: str, second: str, controls: Sequence[str], keys: Sequence[str] = (),
    lags: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The residual of the first tone equation (``info_shock``) enters the second equation;
    the second residual is ``policy_shock``."""
    period = ["year", "quarter"]
    rows = checkpoint(add_lags(df, [first, second], [1], period, keys))
    xs1 = [f"{first}_l1", *controls]
    rows = with_residuals(rows, fit(rows, first, xs1, keys), first, xs1, keys, "info_shock")
    rows = checkpoint(rows)
    xs2 = [f"{second}_l1", *controls, "info_shock"]
    table = newey_west(rows, second, xs2, period, keys, lags)
    return table, with_residuals(rows, fit(rows, second, xs2, keys), second, xs2, keys, "policy_shock")


def residual_shocks(
    df: DataFrame, measure: str, macro: Sequence[str], keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Residual of tone on its own lag and lagged macro columns.

    Returns rows with ``shock_raw`` and ``shock_z`` (population sd, mean not removed) and one
    row per model with ``n_used``, ``r2``, ``rho`` (own lag) and ``dw`` (Durbin-Watson).
    """
    period = ["year", "quarter"]
    rows = checkpoint(add_lags(df, [measure, *macro], [1], period, keys))
    xs = [f"{measure}_l1", *[f"{m}_l1" for m in macro]]
    model = fit(rows, measure, xs, keys)
    used = with_model(rows, model, measure, xs, keys, "shock_raw")
    along = W.partitionBy(*keys).orderBy(*period)
    used = used.withColumn("__d", F.col("shock_raw") - F.lag("shock_raw").over(along))
    stats = used.groupBy(*keys).agg(
        F.stddev_pop("shock_raw").alias("sd"),
        F.sum(F.col("shock_raw") * F.col("shock_raw")).alias("rss"),
        F.sum(F.col("__d") * F.col("__d")).alias("dd"),
        F.first("model").alias("m"),
    )
    report = stats.select(
        *keys,
        F.col("m.n").alias("n_used"),
        (1 - F.col("rss") / F.col("m.tss")).alias("r2"),
        F.get("m.beta", 1).alias("rho"),
        (F.col("dd") / F.col("rss")).alias("dw"),
    )
    used = used.drop("model")
    if keys:
        scored = used.join(stats.select(*keys, "sd"), list(keys))
    else:
        scored = used.withColumn("sd", stats.select("sd").scalar())
    return scored.withColumn("shock_z", F.col("shock_raw") / F.col("sd")).drop("__d", "sd"), report


def local_projections(
    panel: DataFrame, series: str, value: str, is_event: str, shocks: Sequence[str],
    controls: Sequence[str], horizons: Sequence[int] = range(11), return_lags: int = 5,
    min_n: int = 30, order: str = "date",
) -> DataFrame:
    """Response of cumulative returns to event shocks: one model per series and horizon.

    ``panel`` is long (series, day). Lags and cumulative sums are windows over a series'
    days; event rows are then repeated per horizon and all models are fitted together.
    """
    lags = list(range(1, return_lags + 1))
    wide = add_lags(panel, [value], lags, order, [series])
    wide = forward_cumulative(wide, value, list(horizons), order, [series])
    lag_names = [f"{value}_l{k}" for k in lags]
    cells = [F.struct(F.lit(h).alias("h"), F.col(f"cum_{h}").alias("y")) for h in horizons]
    rows = wide.where(F.col(is_event) != 0).select(
        series, *shocks, *controls, *lag_names, F.inline(F.array(*cells))
    )
    # a bounded table (event days x horizons) that the fit reads several times
    rows = checkpoint(rows)
    table = ols_hc1(rows, "y", [*shocks, *controls, *lag_names], [series, "h"], min_n)
    names = F.explode(F.array(*[F.lit(s) for s in shocks])).alias("shock")
    grid = rows.select(series, "h").distinct().select(series, "h", names)
    kept = table.select(series, "h", F.col("term").alias("shock"), "beta", "se", "n")
    out = grid.join(kept, [series, "h", "shock"], "left").select(
        series, "h", "shock", "beta", "se", F.coalesce("n", F.lit(0)).alias("nobs")
    )
    return confidence_bands(out)


def confidence_bands(df: DataFrame, quantiles: Mapping[int, float] = BAND_QUANTILES) -> DataFrame:
    """beta +- z * se for each level."""
    new = {}
    for level, z in quantiles.items():
        new[f"lo_{level}"] = F.col("beta") - z * F.col("se")
        new[f"hi_{level}"] = F.col("beta") + z * F.col("se")
    return df.withColumns(new)


def midas_weights(lags: int, theta: tuple[float, float]) -> list[float]:
    """Normalised exponential Almon weights for lags 0..lags-1."""
    raw = [math.exp(theta[0] * j + theta[1] * j * j) for j in range(lags)]
    return [w / sum(raw) for w in raw]


def midas_term(
    quarters: DataFrame, column: str, lags: int = 8, theta: tuple[float, float] = (0.0, 0.0),
    out: str = "midas", by: Sequence[str] = (),
) -> DataFrame:
    """Weighted mean of the current and past quarters in row order, renormalised where the
    series starts. A NULL inside makes the term NULL."""
    along = W.partitionBy(*by).orderBy("year", "quarter")
    df = quarters.withColumn("__o", F.row_number().over(along))
    return df.withColumn(out, _midas(column, midas_weights(lags, theta), along)).drop("__o")


def _midas(column: str, weights: Sequence[float | Column], along) -> Column:
    inside = [F.col("__o") > j for j in range(len(weights))]
    as_col = [w if isinstance(w, Column) else F.lit(w) for w in weights]
    top = sum(
        (F.when(here, w * F.lag(column, j).over(along)).otherwise(0.0)
         for j, (here, w) in list(enumerate(zip(inside, as_col)))[1:]),
        as_col[0] * F.col(column),
    )
    total = sum((F.when(here, w).otherwise(0.0) for here, w in list(zip(inside, as_col))[1:]), as_col[0])
    return top / total


def _centred_gram(names: Sequence[str]) -> Column:
    """Sums of products of the centred columns; they merge in one pass and keep their digits."""
    cols = [f"cast(`{c}` as double)" for c in names]
    return _symmetric(len(cols), lambda i, j: f"covar_pop({cols[i]}, {cols[j]}) * count(*)")


def _midas_terms(
    points: DataFrame, quarters: DataFrame, column: str, lags: int, by: Sequence[str], out: str
) -> DataFrame:
    """The term of every quarter for every point ``theta1, theta2``.

    The quarter table, bounded by the calendar, enters every point's row as one array.
    """
    table = quarters.agg(F.array_sort(F.collect_list(F.struct("year", "quarter", column)))).scalar()
    wide = points.select("*", F.inline(table))
    along = W.partitionBy(*by).orderBy("year", "quarter")
    raw = [F.exp(F.col("theta1") * j + F.col("theta2") * (j * j)) for j in range(lags)]
    return wide.withColumn("__o", F.row_number().over(along)).withColumn(out, _midas(column, raw, along))


def midas_weight_search(
    days: DataFrame, quarters: DataFrame, response: str, column: str,
    grid: Sequence[tuple[float, float]], lags: int = 8, min_days: int = 20,
    by: Sequence[str] = (), rounds: int = 1, step: tuple[float, float] = (0.125, 0.05),
) -> DataFrame:
    """``theta1, theta2, n, ssr`` per series: the weights with the smallest residual sum of
    squares of the squared response on the MIDAS term.

    The first round tries the grid for all series at once; each later round tries five by five
    points around every series' best one, at half the distance of the round before. A round is one
    aggregation. The term is constant within a quarter, so days are summed per quarter first, as
    centred moments; points only multiply quarter rows.
    """
    by = list(by)
    square = F.col(response) * F.col(response)
    per_quarter = days.where(F.col(response).isNotNull()).groupBy(*by, "year", "quarter").agg(
        F.count("*").alias("m"), F.avg(square).alias("ym"), (F.var_pop(square) * F.count("*")).alias("inside")
    )
    per_quarter = checkpoint(per_quarter)  # both are bounded by the calendar and read in every round
    quarters = checkpoint(quarters.select("year", "quarter", column))
    series = per_quarter.select(*by).distinct() if by else None

    def best(points: DataFrame) -> DataFrame:
        terms = _midas_terms(points, quarters, column, lags, [*by, "theta1", "theta2"], "x")
        joined = terms.where("x IS NOT NULL").join(per_quarter, [*by, "year", "quarter"])
        whole = W.partitionBy(*by, "theta1", "theta2")
        mean = lambda c: F.sum(F.col("m") * F.col(c)).over(whole) / F.sum("m").over(whole)
        joined = joined.withColumns({"dx": F.col("x") - mean("x"), "dy": F.col("ym") - mean("ym")})
        s = joined.groupBy(*by, "theta1", "theta2").agg(
            F.sum("m").alias("n"),
            F.sum(F.col("inside") + F.col("m") * F.col("dy") * F.col("dy")).alias("cyy"),
            F.sum(F.col("m") * F.col("dx") * F.col("dx")).alias("cxx"),
            F.sum(F.col("m") * F.col("dx") * F.col("dy")).alias("cxy"),
        )
        explained = F.coalesce(F.col("cxy") * F.col("cxy") / F.nullif("cxx", F.lit(0.0)), F.lit(0.0))
        ranked = s.where(F.col("n") >= min_days).withColumn("ssr", F.col("cyy") - explained)
        point = F.struct("theta1", "theta2", "n", "ssr")
        chosen = ranked.groupBy(*by).agg(F.min_by(point, F.struct("ssr", "theta1", "theta2")).alias("b"))
        return chosen.select(*by, "b.*")

    cells = F.array(*[F.struct(F.lit(float(a)).alias("theta1"), F.lit(float(b)).alias("theta2")) for a, b in grid])
    one = days.sparkSession.range(1) if series is None else series
    found = checkpoint(best(one.select(*by, F.inline(cells))))
    h1, h2 = step
    for _ in range(rounds - 1):
        near = F.array(*[
            F.struct((F.col("theta1") + i * h1).alias("theta1"), (F.col("theta2") + j * h2).alias("theta2"))
            for i in range(-2, 3) for j in range(-2, 3)
        ])
        found = checkpoint(best(found.select(*by, F.inline(near))))
        h1, h2 = h1 / 2, h2 / 2
    return found if by else found.where("ssr IS NOT NULL")


def midas_daily(
    days: DataFrame, quarters: DataFrame, weights: DataFrame, column: str, lags: int = 8,
    by: Sequence[str] = (), out: str = "midas",
) -> DataFrame:
    """Days with the MIDAS term of their quarter, by each series' own weights.

    ``weights`` has ``theta1, theta2`` per series. A day whose quarter is not in the quarter table, or
    whose series has no weights, gets NULL.
    """
    by = list(by)
    terms = _midas_terms(weights.select(*by, "theta1", "theta2"), quarters, column, lags, by, out)
    return days.join(terms.select(*by, "year", "quarter", out), [*by, "year", "quarter"], "left")


def _ranked_orders(
    rows: DataFrame, y: str, columns: Sequence[str], models: Sequence[tuple[tuple[int, ...], Sequence[str]]],
    names: Sequence[str], keys: Sequence[str],
) -> DataFrame:
    """BIC of nested or overlapping models on the same rows, from one Gram matrix of centred columns.

    ``models`` pairs an order with its regressors (a constant is always there).
    """
    cols = [*columns, y]
    k = len(cols)
    at = {c: i for i, c in enumerate(columns)}
    moments = rows.groupBy(*keys).agg(F.count("*").alias("n"), _centred_gram(cols).alias("gram"))
    moments = moments.withColumn("gram", _mirrored(k, "gram"))
    chosen = F.array(*[F.array(*[F.lit(at[c]) for c in xs]).cast("array<int>") for _, xs in models])
    cells = F.arrays_zip(
        linalg.subset_rss("gram", chosen).alias("rss"),
        F.array(*[F.struct(*[F.lit(o).alias(n) for n, o in zip(names, order)], F.lit(len(xs) + 1).alias("k")) for order, xs in models]).alias("o"),
    )
    long = moments.select(*keys, "n", F.inline(cells)).select(*keys, "o.*", "n", "rss")
    bic = F.col("n") * (F.ln(F.col("rss") / F.col("n")) + math.log(2 * math.pi) + 1) + F.ln("n") * F.col("k")
    out = long.withColumn("bic", bic).drop("k")
    best = F.min("bic").over(W.partitionBy(*keys)) == F.col("bic")
    return out.withColumn("best", best.cast("int"))


def ar_order_by_bic(
    df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str] | str,
    keys: Sequence[str] = (), max_order: int = 2,
) -> DataFrame:
    """BIC of AR(0..max) with regressors, on the rows that have all lags, and the best order.

    The Gram matrix of the largest model contains those of the smaller ones, so one
    aggregation serves all orders.
    """
    lag_names = [f"{y}_l{i}" for i in range(1, max_order + 1)]
    rows = add_lags(df, [y], list(range(1, max_order + 1)), order, keys)
    rows = complete_cases(rows, [y, *xs, *lag_names])
    models = [((p,), [*xs, *lag_names[:p]]) for p in range(max_order + 1)]
    return _ranked_orders(rows, y, [*xs, *lag_names], models, ["p"], keys)


# ---- Fixed values: the orders that are compared -------------------------------------------
ARMA_ORDERS = ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (0, 1))


def arma_order_by_bic(
    df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str], keys: Sequence[str] = (),
    orders: Sequence[tuple[int, int]] = ARMA_ORDERS, long_order: int = 8, long: bool = False,
) -> DataFrame:
    """BIC of ARMA(p, q) models with regressors, and the best order, by two linear regressions.

    The residuals of a long autoregression stand in for the innovations (Hannan-Rissanen), so a
    moving-average term is a regressor like any other: one aggregation fits the long model, a second
    one holds all orders. All orders are compared on the rows that have every lag. ``long`` series
    take their lags in chunks of rows.
    """
    lagged = lag_long if long else add_lags
    ps, qs = max((p for p, _ in orders), default=0), max((q for _, q in orders), default=0)
    order = [order] if isinstance(order, str) else list(order)
    own = [f"{y}_l{i}" for i in range(1, max(long_order, ps) + 1)]
    rows = lagged(df, [y], list(range(1, len(own) + 1)), order, keys)
    start = [*xs, *own[:long_order]]
    resid = with_residuals(rows, fit(rows, y, start, keys), y, start, keys, "shock")
    resid = resid.select(*keys, *order, y, *xs, *own[:ps], "shock")
    shocks = [f"shock_l{i}" for i in range(1, qs + 1)]
    if shocks:
        resid = lagged(checkpoint(resid), ["shock"], list(range(1, qs + 1)), order, keys)
    columns = [*xs, *own[:ps], *shocks]
    models = [((p, q), [*xs, *own[:p], *shocks[:q]]) for p, q in orders]
    return _ranked_orders(complete_cases(resid, [y, *columns]), y, columns, models, ["p", "q"], keys)


def regressor_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-zero count, distinct count, sample sd, and whether it is usable.

    Non-finite values count as 0, as they do in ``clean_regressors``.
    """
    parts = []
    for c in columns:
        x = _finite(c)
        parts += [
            F.count_if(x != 0).alias(f"nonzero_{c}"),
            F.count_distinct(x).alias(f"distinct_{c}"),
            F.stddev_samp(x).alias(f"sd_{c}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"nonzero_{c}").alias("nonzero"),
            F.col(f"distinct_{c}").alias("distinct"),
            F.col(f"sd_{c}").alias("sd"),
            F.coalesce(F.col(f"sd_{c}") > 0, F.lit(False)).cast("int").alias("kept"),
        )
        for c in columns
    ]
    return df.agg(*parts).select(F.inline(F.array(*cells)))


def _finite(name: str) -> Column:
    x = F.col(name).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def clean_regressors(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a response; regressors made finite; columns without variance dropped.

    One row of standard deviations decides which columns the plan keeps.
    """
    rows = df.where(F.col(y).isNotNull())
    sds = rows.agg(*[F.stddev_samp(_finite(c)).alias(c) for c in columns]).first()
    flat = [c for c in columns if not sds[c]]
    kept = [c for c in columns if c not in flat]
    return rows.withColumns({c: _finite(c) for c in kept}).drop(*flat)


def event_regression_rows(
    df: DataFrame, y: str, xs: Sequence[str], optional: Sequence[str] = (), scale: float = 100.0
) -> DataFrame:
    """Complete rows of return, regressors and those optional ones that exist; return scaled."""
    cols = [*xs, *[c for c in optional if c in df.columns]]
    rows = complete_cases(df, [y, *cols])
    return rows.select("date", (F.col(y) * scale).alias(y), *cols)
