"""SQL texts for the regressions: Gauss-Jordan elimination spelt out as common table expressions."""

from __future__ import annotations


def _keys(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _on(a, b, keys):
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "true"


def fit_sql(p: str, source: str, y: str, xs: list[str], keys: list[str], order: list[str] = ()) -> str:
    """CTEs ``{p}rows`` (complete rows), ``{p}fit`` (n, inverse Gram ``v_i_j``, ``b_i``) and
    ``{p}res`` (rows with residual ``u``)."""
    k = len(xs) + 1
    extra = "".join(f"{o}, " for o in order if o not in keys)
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    cols = ", ".join([f"{y} AS y", "1e0 AS x0", *[f"{x} AS x{i}" for i, x in enumerate(xs, 1)]])
    parts = [f"{p}rows AS (SELECT {_keys(keys)}{extra}{cols} FROM {source} WHERE {not_null})"]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    gram = [
        f"sum(x{i} * x{j}) AS m_{i}_{j}" for i in range(k) for j in range(k)
    ] + [f"{'1e0' if i == j else '0e0'} AS m_{i}_{k + j}" for i in range(k) for j in range(k)]
    gram += [f"sum(x{i} * y) AS m_{i}_{2 * k}" for i in range(k)]
    parts.append(
        f"{p}g AS (SELECT {_keys(keys)}count(*) AS n, var_pop(y) * count(*) AS tss, {', '.join(gram)} FROM {p}rows{group})"
    )
    prev = f"{p}g"
    for s in range(k):
        cells = []
        for i in range(k):
            for c in range(s, 2 * k + 1):
                if i == s:
                    cells.append(f"m_{s}_{c} / m_{s}_{s} AS m_{i}_{c}")
                else:
                    cells.append(f"m_{i}_{c} - m_{i}_{s} * m_{s}_{c} / m_{s}_{s} AS m_{i}_{c}")
        parts.append(f"{p}g{s} AS MATERIALIZED (SELECT {_keys(keys)}n, tss, {', '.join(cells)} FROM {prev})")
        prev = f"{p}g{s}"
    inv = ", ".join(f"m_{i}_{k + j} AS v_{i}_{j}" for i in range(k) for j in range(k))
    beta = ", ".join(f"m_{i}_{2 * k} AS b_{i}" for i in range(k))
    parts.append(f"{p}fit AS (SELECT {_keys(keys)}n, tss, {inv}, {beta} FROM {prev})")
    fitted = " + ".join(f"b_{i} * x{i}" for i in range(k))
    xcols = ", ".join(f"x{i}" for i in range(k))
    parts.append(
        f"{p}res AS (SELECT {_keys(keys, 'r.')}{extra}y, {xcols}, y - ({fitted}) AS u FROM {p}rows r JOIN {p}fit f ON {_on('r', 'f', keys)})"
    )
    return ",\n".join(parts)


def _se_sql(p, k, keys, meat_rows, cells):
    """``{p}se``: rss and s_i, the sandwich variances."""
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    sums = ", ".join(f"sum({cells(i, j)}) AS s_{i}_{j}" for i in range(k) for j in range(k))
    var = ", ".join(
        "(" + " + ".join(f"v_{i}_{a} * s_{a}_{b} * v_{b}_{i}" for a in range(k) for b in range(k)) + f") AS w_{i}"
        for i in range(k)
    )
    return f"""{p}meat AS (SELECT {_keys(keys)}sum(u * u) AS rss, {sums} FROM {meat_rows}{group}),
{p}se AS (SELECT f.*, rss, {var} FROM {p}fit f JOIN {p}meat m ON {_on('f', 'm', keys)})"""


def p_value(t: str, df: str) -> str:
    """Two-sided Student p-value: 2C * integral of cos^(df-1) from atan(|t|/sqrt(df)) to pi/2
    by Simpson's rule, cut where the integrand has vanished."""
    lo = f"atan(abs({t}) / sqrt({df}))"
    step = f"((least(pi() / 2, {lo} + 12 / sqrt({df})) - {lo}) / 400)"
    return (
        f"(SELECT 2 * exp(lgamma(({df} + 1) / 2e0) - lgamma({df} / 2e0)) / sqrt(pi()) * {step} / 3 * "
        f"sum(CASE WHEN g.i IN (0, 400) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({lo} + g.i * {step}), 0), {df} - 1)) "
        f"FROM range(0, 401) g(i))"
    )


def table_sql(p: str, xs: list[str], keys: list[str], factor: str = "1e0", scale: int = 6) -> str:
    """Final select: one row per term."""
    k = len(xs) + 1
    rows = " UNION ALL ".join(
        f"SELECT {_keys(keys)}'{t}' AS term, b_{i} AS beta, sqrt(w_{i}) * {factor} AS se, n, n - {k} AS df, 1 - rss / tss AS r2 FROM {p}se"
        for i, t in enumerate(["const", *xs])
    )
    return f"""SELECT {_keys(keys)}term, round(beta, {scale}) + 0e0 AS beta, round(se, {scale}) AS se, round(beta / se, {scale}) + 0e0 AS t,
  round({p_value('(beta / se)', 'df')}, {scale}) AS p, n, df, round(r2, {scale}) AS r2 FROM ({rows})"""


def ols_sql(p, source, y, xs, keys):
    k = len(xs) + 1
    parts = fit_sql(p, source, y, xs, keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    var = ", ".join(f"v_{i}_{i} * sigma2 AS w_{i}" for i in range(k))
    return f"""{parts},
{p}meat AS (SELECT {_keys(keys)}sum(u * u) AS rss, sum(u * u) / (count(*) - {k}) AS sigma2 FROM {p}res{group}),
{p}se AS (SELECT f.*, rss, {var} FROM {p}fit f JOIN {p}meat m ON {_on('f', 'm', keys)})"""


def hc1_sql(p, source, y, xs, keys):
    k = len(xs) + 1
    cells = lambda i, j: f"u * u * x{i} * x{j}"
    return f"{fit_sql(p, source, y, xs, keys)},\n{_se_sql(p, k, keys, p + 'res', cells)}"


def newey_west_sql(p, source, y, xs, keys, order, lags=4):
    k = len(xs) + 1
    along = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})" if keys else f"OVER (ORDER BY {', '.join(order)})"
    lagged = ", ".join(
        f"lag(u * x{i}, {ell}) {along} AS l_{i}_{ell}" for i in range(k) for ell in range(1, lags + 1)
    )

    def cells(i, j):
        out = f"u * u * x{i} * x{j}"
        for ell in range(1, lags + 1):
            w = repr(1 - ell / (lags + 1)) + "::DOUBLE"
            out += f" + {w} * coalesce(u * x{i} * l_{j}_{ell} + u * x{j} * l_{i}_{ell}, 0)"
        return out

    return (
        f"{fit_sql(p, source, y, xs, keys, order)},\n{p}lag AS (SELECT *, {lagged} FROM {p}res),\n"
        f"{_se_sql(p, k, keys, p + 'lag', cells)}"
    )
