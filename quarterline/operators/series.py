"""Preparing daily and quarterly series.

Inputs hold at most one row per series and date (or quarter), so a window over one series is
bounded by the calendar. Aggregate finer data to days first, or use the ``_long`` operators, which
take series of any length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarterline.functions.halo import CHUNK, over_chunks
from quarterline.functions.coerce import coalesce_present, to_day, to_number, with_period
from quarterline.profiles import CONTROL_KEYWORDS
from quarterline.sources.columns import resolve_columns


def _along(by: Sequence[str], order: Sequence[str] | str):
    order = [order] if isinstance(order, str) else list(order)
    return W.partitionBy(*by).orderBy(*order)


def forward_fill(
    df: DataFrame, columns: Sequence[str], order: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """Replace NULL by the last value before it in the same series."""
    upto = _along(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def add_changes(
    df: DataFrame,
    diffs: Mapping[str, str] | None = None,
    log_returns: Mapping[str, str] | None = None,
    spreads: Mapping[str, tuple[str, str]] | None = None,
    order: Sequence[str] | str = "date",
    by: Sequence[str] = (),
) -> DataFrame:
    """New columns: x - lag(x), ln(x / lag(x)), and a - b (NULL when a side is missing)."""
    along = _along(by, order)
    new = {}
    for out, c in (diffs or {}).items():
        new[out] = F.col(c) - F.lag(c).over(along)
    for out, c in (log_returns or {}).items():
        ratio = F.col(c) / F.nullif(F.lag(c).over(along), F.lit(0.0))
        new[out] = F.when(ratio > 0, F.ln(ratio))
    for out, (a, b) in (spreads or {}).items():
        both = a in df.columns and b in df.columns
        new[out] = F.col(a) - F.col(b) if both else F.lit(None).cast("double")
    return df.withColumns(new)


def daily_controls(raw: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Exchange rate and short rate controls from a raw sheet with keyword-named columns."""
    df = resolve_columns(raw, keywords=CONTROL_KEYWORDS)
    if "usdcny_mid" not in df.columns:
        raise ValueError("no exchange rate column")
    rates = [c for c in ("shibor_1w", "usdcny_mid", "ib_7d") if c in df.columns]
    df = df.withColumn("date", to_day(F.col(date))).where("date IS NOT NULL")
    df = df.withColumns({c: to_number(F.col(c)) for c in rates})
    df = forward_fill(df, rates, "date", by)
    df = coalesce_present(df, ("shibor_1w", "ib_7d"), "short_rate")
    df = add_changes(
        df,
        diffs={"short_rate_chg": "short_rate", "usdcny_chg": "usdcny_mid"},
        log_returns={"fx_ret": "usdcny_mid"},
        spreads={"ib_minus_shibor": ("ib_7d", "shibor_1w")},
        by=by,
    )
    names = (
        *by, "date", "usdcny_mid", "usdcny_chg", "fx_ret", "shibor_1w", "ib_7d",
        "short_rate", "short_rate_chg", "ib_minus_shibor",
    )
    return df.select(*[c for c in names if c in df.columns])


def quarterly_aggregate(
    df: DataFrame, how: Mapping[str, str], date: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """Per quarter: ``max``, ``mean`` or ``last`` (last non-null in date order) per column."""
    make = {
        "max": F.max,
        "mean": F.avg,
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))),
    }
    parts = [make[kind](c).alias(c) for c, kind in how.items()]
    return with_period(df, date).groupBy(*by, "year", "quarter").agg(*parts)


def daily_to_quarter_mean(
    df: DataFrame, column: str, out: str, first: str, last: str, date: str = "date",
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean of a daily column per quarter, days between two dates included."""
    inside = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return with_period(inside, date).groupBy(*by, "year", "quarter").agg(F.avg(column).alias(out))


def join_quarterly(
    frames: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str],
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inner join of period tables, renamed and put in column order."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(keys))
    return out.withColumnsRenamed(dict(renames or {})).select(*columns)


def period_change(
    df: DataFrame, column: str, out: str, order: Sequence[str] = ("year", "quarter"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Change of a level from one period to the next."""
    return add_changes(df, diffs={out: column}, order=order, by=by)


def unique_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row per key; a repeated key fails the query when it runs."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*rest) if rest else F.lit(None)
    grouped = df.groupBy(*keys).agg(F.first(packed).alias("__row"), F.count("*").alias("__n"))
    stop = F.raise_error(F.lit(f"{name}: repeated key {list(keys)}"))
    checked = grouped.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(stop.cast("boolean")))
    return checked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails on a repeated key on either side."""
    return unique_rows(left, keys, "left").join(unique_rows(right, keys, "right"), list(keys))


def add_lags(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int], order: Sequence[str] | str,
    by: Sequence[str] = (), drop_missing: bool = False,
) -> DataFrame:
    """Add ``<column>_l<k>``; optionally drop rows that miss a lag."""
    along = _along(by, order)
    names = {f"{c}_l{k}": F.lag(c, k).over(along) for c in columns for k in lags}
    out = df.withColumns(names)
    return out.dropna(subset=list(names)) if drop_missing else out


def lag_long(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int], order: Sequence[str],
    by: Sequence[str] = (), chunk: int = CHUNK,
) -> DataFrame:
    """``add_lags`` for series of any length, in chunks of rows."""
    names = lambda along: {f"{c}_l{k}": F.lag(c, k).over(along) for c in columns for k in lags}
    return over_chunks(df, order, names, before=max(lags, default=0), by=by, chunk=chunk)


def change_long(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``d_<column>``, the change from the row before, for series of any length."""
    names = lambda along: {f"d_{c}": F.col(c) - F.lag(c).over(along) for c in columns}
    return over_chunks(df, order, names, before=1, by=by, chunk=chunk)


def cumulative_long(
    df: DataFrame, column: str, horizons: Sequence[int], order: Sequence[str],
    by: Sequence[str] = (), prefix: str = "cum_", chunk: int = CHUNK,
) -> DataFrame:
    """``forward_cumulative`` for series of any length, in chunks of rows."""
    names = lambda along: _ahead(column, horizons, along, prefix)
    return over_chunks(df, order, names, after=max(horizons, default=0), by=by, chunk=chunk)


def _ahead(column: str, horizons: Sequence[int], along: WindowSpec, prefix: str) -> dict[str, Column]:
    new = {}
    for h in horizons:
        ahead = along.rowsBetween(W.currentRow, h)
        full = F.count(column).over(ahead) == h + 1
        new[f"{prefix}{h}"] = F.when(full, F.sum(column).over(ahead))
    return new


def forward_cumulative(
    df: DataFrame, column: str, horizons: Sequence[int], order: str = "date",
    by: Sequence[str] = (), prefix: str = "cum_",
) -> DataFrame:
    """Add the sum of ``column`` from the row to h rows ahead; NULL past the end or where a
    value inside is NULL."""
    return df.withColumns(_ahead(column, horizons, _along(by, order), prefix))
