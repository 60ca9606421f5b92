"""Column checks and renames done while the plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "input") -> DataFrame:
    """Return ``df`` or raise with the list of missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim and lower-case every header, dropping a byte-order mark."""
    return df.toDF(*[c.lstrip("\ufeff").strip().lower() for c in df.columns])


def column_containing(df: DataFrame, keywords: Iterable[str]) -> str | None:
    """First column whose name contains one of the keywords."""
    words = list(keywords)
    return next((c for c in df.columns if any(w in c for w in words)), None)


def first_present(df: DataFrame, candidates: Iterable[str], what: str = "column") -> str:
    """First candidate that exists in ``df``; raises when none does."""
    tried = list(candidates)
    for c in tried:
        if c in df.columns:
            return c
    raise ValueError(f"no {what} among {tried}")


def resolve_columns(
    df: DataFrame,
    aliases: Mapping[str, str] | None = None,
    keywords: Mapping[str, Iterable[str]] | None = None,
    date_fallback: str | None = None,
) -> DataFrame:
    """Rename by exact alias, then by keyword; optionally take the first column as the date.

    An alias is skipped when its target already exists.
    """
    renames = {
        old: new
        for old, new in (aliases or {}).items()
        if old in df.columns and new not in df.columns
    }
    df = df.withColumnsRenamed(renames)
    for target, words in (keywords or {}).items():
        hit = column_containing(df, words)
        if hit is not None and target not in df.columns:
            df = df.withColumnRenamed(hit, target)
    if date_fallback and date_fallback not in df.columns:
        df = df.withColumnRenamed(df.columns[0], date_fallback)
    return df
