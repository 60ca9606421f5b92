"""Typed columns from untidy text: numbers, dates, periods."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.profiles import NULL_MARKS, SOURCE_NOTE, SPACE_CHARS, UNIT_ROW

# ---- Fixed values: number format and quarter numerals -------------------------------------------------
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
QUARTER_NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4}


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def no_nan(col: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(col), col)


def to_number(col: Column, null_marks: Sequence[str] = NULL_MARKS) -> Column:
    """Number or NULL; the null marks and anything unreadable become NULL."""
    text = strip(col.cast("string"))
    readable = ~text.isin(*null_marks) & text.rlike(NUMBER)
    return F.when(readable, text).try_cast("double")


def to_day(col: Column, fmt: str | None = None) -> Column:
    """Date or NULL, with an optional explicit format."""
    text = strip(col.cast("string"))
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return F.to_date(parsed)


def drop_metadata_rows(
    df: DataFrame,
    column: str,
    units: Iterable[str] = (UNIT_ROW,),
    note: str = SOURCE_NOTE,
) -> DataFrame:
    """Drop the unit row and rows that carry the source note."""
    c = F.col(column)
    keep = ~F.coalesce(c.isin(*units), F.lit(False)) & ~F.coalesce(c.contains(note), F.lit(False))
    return df.where(keep)


def with_period(df: DataFrame, date: str) -> DataFrame:
    """Add ``year`` and ``quarter`` of a date column."""
    return df.withColumns({"year": F.year(date), "quarter": F.quarter(date)})


def quarter_index(year: str = "year", quarter: str = "quarter") -> Column:
    """Running quarter number; neighbours differ by one."""
    return F.col(year) * 4 + F.col(quarter)


def period_label(year: str = "year", quarter: str = "quarter") -> Column:
    return F.concat(F.col(year).cast("string"), F.lit("Q"), F.col(quarter).cast("string"))


def period_slice(df: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Rows between two (year, quarter) pairs, both included."""
    low, high = first[0] * 4 + first[1], last[0] * 4 + last[1]
    return df.where(quarter_index().between(low, high))


def period_from_text(col: Column) -> tuple[Column, Column]:
    """Year and quarter named in a file name or label; NULL where absent.

    A digit quarter (``Q3``) wins over a written one.
    """

    def group(pattern: str, index: int = 1) -> Column:
        hit = F.regexp_extract(col, pattern, index)
        return F.when(hit != "", hit)

    written = group("第([一二三四])季度")
    spelt = F.coalesce(*[F.when(written == k, F.lit(v)) for k, v in QUARTER_NUMERALS.items()])
    year = group(r"(20\p{Nd}{2})").try_cast("int")
    quarter = F.coalesce(group("[Qq]([1-4])").cast("int"), spelt)
    return year, quarter


def coalesce_present(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """First non-null among the listed columns that exist; error when none exists."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of {list(columns)} is present")
    return df.withColumn(out, F.coalesce(*present))


def unpivot_dates(
    df: DataFrame, ids: Sequence[str], fmt: str = "yyyy-MM-dd", keep_null: bool = False
) -> DataFrame:
    """Wide sheet (one column per date) to long rows ``ids, date, value``."""
    wide = [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), wide, "date", "value").withColumn("date", to_day(F.col("date"), fmt))
    long = long.where("date IS NOT NULL")
    return long if keep_null else long.where("value IS NOT NULL")


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column half-even."""
    floating = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.bround(n, digits) for n in floating})
