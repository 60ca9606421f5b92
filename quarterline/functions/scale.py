"""Standardising columns over a table or per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    ddof: int = 1,
    suffix: str = "_z",
) -> DataFrame:
    """Add ``<column>_z``: (x - mean) / sd, and 0.0 for the whole column where sd is 0 or NULL.

    With ``by`` the moments are taken per entity. Moments are one partial aggregate; the
    rows themselves are not shuffled for the table-wide form.
    """
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    parts = []
    for c in columns:
        parts += [F.avg(c).alias(f"__m_{c}"), sd(c).alias(f"__s_{c}")]
    if by:
        stats = df.groupBy(*by).agg(*parts)
        df = df.join(stats, list(by), "left")
        moment = {c: (F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}
    else:
        stats = df.agg(*parts)
        # one subquery holds all moments
        df = df.withColumn("__stats", stats.select(F.struct(*stats.columns)).scalar())
        moment = {c: (F.col(f"__stats.__m_{c}"), F.col(f"__stats.__s_{c}")) for c in columns}
    scored = {}
    for c in columns:
        mean, dev = moment[c]
        usable = dev.isNotNull() & (dev != 0)
        scored[c + suffix] = F.when(usable, (F.col(c) - mean) / dev).otherwise(F.lit(0.0))
    df = df.withColumns(scored)
    return df.drop("__stats", *[f"__m_{c}" for c in columns], *[f"__s_{c}" for c in columns])
