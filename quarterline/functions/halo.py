"""Windows over long series: chunks of rows with the neighbours' edge rows beside them.

A window ordered over a whole table is one task. Here rows are range-partitioned and numbered, cut
into chunks of numbers, and the last (or first) rows of a chunk are also given to its neighbour.
A window over a chunk then sees every row it may reach, and results are those of the whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarterline.session import checkpoint

CHUNK = 65_536


def numbered(df: DataFrame, order: Sequence[str], out: str = "__g") -> DataFrame:
    """Number the rows from 0 in order of the whole table.

    The range-partitioned rows are checkpointed, so that a partition keeps its rows when a task is
    run again. Only row counts, one per partition, reach the driver.
    """
    cols = [F.col(c).asc_nulls_first() for c in order]
    placed = checkpoint(df.repartitionByRange(*cols).withColumn("__p", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in placed.groupBy("__p").count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "__p int, __o bigint")
    inside = W.partitionBy("__p").orderBy(*cols)
    return (
        placed.withColumn("__r", F.row_number().over(inside))
        .join(F.broadcast(starts), "__p")
        .withColumn(out, F.col("__o") + F.col("__r") - 1)
        .drop("__p", "__r", "__o")
    )


def over_chunks(
    df: DataFrame, order: Sequence[str], columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0, after: int = 0, by: Sequence[str] = (), chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that reach at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` gets the window of a series (``by``) within a chunk, in row order. ``order`` should be
    unique within a series, as rows that tie are in any order.
    """
    chunk = max(chunk, before, after, 1)
    rows = numbered(df, [*by, *order])
    own, at = F.floor(F.col("__g") / chunk), F.col("__g") % chunk
    copies = F.concat(
        F.array(own),
        F.when(at >= chunk - before, F.array(own + 1)).otherwise(F.array()),
        F.when(at < after, F.array(own - 1)).otherwise(F.array()),
    )
    spread = rows.select("*", F.explode(copies).alias("__c"))
    along = W.partitionBy("__c", *by).orderBy("__g")
    done = spread.withColumns(columns(along))
    return done.where(F.col("__c") == F.floor(F.col("__g") / chunk)).drop("__c", "__g")
