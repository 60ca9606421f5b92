"""Isotonic calibration of classifier scores by pool-adjacent-violators.

Held-out scores are counted in bins of equal width, a mergeable summary whose size is a parameter.
Neighbouring bins are pooled until the share of positives rises from block to block; the blocks
travel as one small array, and scores are looked up in it inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 100


def bin_of(p: Column, bins: int = BINS) -> Column:
    """The number of the score's bin; a score of 1 is in the last one."""
    return F.least(F.lit(bins - 1), F.floor(F.round(p, 9) * bins)).cast("int")


def bin_counts(df: DataFrame, p: str, label: str, bins: int = BINS) -> DataFrame:
    """``bin, n, pos`` of the rows that have a score and a label."""
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def pooled(counts: DataFrame) -> DataFrame:
    """One row with ``blocks``: arrays of ``lo, n, pos`` whose shares rise.

    A bin joins the block before it while that one's share is not smaller; each bin is pushed once,
    and a push pools from the top of the stack down.
    """
    block = "array<struct<lo:int,n:bigint,pos:bigint>>"
    bins = F.array_sort(F.collect_list(F.struct(F.col("bin").alias("lo"), "n", "pos")))
    empty = F.array().cast(block)

    def push(stack: Column, x: Column) -> Column:
        start = F.struct(x.alias("top"), F.lit(False).alias("fits"), empty.alias("below"))

        def pool(s: Column, b: Column) -> Column:
            top = s["top"]
            fits = s["fits"] | (b["pos"] * top["n"] < top["pos"] * b["n"])
            merged = F.struct(b["lo"].alias("lo"), (b["n"] + top["n"]).alias("n"), (b["pos"] + top["pos"]).alias("pos"))
            return F.struct(
                F.when(fits, top).otherwise(merged).alias("top"), fits.alias("fits"),
                F.when(fits, F.concat(F.array(b), s["below"])).otherwise(s["below"]).alias("below"),
            )

        return F.aggregate(F.reverse(stack), start, pool, lambda s: F.concat(s["below"], F.array(s["top"])))

    return counts.agg(bins.alias("b")).select(F.aggregate("b", empty, push).alias("blocks"))


def with_calibrated(df: DataFrame, p: str, blocks: DataFrame, out: str = "calibrated", bins: int = BINS) -> DataFrame:
    """Add the share of positives of the score's block.

    A bin without rows takes the block below it, or the first; without any block the score stays.
    """
    rows = df.withColumn("__blocks", blocks.scalar())
    mine = F.filter("__blocks", lambda b: b["lo"] <= bin_of(F.col(p), bins))
    at = F.coalesce(F.try_element_at(mine, F.lit(-1)), F.try_element_at("__blocks", F.lit(1)))
    share = F.coalesce(at["pos"] / at["n"], F.col(p))
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), share)).drop("__blocks")


def calibration_error(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: the mean distance between score and share of positives over bins."""
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    each = rows.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(label).cast("double"))).alias("gap")
    )
    return each.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
