"""Order statistics and running values without a whole group in one task.

A window over a key that holds a third of the table puts that third in one task. The
helpers here cut each key into ordered buckets first: the window runs inside a bucket, and
a summary with one row per bucket carries totals from bucket to bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.session import checkpoint

#: At least so many ranges of values, and at most so many distinct values in one of them.
BUCKETS = 512
BUCKET_ROWS = 50_000
CHUNK = 4096


def with_value_bucket(df: DataFrame, value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Number ordered value ranges that hold about equal row counts.

    The cut points come from one mergeable sketch; one number per range reaches the driver.
    There are ``buckets`` ranges, or more for a table of over ``buckets * BUCKET_ROWS`` rows.
    Any cut points give the same results downstream; they only balance the work.
    """
    if buckets <= 1:
        return df.withColumn(out, F.lit(0))
    n = df.count()
    buckets = max(buckets, -(-n // BUCKET_ROWS))
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, probs, 20 * buckets).alias("cuts")).first()
    cuts = sorted(set(row["cuts"] or []))
    edges = [float("-inf"), *[float(c) for c in cuts if c != float("-inf")], float("inf")]
    if len(edges) < 3:
        return df.withColumn(out, F.lit(0))
    cutter = Bucketizer(splits=edges, inputCol="__value", outputCol="__bucket", handleInvalid="keep")
    df = cutter.transform(df.withColumn("__value", F.col(value).cast("double")))
    return df.withColumn(out, F.col("__bucket").cast("int")).drop("__value", "__bucket")


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS
) -> DataFrame:
    """Distinct values per key with their count ``c``, first rank ``start`` (from 0) and
    the key's row count ``n``.

    Equal values collapse on the map side, before the ranges are cut: a value that most rows
    share is one row of them. The counted values are checkpointed, as cutting reads them too.
    ``buckets=1`` is for groups with a known bound.
    """
    keys = list(keys)
    kept = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    counts = kept.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    counts = with_value_bucket(counts if buckets <= 1 else checkpoint(counts), "value", "b", buckets)
    inside = W.partitionBy(*keys, "b").orderBy("value")
    placed = counts.withColumn("before", F.sum("c").over(inside) - F.col("c"))
    if buckets <= 1:
        whole = W.partitionBy(*keys, "b")
        return placed.select(
            *keys, "value", "c", F.col("before").alias("start"), F.sum("c").over(whole).alias("n")
        )
    totals = counts.groupBy(*keys, "b").agg(F.sum("c").alias("bc"))
    along, all_of = W.partitionBy(*keys).orderBy("b"), W.partitionBy(*keys)
    totals = totals.select(
        *keys,
        "b",
        (F.sum("bc").over(along) - F.col("bc")).alias("offset"),
        F.sum("bc").over(all_of).alias("n"),
    )
    return placed.join(totals, [*keys, "b"]).select(
        *keys, "value", "c", (F.col("before") + F.col("offset")).alias("start"), "n"
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``probs``."""
    keys = list(keys)
    ranked = ranked_values(df, keys, value, buckets)
    parts = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        end = F.col("start") + F.col("c")
        hit = lambda r: F.max(F.when((F.col("start") <= r) & (r < end), F.col("value")))
        frac = F.max(at - low)
        lo, hi = hit(low), hit(high)
        parts.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*parts) if keys else ranked.agg(*parts)


def trimmed_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    trim: float,
    out: str = "trimmed_mean",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Mean after dropping ``floor(trim*n)`` values at each end.

    A trim outside [0, 0.5), or one that would leave nothing, gives the plain mean.
    """
    keys = list(keys)
    ranked = ranked_values(df, keys, value, buckets)
    cut = F.floor(F.lit(float(trim)) * F.col("n")) if 0.0 <= trim < 0.5 else F.lit(0)
    ranked = ranked.withColumn("cut", F.when(2 * cut >= F.col("n"), F.lit(0)).otherwise(cut))
    upto = F.least(F.col("start") + F.col("c"), F.col("n") - F.col("cut"))
    used = F.greatest(F.lit(0), upto - F.greatest("start", "cut"))
    mean = F.sum(F.col("value") * used) / F.sum(used)
    return ranked.groupBy(*keys).agg(mean.alias(out)) if keys else ranked.agg(mean.alias(out))


def _chunk(position: str, chunk: int) -> Column:
    return F.floor(F.col(position) / F.lit(chunk)).cast("long")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    amount: Column,
    out: str,
    order: Sequence[str] = (),
    major: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Inclusive prefix sum in order of ``major``, the integer ``position``, then ``order``."""
    keys, major = list(keys), list(major)
    group = [*keys, *major, "__c"]
    df = df.withColumns({"__c": _chunk(position, chunk), "__a": amount})
    inside = W.partitionBy(*group).orderBy(position, *order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    totals = df.groupBy(*group).agg(F.sum("__a").alias("__t"))
    along = W.partitionBy(*keys).orderBy(*major, "__c")
    totals = totals.select(*group, (F.sum("__t").over(along) - F.col("__t")).alias("__o"))
    return (
        df.withColumn("__in", F.sum("__a").over(inside))
        .join(totals, group)
        .withColumn(out, F.col("__in") + F.col("__o"))
        .drop("__c", "__a", "__in", "__o")
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    out: str,
    order: Sequence[str] = (),
    chunk: int = CHUNK,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null ``value`` up to the row, in order of ``position`` (then ``order``).

    Without the current row it is the last one strictly before.
    """
    keys = list(keys)
    df = df.withColumns({"__c": _chunk(position, chunk), "__v": value})
    end = W.currentRow if include_current else -1
    inside = (
        W.partitionBy(*keys, "__c").orderBy(position, *order).rowsBetween(W.unboundedPreceding, end)
    )
    at = F.struct(*[F.col(c) for c in (position, *order)])
    ends = df.groupBy(*keys, "__c").agg(
        F.max_by(F.col("__v"), F.when(F.col("__v").isNotNull(), at)).alias("__e")
    )
    before = W.partitionBy(*keys).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "__c", F.last("__e", ignorenulls=True).over(before).alias("__p"))
    return (
        df.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
        .join(ends, [*keys, "__c"])
        .withColumn(out, F.coalesce("__in", "__p"))
        .drop("__c", "__v", "__in", "__p")
    )


def hash_ranks(
    df: DataFrame, keys: Sequence[str], ident: str, seed: int, out: str = "rank"
) -> DataFrame:
    """A seeded shuffle: 1-based rank within ``keys`` in order of an MD5 of seed and id.

    The first three hex digits cut each key into 4096 even buckets.
    """
    keys = list(keys)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")).cast("binary"))
    df = df.withColumn("__h", digest).withColumn("__b", F.substring("__h", 1, 3))
    totals = df.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    along = W.partitionBy(*keys).orderBy("__b") if keys else W.orderBy("__b")
    totals = totals.select(*keys, "__b", (F.sum("__n").over(along) - F.col("__n")).alias("__o"))
    inside = W.partitionBy(*keys, "__b").orderBy("__h", ident)
    return (
        df.withColumn("__r", F.row_number().over(inside))
        .join(totals, [*keys, "__b"])
        .withColumn(out, F.col("__r") + F.col("__o"))
        .drop("__h", "__b", "__o", "__r", "__n")
    )


def ordered_offsets(df: DataFrame, order: str, amount: Column, out: str) -> DataFrame:
    """Exclusive prefix sum over the whole table in order of one unique column.

    The range-partitioned rows are checkpointed, so that the partition numbers the sums
    hang on stay the same when a task is run again.
    """
    placed = df.withColumn("__a", amount).repartitionByRange(F.col(order))
    placed = checkpoint(placed.withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy("__p").agg(F.sum("__a").alias("__t"))
    totals = totals.select(
        "__p", (F.sum("__t").over(W.orderBy("__p")) - F.col("__t")).alias("__o")
    )
    inside = W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("__in", F.sum("__a").over(inside) - F.col("__a"))
        .join(totals, "__p")
        .withColumn(out, F.col("__in") + F.col("__o"))
        .drop("__p", "__a", "__in", "__o")
    )
