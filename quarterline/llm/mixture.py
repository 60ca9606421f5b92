"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with target weight w (its share of the mixed corpus, weights are normalised) and n rows
gets the mean repetition rate w * total / n. Every document's number of copies is the inverse of
that Poisson distribution at a uniform number hashed from the seed and the document, so a rerun or
a lost executor draws the same copies. The documents are exploded by their counts (zero drops a
document) and shuffled globally: range-partitioned and sorted by a second hash.

The rate table has a row per source. Only its totals come to the driver; they tell its size, and it
is broadcast if that is small, else joined like any table. Copies of one document spread
over all partitions, so neither a hot source nor a high rate falls into one task.

Cases: a null source is a source of its own; a document without an id is drawn by its text; rows
with equal ids draw equal counts; null weights fall back on ``default_weight``; an empty table gives
an empty result; extra columns pass through, and the added columns take free names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.llm.common import fresh, query, table

SEED = 17
#: The rate table is broadcast if its distributions have at most this many numbers in all (16 MB).
MAX_BROADCAST = 2_000_000
#: 52 bits of a digest make the uniform number.
HEX = 13


def uniform(seed: int, what: str, key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), key).cast("binary")), 1, HEX)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 4 * HEX)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0.. until the rest is below any drawable number.

    Terms are summed in logarithms, so that rates whose e^-rate underflows work too.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        p = acc["p"] + F.exp(log)
        return F.struct(log.alias("log"), p.alias("p"), F.concat(acc["cdf"], F.array(p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["cdf"])


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, default_weight: float = 1.0, alpha: float | None = 0.5) -> DataFrame:
    """``source, n, rate, cdf`` per source.

    With ``weights`` the targets are given by name (others get ``default_weight``); without, a
    source's target is its size to the power ``alpha``, which flattens large sources.
    """
    n = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    if weights:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        w = F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit("\0"))], F.lit(float(default_weight)))
    else:
        w = F.sqrt("n") if alpha == 0.5 else F.pow("n", F.lit(float(alpha)))
    n = n.withColumn("w", w)
    whole = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") / F.col("n")).alias("r"), F.count("*").alias("k")).first()
    all_w, all_n = whole["w"] or 1.0, whole["n"] or 0
    rated = n.withColumn("rate", F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n"))
    rated = rated.where("rate > 0").select("source", "n", "rate", poisson_cdf(F.col("rate")).alias("cdf"))
    rate_sum = (whole["r"] or 0.0) * all_n / all_w
    entries = rate_sum + 12 * math.sqrt(rate_sum * whole["k"]) + 32 * whole["k"]  # of all distributions, at most
    return F.broadcast(rated) if entries <= MAX_BROADCAST else rated


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **targets) -> tuple[DataFrame, dict[str, str]]:
    """The mixed corpus and the names of its added columns.

    Added: ``copy`` (from 1), ``copies`` of the document, ``rate`` of its source, and ``place``, the
    hash whose order is the global shuffle.
    """
    key = F.coalesce(F.col(f"`{ident}`").cast("string"), F.col(f"`{text}`"), F.lit(""))
    s, rate, cdf, copies, copy, place, dropped = fresh(docs, "s", "rate", "cdf", "copies", "copy", "place", "n")
    table_ = rates(docs, source, **targets).withColumnsRenamed({"source": s, "rate": rate, "cdf": cdf, "n": dropped})
    joined = docs.join(table_, F.col(f"`{source}`").eqNullSafe(F.col(s)))
    drawn = uniform(seed, "copies", key)
    counted = joined.withColumn(copies, F.size(F.filter(cdf, lambda p: p <= drawn)).cast("long"))
    out = counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    out = out.withColumn(place, F.substring(F.md5(F.concat(F.lit(f"{seed}:place:"), F.col(copy).cast("string"), F.lit(":"), key).cast("binary")), 1, 16))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, copy, copies, rate, place).orderBy(place), {"copy": copy, "copies": copies, "rate": rate, "place": place}


def mix_sql(docs: str, seed: int = SEED) -> str:
    """DuckDB SQL for ``op3``'s rows over a relation, with targets by square root."""
    u = f"(CAST(('0x' || substr(md5('{seed}:copies:' || k), 1, {HEX})) AS BIGINT) + 0.5) / {float(1 << 4 * HEX)}"
    return f"""
WITH RECURSIVE src AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM {docs} GROUP BY source),
rated AS (SELECT source, n, w / (SELECT sum(w) FROM src) * (SELECT sum(n) FROM src) / n AS rate FROM src),
terms AS (SELECT source, rate, 0 AS i, -rate AS lg, exp(-rate) AS p, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INTEGER) AS last FROM rated
  UNION ALL SELECT source, rate, i + 1, lg + ln(rate) - ln(i + 1), p + exp(lg + ln(rate) - ln(i + 1)), last FROM terms WHERE i < last),
cdf AS (SELECT source, any_value(rate) AS rate, list(p ORDER BY i) AS ps FROM terms GROUP BY source),
keyed AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), text, '') AS k FROM {docs}),
drawn AS (SELECT d.*, c.rate, c.ps, {u} AS u FROM keyed d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT *, CAST(len(list_filter(ps, lambda x: x <= u)) AS BIGINT) AS copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copies, copy, round(rate, 6) AS rate, substr(md5('{seed}:place:' || copy || ':' || k), 1, 16) AS place
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)"""


@query("op3_mixture", mix_sql("documents"))
def op3_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed, names = mix(docs)
    mixed = mixed.withColumnsRenamed({v: k for k, v in names.items()})
    return mixed.withColumn("rate", F.round("rate", 6))
