"""Readability, TF-IDF and period-over-period similarity of a corpus.

A document is a period's text. It stays in long form: counts come from the sentence rows,
and the term table ``(document, term, count)`` replaces a matrix. A term has at most one
row per document, so windows over a term are bounded by the number of periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.functions.coerce import quarter_index
from quarterline.functions.text import count_chars
from quarterline.operators.tone import period_side
from quarterline.profiles import ZH, TextProfile

PERIOD = ("year", "quarter")


def document_rollup(
    sentences: DataFrame, keys: Sequence[str] = PERIOD, profile: TextProfile = ZH, joiner: str = "。"
) -> DataFrame:
    """Characters without ASCII spaces, sentence rows and sentence marks per period.

    Marks are those of the sentences joined by ``joiner``; a joiner that is itself a mark adds
    one per gap. With no mark at all the row count stands in.
    """
    text = F.coalesce("text", F.lit(""))
    marks = f"[{profile.terminators}]"
    gaps = F.count("*") - 1 if joiner in profile.terminators else F.lit(0)
    out = sentences.groupBy(*keys).agg(
        F.sum(F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("total_chars"),
        F.count("*").alias("n_rows"),
        (F.sum(count_chars(text, marks)) + gaps).alias("n_marks"),
    )
    return out.withColumn("n_marks", F.when(F.col("n_marks") > 0, F.col("n_marks")).otherwise(F.col("n_rows")))


def readability(rollup: DataFrame) -> DataFrame:
    """Average sentence length by marks and by rows."""
    return rollup.withColumns(
        {
            "avg_sent_len": F.col("total_chars") / F.nullif("n_marks", F.lit(0)),
            "avg_sent_len_rows": F.col("total_chars") / F.nullif("n_rows", F.lit(0)),
        }
    )


def term_counts(tokens: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Exploded tokens to one row per document and term."""
    return tokens.groupBy(*keys, F.col("token").alias("term")).agg(F.count("*").alias("tf"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def plain_idf(n: Column, df: Column) -> Column:
    return F.ln(n / df)


def _term_weights(terms: DataFrame, documents: DataFrame, keys: Sequence[str], smooth: bool):
    """Unnormalised weights with the document frequency of each term.

    The plain form divides a count by the document's total, which cancels when vectors are
    normalised, and drops terms found in every document (weight 0).
    """
    n = documents.agg(F.count("*").alias("n")).select("n").scalar()
    over_term = W.partitionBy("term")
    idf = (smooth_idf if smooth else plain_idf)(n, F.col("df"))
    weighted = terms.withColumn("df", F.count("*").over(over_term)).withColumn(
        "w", F.col("tf") * idf
    )
    return weighted.where("w <> 0")


def tfidf(
    terms: DataFrame, documents: DataFrame, keys: Sequence[str] = PERIOD, smooth: bool = False
) -> DataFrame:
    """L2-normalised weights per document and term.

    ``documents`` lists every document, also those without terms. Plain: count share times
    ln(N/df). Smooth: count times ln((1+N)/(1+df))+1.
    """
    keys = list(keys)
    weighted = _term_weights(terms, documents, keys, smooth)
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def similarity_prev(
    terms: DataFrame, documents: DataFrame, keys: Sequence[str] = PERIOD, smooth: bool = False,
    clip: bool = True,
) -> DataFrame:
    """Cosine with the document before in period order, and surprise = 1 - cosine.

    NULL for the first document (so for a single one); 0 when either vector is empty. Each
    term row looks at the same term's previous row, so the dot products need one shuffle by
    term and no self-join.
    """
    keys = list(keys)
    in_order = W.orderBy(*keys)  # one row per period
    docs = documents.select(*keys).distinct().withColumn("ord", F.row_number().over(in_order))
    weighted = _term_weights(terms, docs, keys, smooth).join(period_side(docs, keys), keys)
    along = W.partitionBy("term").orderBy("ord")
    adjacent = F.lag("ord").over(along) == F.col("ord") - 1
    pairs = weighted.withColumn("wp", F.when(adjacent, F.lag("w").over(along)))
    sums = pairs.groupBy("ord").agg(
        F.sum(F.col("w") * F.col("wp")).alias("dot"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    steps = W.orderBy("ord")
    out = docs.join(sums, "ord", "left").withColumn("before", F.lag("norm").over(steps))
    cosine = F.coalesce(F.col("dot") / (F.col("norm") * F.col("before")), F.lit(0.0))
    if clip:
        cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))
    sim = F.when(F.col("ord") > 1, cosine)
    return out.select(*keys, sim.alias("similarity_prev"), (1 - sim).alias("surprise_prev"))


def period_continuity(periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flag 1 where the natural quarter before is present; 0 otherwise and for the first."""
    order = W.partitionBy(*by).orderBy("q_idx")
    out = periods.withColumn("q_idx", quarter_index())
    step = F.col("q_idx") - F.lag("q_idx").over(order)
    return out.withColumn(
        "prev_quarter_available", F.coalesce((step == 1).cast("int"), F.lit(0))
    )


def gap_report(flagged: DataFrame) -> DataFrame:
    """Periods other than the first whose predecessor is missing."""
    first = flagged.agg(F.min("q_idx").alias("m")).select("m").scalar()
    return flagged.where((F.col("prev_quarter_available") == 0) & (F.col("q_idx") > first))


def strict_gap_null(
    flagged: DataFrame, columns: Sequence[str] = ("similarity_prev", "surprise_prev")
) -> DataFrame:
    """Blank the listed columns where the quarter before is missing."""
    here = F.col("prev_quarter_available") == 1
    return flagged.withColumns({c: F.when(here, F.col(c)) for c in columns})


def overwrite_columns(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Left rows with the listed columns taken from the right; NULL where unmatched.

    Running it twice gives the same table.
    """
    order = [c for c in left.columns] + [c for c in columns if c not in left.columns]
    fresh = right.select(*keys, *columns)
    return left.drop(*columns).join(fresh, list(keys), "left").select(*order)


def quantile_diagnostics(
    df: DataFrame, column: str, probs: Sequence[float] = (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)
) -> DataFrame:
    """Quantiles of a period-level column and the count outside [0, 1]."""
    c = F.col(column)
    outside = F.count_if((c < 0) | (c > 1)).alias("n_outside")
    quantiles = [F.percentile(c, float(p)).alias(f"q{int(100 * p):03d}") for p in probs]
    return df.agg(*quantiles, outside)
