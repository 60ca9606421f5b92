"""Topic scores learned from keyword seeds.

Sentences with a seed word of a topic are examples of it, all others are not. Every other word gets
a weight per topic from how much oftener it stands in examples: one distributed count for all
topics. A sentence's score is the logistic function of its words' summed weights, so it is high in
the company of the topic's words, with or without a seed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.tokens import token_sums

Seeds = Mapping[str, Sequence[str]]


def seeded(tokens: Column, words: Sequence[str]) -> Column:
    """Does the sentence hold a seed word?"""
    return F.arrays_overlap(F.coalesce(tokens, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in words]))


def topic_vectors(
    df: DataFrame, seeds: Seeds, tokens: str = "tokens", with_counts: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``token, <topic>...`` weights, and one row of prior log-odds per topic.

    A weight is the add-one smoothed log-ratio of the shares of examples and of other sentences that hold
    the word; seeds weigh nothing for their own topic. Weights have nine decimals, so that
    their sums are exact in any order. ``n`` is how many sentences hold the word.
    """
    flags = {t: seeded(F.col(tokens), ws).cast("int") for t, ws in seeds.items()}
    rows = df.where(F.col(tokens).isNotNull()).select(F.array_distinct(tokens).alias("__t"), *[f.alias(t) for t, f in flags.items()])
    totals = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in seeds])
    counts = rows.select(F.explode("__t").alias("token"), *seeds).groupBy("token").agg(
        F.count("*").alias("n"), *[F.sum(t).alias(t) for t in seeds]
    )
    all_n = totals.select("n").scalar()
    weights = []
    for t, words in seeds.items():
        all_t = totals.select(t).scalar()
        odds = F.ln((F.col(t) + 1) / (all_t + 2)) - F.ln((F.col("n") - F.col(t) + 1) / (all_n - all_t + 2))
        weights.append(_nine(F.when(F.col("token").isin(list(words)), 0.0).otherwise(odds)).alias(t))
    priors = totals.select(*[_nine(F.ln((F.col(t) + 1) / (F.col("n") - F.col(t) + 1))).alias(t) for t in seeds])
    return counts.select("token", *weights, *(["n"] if with_counts else [])), priors


def _nine(x: Column) -> Column:
    return F.round(x, 9).cast("decimal(20,9)")


def learned_scores(
    df: DataFrame, vectors: DataFrame, priors: DataFrame, topics: Sequence[str], tokens: str = "tokens"
) -> DataFrame:
    """Add ``score_<topic>`` in [0, 1]. Sentences of the same distinct words are summed once; a
    sentence without known words has the prior's score."""
    bag = F.array_sort(F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>"))))
    keyed = df.withColumn("__b", bag).withColumn("__k", F.unhex(F.md5(F.to_json(F.struct("__b")).cast("binary"))))
    counted = vectors if "n" in vectors.columns else vectors.withColumn("n", F.lit(1))
    sums = token_sums(keyed, counted, list(topics), "__k", "__b")
    sums = sums.select("__k", *[F.col(t).alias(f"__{t}") for t in topics])
    zero = F.lit(0).cast("decimal(20,9)")
    total = lambda t: (F.coalesce(f"__{t}", zero) + priors.select(t).scalar()).cast("double")
    out = keyed.join(sums, "__k", "left")
    return out.select(*df.columns, *[(1 / (1 + F.exp(-total(t)))).alias(f"score_{t}") for t in topics])


def seed_agreement(scored: DataFrame, seeds: Seeds, tokens: str = "tokens", cut: float = 0.5) -> DataFrame:
    """Per topic: rows, rows with a seed, and the shares of both kinds that the score puts right."""
    cells = [
        F.struct(F.lit(t).alias("topic"), seeded(F.col(tokens), ws).alias("seed"), (F.col(f"score_{t}") >= cut).alias("high"))
        for t, ws in seeds.items()
    ]
    rows = scored.where(F.col(tokens).isNotNull()).select(F.inline(F.array(*cells)))
    share = lambda of: F.count_if(of & (F.col("seed") == F.col("high"))) / F.nullif(F.count_if(of), F.lit(0))
    return rows.groupBy("topic").agg(
        F.count("*").alias("n"),
        F.count_if("seed").alias("n_seeded"),
        share(F.col("seed")).alias("recall"),
        share(~F.col("seed")).alias("specificity"),
    )
