"""Weak labels, balanced sampling and a count-based classifier trained on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.coerce import strip
from quarterline.functions.ranks import exact_quantiles, hash_ranks
from quarterline.functions.tokens import array_key, token_sums
from quarterline.operators.lexicon import digit_share
from quarterline.session import checkpoint


def weak_labels_sign(
    df: DataFrame, tone: str = "dict_tone", text: str = "text", margin: float = 0.0,
    min_chars: int = 4,
) -> DataFrame:
    """Label 0 for positive and 1 for negative tone among valid, confident, long rows."""
    valid = F.col("is_valid_unit") == 1 if "is_valid_unit" in df.columns else F.col("is_numeric") == 0
    kept = df.where(valid & (F.length(text) > min_chars) & (F.abs(F.col(tone)) > margin))
    return kept.withColumn("label", F.when(F.col(tone) > 0, 0).otherwise(1))


def weak_labels_quantile(
    df: DataFrame, score: str = "Neg_net", text: str = "text", low: float = 0.1,
    high: float = 0.9, min_chars: int = 5, max_digit_share: float = 0.15,
) -> DataFrame:
    """Label the extreme scores: 0 up to the low quantile, 1 from the high one.

    Quantiles are exact and taken after the filters. A row that meets both bounds gets both
    labels, one row each.
    """
    clean = df.withColumn(text, strip(F.col(text)))
    kept = clean.where((F.length(text) >= min_chars) & (digit_share(F.col(text)) <= max_digit_share))
    cuts = exact_quantiles(kept, [], score, {"low": low, "high": high})
    bottom = F.col(score) <= cuts.select("low").scalar()
    top = F.col(score) >= cuts.select("high").scalar()
    both = F.array(F.when(bottom, 0), F.when(top, 1))
    return kept.withColumn("label", F.explode(both)).where("label IS NOT NULL")


def balanced_sample(
    df: DataFrame, ident: str = "id", label: str = "label", seed: int = 42, min_rows: int = 10
) -> DataFrame:
    """Equal numbers of both classes in a seeded random order (column ``shuffle``).

    Every class is ranked by a hash of seed and id; the smaller class sets the size. Fewer
    than ``min_rows`` rows fail the query. The labels are read several times, so id and
    label are checkpointed first.
    """
    slim = checkpoint(df.select(ident, label))
    sizes = slim.groupBy(label).agg(F.count("*").alias("n"))
    smallest = sizes.agg(F.min("n").alias("m"), F.count("*").alias("classes"))
    m = smallest.select(F.when(F.col("classes") == 2, F.col("m")).otherwise(0).alias("m")).scalar()
    few = F.raise_error(F.lit(f"fewer than {min_rows} rows in the smaller class")).cast("boolean")
    ranked = hash_ranks(slim, [label], ident, seed, "class_rank")
    sample = ranked.where(F.when(m < min_rows, few).otherwise(F.col("class_rank") <= m))
    shuffled = hash_ranks(sample.drop("class_rank"), [], ident, seed, "shuffle")
    rest = [c for c in df.columns if c not in (ident, label)]
    return df.drop(label).join(checkpoint(shuffled), ident) if rest else shuffled


def train_eval_split(df: DataFrame, share: float = 0.9, rank: str = "shuffle") -> DataFrame:
    """Add ``split``: the first ``int(share*n)`` rows of the shuffle train, the rest evaluate."""
    n = df.agg(F.count("*").alias("n")).select("n").scalar()
    first = F.col(rank) <= F.floor(F.lit(share) * n)
    return df.withColumn("split", F.when(first, "train").otherwise("eval"))


def binary_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 of the positive class 1; F1 is 0 without any positive."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    n, tp, fp, fn = (F.col(c) for c in ("n", "tp", "fp", "fn"))
    f1 = F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    return counts.withColumns({"accuracy": (n - fp - fn) / n, "f1": f1})


def two_class_softmax(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1."""
    return 1 / (1 + F.exp(logit0 - logit1))


def token_weights(
    train: DataFrame, tokens: str = "tokens", label: str = "label", with_counts: bool = False
) -> DataFrame:
    """``token, weight``: the add-one smoothed log-odds of a token between the classes; ``n`` is how often it occurs.

    Each token counts as often as it occurs. Weights have nine decimals, so that their sums
    are exact in any order.
    """
    counts = train.select(F.explode(tokens).alias("token"), label).groupBy("token").agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )
    total = counts.agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"), F.count("*").alias("v"))
    t = {c: total.select(c).scalar() for c in ("s1", "s0", "v")}
    odds = F.ln((F.col("n1") + 1) / (t["s1"] + t["v"])) - F.ln((F.col("n0") + 1) / (t["s0"] + t["v"]))
    weights = counts.withColumn("weight", F.round(odds, 9).cast("decimal(20,9)")).withColumn("n", F.col("n1") + F.col("n0"))
    return weights.select("token", "weight", *(["n"] if with_counts else []))


def score_sentences(weights: DataFrame, sentences: DataFrame, out: str = "neg_prob") -> DataFrame:
    """Add the probability of class 1: the logistic function of the tokens' summed weights.

    A sentence finds its sum by a digest of its tokens; unknown tokens weigh nothing. A column ``n`` of
    the weights, the tokens' frequency, tells which are looked up without a shuffle if they are many.
    """
    key = array_key("tokens")
    counted = weights if "n" in weights.columns else weights.withColumn("n", F.lit(1))
    sums = token_sums(sentences.select(key.alias("__k"), "tokens"), counted, ["weight"], "__k", "tokens")
    sums = sums.select("__k", F.col("weight").cast("double").alias("__s"))
    scored = sentences.withColumn("__k", key).join(sums, "__k", "left")
    p = 1 / (1 + F.exp(-F.coalesce("__s", F.lit(0.0))))
    return scored.withColumn(out, p).select(*sentences.columns, out)
