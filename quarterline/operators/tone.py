"""Topic weights and the roll-up of sentence scores to period tone.

Input rows: ``id``, period columns, ``neg_prob`` and topic scores. Per-period selections
keep at most a fixed number of rows per group, so Spark trims each partition before the
shuffle (``WindowGroupLimit``) and one huge period stays cheap. Tables keyed by calendar
quarter are bounded by the calendar and are broadcast; with further keys Spark decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.functions.ranks import exact_quantiles
from quarterline.functions.scale import zscore
from quarterline.functions.text import count_of
from quarterline.profiles import SECTION_FLAGS, TONE_RULES, TOPIC_WORDS, SectionFlags, ToneRules
from quarterline.session import checkpoint

PERIOD = ("year", "quarter")


def period_side(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Broadcast a table only when calendar quarters alone key it."""
    return F.broadcast(df) if set(keys) <= set(PERIOD) else df


def topic_scores(
    df: DataFrame, text: str = "text", tokens: str = "tokens", words=None
) -> DataFrame:
    """Keyword affinity in [0, 1] per topic: keyword hits over tokens, at most 1."""
    words = TOPIC_WORDS if words is None else words
    n = F.greatest(F.size(tokens), F.lit(1))
    return df.withColumns(
        {
            f"score_{topic}": F.least(F.lit(1.0), count_of(F.col(text), "|".join(ws)) / n)
            for topic, ws in words.items()
        }
    )


def gap_factor(top1: Column, top2: Column, gap: float = TONE_RULES.gap) -> Column:
    """1 from the gap threshold up, 0 at no gap, linear between."""
    diff = top1 - top2
    return F.when(diff >= gap, 1.0).when(diff <= 0, 0.0).otherwise(diff / gap)


def top_topics(df: DataFrame, rules: ToneRules = TONE_RULES) -> DataFrame:
    """Best topic (ties go to the first) with best and second score and gap factor."""
    first, second = rules.topics
    a, b = F.col(f"score_{first}"), F.col(f"score_{second}")
    lead = a >= b
    df = df.withColumns(
        {
            "top1_label": F.when(lead, first).otherwise(second),
            "top1_score": F.when(lead, a).otherwise(b),
            "top2_score": F.when(lead, b).otherwise(a),
        }
    )
    return df.withColumn("gap_factor", gap_factor(F.col("top1_score"), F.col("top2_score"), rules.gap))


def raw_weights(df: DataFrame, rules: ToneRules = TONE_RULES) -> DataFrame:
    """Discounted score for the best topic, 0 for the others."""
    weight = F.coalesce(F.col("top1_score") * F.col("gap_factor"), F.lit(0.0))
    return df.withColumns(
        {
            f"weight_{t}_raw": F.when(F.col("top1_label") == t, weight).otherwise(0.0)
            for t in rules.topics
        }
    )


def quota(n: Column, rules: ToneRules = TONE_RULES) -> Column:
    """Rows to select from n sentences."""
    share = F.round(F.lit(rules.quota_share) * n)
    bounded = F.least(F.lit(rules.quota_max), F.greatest(F.lit(rules.quota_min), share.cast("int")))
    return F.when(n <= 0, 0).otherwise(bounded)


def thresholds(
    df: DataFrame, keys: Sequence[str] = PERIOD, rules: ToneRules = TONE_RULES
) -> DataFrame:
    """Per period and topic: the first threshold with enough eligible rows (else the last),
    and the counts of the coverage report. One partial aggregate."""
    parts = []
    for t in rules.topics:
        raw = F.col(f"weight_{t}_raw") > 0
        named = F.col("top1_label") == t
        eligible = [F.count_if((F.col("top1_score") >= tau) & raw) for tau in rules.taus]
        parts.append(
            F.struct(
                F.lit(t).alias("topic"),
                F.array(*eligible).alias("eligible"),
                F.count_if(named).alias("n_top1"),
                F.count_if(named & (F.col("top1_score") >= rules.confidence)).alias("n_confident"),
            ).alias(f"__{t}")
        )
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_sentences"), *parts)
    long = counts.select(
        *keys, "n_sentences", F.inline(F.array(*[f"__{t}" for t in rules.topics]))
    )
    level = F.lit(len(rules.taus) - 1)
    for i in reversed(range(len(rules.taus) - 1)):
        level = F.when(F.get("eligible", i) >= rules.quota_min, F.lit(i)).otherwise(level)
    return (
        long.withColumn("level", level)
        .withColumn("tau_used", F.get(F.array(*[F.lit(t) for t in rules.taus]), F.col("level")))
        .withColumn("n_eligible", F.get("eligible", F.col("level")))
        .withColumn("n_target", quota(F.col("n_sentences"), rules))
        .drop("eligible")
    )


def select_weighted(
    df: DataFrame, ident: str = "id", keys: Sequence[str] = PERIOD, rules: ToneRules = TONE_RULES,
    levels: DataFrame | None = None,
) -> DataFrame:
    """The heaviest eligible rows per period and topic, at most the quota; ties by id.

    Each row is offered under every threshold it meets, ranked there up to the largest
    quota, and only then matched with its period's threshold: no row-level join.
    """
    keys = list(keys)
    levels = thresholds(df, keys, rules) if levels is None else levels
    offers = [
        F.struct(F.lit(t).alias("topic"), F.lit(i).alias("level"), F.col(f"weight_{t}_raw").alias("weight"))
        for t in rules.topics
        for i in range(len(rules.taus))
    ]
    taus = F.array(*[F.lit(t) for t in rules.taus])
    meets = lambda o: (o["weight"] > 0) & (F.col("top1_score") >= F.get(taus, o["level"]))
    long = df.select(
        ident, *keys, "neg_prob", "top1_score", "top2_score",
        F.inline(F.filter(F.array(*offers), meets)),
    )
    order = W.partitionBy(*keys, "topic", "level").orderBy(F.desc("weight"), F.asc(ident))
    ranked = long.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= rules.quota_max
    )
    chosen = levels.select(*keys, "topic", "level", "n_target")
    return ranked.join(period_side(chosen, keys), [*keys, "topic", "level"]).where("rank <= n_target")


def weighted_tone(
    selected: DataFrame, keys: Sequence[str] = PERIOD, tail: float = TONE_RULES.tail
) -> DataFrame:
    """Weighted mean and tail percentile of the selected rows per period and topic.

    A NULL score counts as 0 in the mean and is left out of the percentile. A group holds at
    most the quota, so the built-in percentile is safe.
    """
    mean = F.sum(F.col("weight") * F.coalesce("neg_prob", F.lit(0.0))) / F.nullif(
        F.sum("weight"), F.lit(0.0)
    )
    return selected.groupBy(*keys, "topic").agg(
        mean.alias("tone"),
        F.percentile(F.when(F.col("weight") > 0, F.col("neg_prob")), tail).alias("tail"),
        F.count("*").alias("n_selected"),
        F.avg("weight").alias("avg_weight"),
        F.avg("top1_score").alias("avg_top_score"),
        F.avg(F.col("top1_score") - F.col("top2_score")).alias("avg_gap"),
    )


def write_back(
    df: DataFrame, selected: DataFrame, ident: str = "id", keys: Sequence[str] = PERIOD,
    rules: ToneRules = TONE_RULES,
) -> DataFrame:
    """Attach final weights to the sentence rows; 0 where a row was not selected."""
    final = selected.groupBy(ident).agg(
        *[F.max(F.when(F.col("topic") == t, F.col("weight"))).alias(f"weight_{t}") for t in rules.topics]
    )
    out = df.join(final, ident, "left")
    return out.withColumns(
        {f"weight_{t}": F.coalesce(f"weight_{t}", F.lit(0.0)) for t in rules.topics}
    )


def tail_tone(
    df: DataFrame, topics: Sequence[str], tail: float, keys: Sequence[str] = PERIOD
) -> DataFrame:
    """Percentile of ``neg_prob`` over rows with positive weight, one column per topic."""
    weights = [
        F.struct(F.lit(t).alias("topic"), F.col(f"weight_{t}").alias("weight")) for t in topics
    ]
    long = df.select(*keys, "neg_prob", F.inline(F.array(*weights))).where("weight > 0")
    tails = exact_quantiles(long, [*keys, "topic"], "neg_prob", {"tail": tail})
    wide = [F.max(F.when(F.col("topic") == t, F.col("tail"))).alias(f"tail_{t}") for t in topics]
    return tails.groupBy(*keys).agg(*wide)


def update_tail(
    tone: DataFrame, bucket: DataFrame, topics: Sequence[str], tail: float,
    columns: dict[str, str], keys: Sequence[str] = PERIOD,
) -> DataFrame:
    """Replace tail columns of the period table by another percentile; a ``<column>_z`` is
    recomputed only where it already exists."""
    fresh = tail_tone(bucket, topics, tail, keys)
    fresh = fresh.withColumnsRenamed({f"tail_{t}": columns[t] for t in topics})
    names = [columns[t] for t in topics]
    redo = [c for c in names if f"{c}_z" in tone.columns]
    out = tone.drop(*names).join(fresh, list(keys), "left")
    out = zscore(out.drop(*[f"{c}_z" for c in redo]), redo) if redo else out
    return out.select(*tone.columns, *[c for c in names if c not in tone.columns])


def global_median(
    df: DataFrame, column: str = "neg_prob", keys: Sequence[str] = PERIOD
) -> DataFrame:
    """One row with the exact median of the column over all rows that have a period."""
    return exact_quantiles(df.dropna(subset=list(keys)), [], column, {"median": 0.5})


def topk_informative(
    df: DataFrame, ident: str = "id", keys: Sequence[str] = PERIOD, rules: ToneRules = TONE_RULES
) -> DataFrame:
    """Per period the rows whose score is farthest from the global median; ties by id.

    Rows without a period count nowhere, not even in the median.
    k = min(n, min(max, max(min, round(share*n)))), n being the rows with a score.
    """
    keys = list(keys)
    scored = df.where("neg_prob IS NOT NULL").dropna(subset=keys)
    median = global_median(scored, keys=keys)
    info = F.abs(F.col("neg_prob") - median.select("median").scalar())
    order = W.partitionBy(*keys).orderBy(F.desc("info"), F.asc(ident))
    ranked = (
        scored.select(ident, *keys, "neg_prob", info.alias("info"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rules.topk_max)
    )
    n = scored.groupBy(*keys).agg(F.count("*").alias("n"))
    share = F.bround(F.lit(rules.topk_share) * F.col("n")).cast("int")
    k = F.least(F.col("n"), F.lit(rules.topk_max), F.greatest(F.lit(rules.topk_min), share))
    n = n.withColumn("k", k.cast("int"))
    return ranked.join(period_side(n, keys), keys).where("rank <= k")


def tone_all(
    df: DataFrame, ident: str = "id", keys: Sequence[str] = PERIOD, rules: ToneRules = TONE_RULES,
    selected: DataFrame | None = None,
) -> DataFrame:
    """Trimmed mean and tail percentile of the informative rows per period."""
    keys = list(keys)
    selected = topk_informative(df, ident, keys, rules) if selected is None else selected
    # at most ``topk_max`` values per period
    values = F.sort_array(F.collect_list("neg_prob"))
    kept = F.slice("v", F.col("cut") + 1, F.col("n_selected") - 2 * F.col("cut"))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return (
        selected.groupBy(*keys)
        .agg(
            values.alias("v"),
            F.percentile("neg_prob", rules.tail).alias("tone_tail_all"),
            F.count("*").cast("int").alias("n_selected"),
        )
        .withColumn("cut", F.floor(F.lit(rules.trim) * F.col("n_selected")).cast("int"))
        .select(*keys, (total / F.size(kept)).alias("tone_all"), "tone_tail_all", "n_selected")
    )


def coverage_report(
    levels: DataFrame, toned: DataFrame, everything: DataFrame, keys: Sequence[str] = PERIOD,
    rules: ToneRules = TONE_RULES,
) -> DataFrame:
    """Per period and topic: totals, thresholds, counts and averages of the selection, plus
    one row for the topic-free tone. Rows without a period are left out."""
    keys = list(keys)
    levels = levels.dropna(subset=keys)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    chosen = F.coalesce("n_selected", F.lit(0))
    topics = levels.join(toned, [*keys, "topic"], "left").select(
        *keys,
        "topic",
        F.col("n_sentences").alias("total_sentences"),
        "n_top1",
        "n_confident",
        "tau_used",
        "n_eligible",
        "n_target",
        chosen.cast("int").alias("n_selected"),
        (chosen / F.col("n_sentences")).alias("coverage"),
        zero("avg_weight").alias("avg_weight"),
        zero("avg_top_score").alias("avg_top_score"),
        zero("avg_gap").alias("avg_gap"),
    )
    totals = levels.groupBy(*keys).agg(F.max("n_sentences").alias("n"), F.max("n_target").alias("q"))
    kept = F.coalesce("n_selected", F.lit(0))
    whole = totals.join(everything, keys, "left").select(
        *keys,
        F.lit("all").alias("topic"),
        F.col("n").alias("total_sentences"),
        F.least("q", kept).alias("n_target"),
        kept.cast("int").alias("n_selected"),
        (kept / F.col("n")).alias("coverage"),
    )
    return topics.unionByName(whole, allowMissingColumns=True)


def quarterly_tone(
    df: DataFrame, ident: str = "id", keys: Sequence[str] = PERIOD, rules: ToneRules = TONE_RULES
) -> DataFrame:
    """All tone indicators per period with z-scores (sample sd over the periods).

    Rows without a period are left out before anything is counted.
    """
    keys = list(keys)
    df = df.dropna(subset=keys)
    levels = checkpoint(thresholds(df, keys, rules))  # period tables are small and reused
    toned = weighted_tone(select_weighted(df, ident, keys, rules, levels), keys, rules.tail)
    wide = []
    for t in rules.topics:
        here = F.col("topic") == t
        wide += [
            F.max(F.when(here, F.col("tone"))).alias(f"tone_{t}"),
            F.max(F.when(here, F.col("tail"))).alias(f"tone_tail_{t}"),
        ]
    sizes = levels.groupBy(*keys).agg(
        F.max("n_sentences").alias("n_sentences"), F.max("n_target").alias("topn_target")
    )
    out = (
        sizes.join(tone_all(df, ident, keys, rules).drop("n_selected"), keys, "left")
        .join(toned.groupBy(*keys).agg(*wide), keys, "left")
    )
    return zscore(checkpoint(out), [c for c in out.columns if c.startswith("tone_")])


def section_flags(
    df: DataFrame, flags: SectionFlags = SECTION_FLAGS, section: str = "section"
) -> DataFrame:
    """Mark fundamentals and guidance sections; periods with their own split override."""
    name = F.trim(section)
    real, guidance = name.isin(*flags.real), name.isin(*flags.guidance)
    for (y, q), (own_real, own_guidance) in flags.overrides.items():
        here = (F.col("year") == y) & (F.col("quarter") == q)
        real = F.when(here, name.isin(*own_real)).otherwise(real)
        guidance = F.when(here, name.isin(*own_guidance)).otherwise(guidance)
    known = F.col("year").isNotNull() & F.col("quarter").isNotNull()
    return df.withColumns(
        {
            "is_real": F.coalesce(known & real, F.lit(False)),
            "is_guid": F.coalesce(known & guidance, F.lit(False)),
        }
    )


def section_tone(
    df: DataFrame, reports: DataFrame | None = None, keys: Sequence[str] = PERIOD,
    flags: SectionFlags = SECTION_FLAGS,
) -> DataFrame:
    """Mean optimism (1 - neg_prob) overall and per section group, z-scored; optionally
    with the report date."""
    flagged = section_flags(df, flags).withColumn("tone", 1 - F.col("neg_prob"))
    out = flagged.groupBy(*keys).agg(
        F.avg("tone").alias("tone_all"),
        F.avg(F.when(F.col("is_real"), F.col("tone"))).alias("tone_real"),
        F.avg(F.when(F.col("is_guid"), F.col("tone"))).alias("tone_guid"),
    )
    out = zscore(out, ["tone_all", "tone_real", "tone_guid"])
    if reports is None:
        return out
    return out.join(reports.select(*keys, "report_date"), list(keys), "left")


def centered_score(
    df: DataFrame, score: str = "score", keys: Sequence[str] = PERIOD
) -> DataFrame:
    """Score minus one half: mean, median and count per period; failed scores are dropped."""
    kept = df.where(F.col(score).isNotNull()).withColumn("centered", F.col(score) - 0.5)
    means = kept.groupBy(*keys).agg(
        F.avg("centered").alias("tone_mean"), F.count("*").alias("n_sentences")
    )
    return means.join(exact_quantiles(kept, keys, "centered", {"tone_median": 0.5}), list(keys))
