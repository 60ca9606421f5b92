"""Topic weights and period tone."""

from pyspark.sql import functions as F

from quarterline.catalog.base import (
    QUARTERLY, SCORED, TOKENISED, count_sql, quarterly, query, r6, scored, tokenised,
)
from quarterline.functions.ranks import trimmed_mean as distributed_trimmed_mean
from quarterline.functions.scale import zscore
from quarterline.operators import tone as tn

WORDS = {"policy": ("the", "of", "la"), "macro": ("and", "de", "der", "in")}


@query(
    "topic_scores",
    f"""WITH {TOKENISED}
SELECT id, round(least(1e0, {count_sql('text', '|'.join(WORDS['policy']))} / greatest(len(tokens), 1)), 6) AS score_policy,
       round(least(1e0, {count_sql('text', '|'.join(WORDS['macro']))} / greatest(len(tokens), 1)), 6) AS score_macro
FROM toks""",
)
def topic_scores(spark, sf):
    rows = tn.topic_scores(tokenised(spark, sf), words=WORDS)
    return r6(rows.select("id", "score_policy", "score_macro"))


def topped(spark, sf):
    return tn.top_topics(scored(spark, sf))


def weighted(spark, sf):
    return tn.raw_weights(topped(spark, sf))


@query("topic_top1_top2", f"WITH {SCORED} SELECT id, top1_label, top1_score, top2_score FROM topped")
def topic_top1_top2(spark, sf):
    return topped(spark, sf).select("id", "top1_label", "top1_score", "top2_score")


@query("gap_factor", f"WITH {SCORED} SELECT id, round(gap_factor, 6) AS gap_factor FROM gapped")
def gap_factor(spark, sf):
    return r6(topped(spark, sf).select("id", "gap_factor"))


@query(
    "hard_assign_weight",
    f"""WITH {SCORED} SELECT id, round(weight_policy_raw, 6) AS weight_policy_raw, round(weight_macro_raw, 6) AS weight_macro_raw
FROM weighted""",
)
def hard_assign_weight(spark, sf):
    return r6(weighted(spark, sf).select("id", "weight_policy_raw", "weight_macro_raw"))


QUOTA = "CAST(CASE WHEN n <= 0 THEN 0 ELSE least(80, greatest(30, round(0.12e0 * n))) END AS INTEGER)"
SELECTION = f"""{SCORED},
sizes AS (SELECT year, quarter, count(*) AS n FROM weighted GROUP BY ALL),
long AS (
  SELECT id, year, quarter, neg_prob, top1_label, top1_score, top2_score, 'policy' AS topic, weight_policy_raw AS weight FROM weighted
  UNION ALL
  SELECT id, year, quarter, neg_prob, top1_label, top1_score, top2_score, 'macro' AS topic, weight_macro_raw AS weight FROM weighted),
counts AS (
  SELECT year, quarter, topic,
         count(*) FILTER (WHERE top1_score >= 0.5e0 AND weight > 0) AS e50,
         count(*) FILTER (WHERE top1_score >= 0.45e0 AND weight > 0) AS e45,
         count(*) FILTER (WHERE top1_score >= 0.4e0 AND weight > 0) AS e40,
         count(*) FILTER (WHERE top1_label = topic) AS n_top1,
         count(*) FILTER (WHERE top1_label = topic AND top1_score >= 0.5e0) AS n_confident
  FROM long GROUP BY ALL),
levels AS (
  SELECT c.year, c.quarter, topic, n AS n_sentences, n_top1, n_confident, {QUOTA} AS n_target,
         CASE WHEN e50 >= 30 THEN 0.5e0 WHEN e45 >= 30 THEN 0.45e0 ELSE 0.4e0 END AS tau_used,
         CASE WHEN e50 >= 30 THEN e50 WHEN e45 >= 30 THEN e45 ELSE e40 END AS n_eligible
  FROM counts c JOIN sizes s ON s.year = c.year AND s.quarter = c.quarter),
eligible AS (
  SELECT l.*, n_target, row_number() OVER (PARTITION BY l.year, l.quarter, l.topic ORDER BY weight DESC, id) AS rank
  FROM long l JOIN levels v ON v.year = l.year AND v.quarter = l.quarter AND v.topic = l.topic
  WHERE weight > 0 AND top1_score >= tau_used),
selected AS (SELECT * FROM eligible WHERE rank <= n_target),
toned AS (
  SELECT year, quarter, topic, sum(weight * coalesce(neg_prob, 0)) / nullif(sum(weight), 0) AS tone,
         quantile_cont(neg_prob, 0.9) AS tail, count(*) AS n_selected, avg(weight) AS avg_weight,
         avg(top1_score) AS avg_top_score, avg(top1_score - top2_score) AS avg_gap
  FROM selected GROUP BY ALL)"""


@query(
    "adaptive_quota",
    f"WITH {SCORED}, sizes AS (SELECT year, quarter, section, count(*) AS n FROM scored GROUP BY ALL) SELECT year, quarter, section, n, {QUOTA} AS quota FROM sizes",
)
def adaptive_quota(spark, sf):
    sizes = scored(spark, sf).groupBy("year", "quarter", "section").agg(F.count("*").alias("n"))
    return sizes.withColumn("quota", tn.quota(F.col("n")).cast("int"))


@query(
    "adaptive_threshold",
    f"WITH {SELECTION} SELECT year, quarter, topic, n_sentences, n_top1, n_confident, n_target, tau_used, n_eligible FROM levels",
)
def adaptive_threshold(spark, sf):
    return tn.thresholds(weighted(spark, sf)).drop("level")


@query(
    "topn_weighted",
    f"WITH {SELECTION} SELECT id, year, quarter, topic, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM selected",
)
def topn_weighted(spark, sf):
    rows = tn.select_weighted(weighted(spark, sf))
    return r6(rows.select("id", "year", "quarter", "topic", "weight", "rank"))


@query(
    "weighted_tone",
    f"""WITH {SELECTION} SELECT year, quarter, topic, round(tone, 6) AS tone, round(tail, 6) AS tail, n_selected,
  round(avg_weight, 6) AS avg_weight, round(avg_top_score, 6) AS avg_top_score, round(avg_gap, 6) AS avg_gap FROM toned""",
)
def weighted_tone(spark, sf):
    return r6(tn.weighted_tone(tn.select_weighted(weighted(spark, sf))))


@query(
    "tail_tone",
    f"""WITH {SCORED} SELECT year, quarter,
  round(quantile_cont(CASE WHEN weight_policy_raw > 0 THEN neg_prob END, 0.9), 6) AS tail_policy,
  round(quantile_cont(CASE WHEN weight_macro_raw > 0 THEN neg_prob END, 0.9), 6) AS tail_macro
FROM weighted GROUP BY ALL""",
)
def tail_tone(spark, sf):
    rows = weighted(spark, sf).withColumnsRenamed(
        {"weight_policy_raw": "weight_policy", "weight_macro_raw": "weight_macro"}
    )
    return r6(tn.tail_tone(rows, ["policy", "macro"], 0.9))


@query(
    "tail_tone_update",
    f"""WITH {SELECTION},
p AS (SELECT year, quarter, quantile_cont(neg_prob, 0.975) AS t, max(1) AS one FROM selected WHERE topic = 'policy' GROUP BY ALL),
m AS (SELECT year, quarter, quantile_cont(neg_prob, 0.975) AS t FROM selected WHERE topic = 'macro' GROUP BY ALL),
j AS (SELECT s.year, s.quarter, n, p.t AS tone_tail_policy, m.t AS tone_tail_macro FROM sizes s
      LEFT JOIN p ON p.year = s.year AND p.quarter = s.quarter LEFT JOIN m ON m.year = s.year AND m.quarter = s.quarter)
SELECT year, quarter, n, round(tone_tail_policy, 6) AS tone_tail_policy,
       CASE WHEN coalesce(stddev_samp(tone_tail_policy) OVER (), 0) = 0 THEN 0e0
            ELSE round((tone_tail_policy - avg(tone_tail_policy) OVER ()) / stddev_samp(tone_tail_policy) OVER (), 6) + 0e0 END AS tone_tail_policy_z,
       round(tone_tail_macro, 6) AS tone_tail_macro FROM j""",
)
def tail_tone_update(spark, sf):
    rows = weighted(spark, sf)
    bucket = tn.write_back(rows, tn.select_weighted(rows))
    sizes = rows.groupBy("year", "quarter").agg(F.count("*").alias("n"))
    old = sizes.withColumns({"tone_tail_policy": F.lit(0.0), "tone_tail_policy_z": F.lit(0.0)})
    columns = {"policy": "tone_tail_policy", "macro": "tone_tail_macro"}
    return r6(tn.update_tail(old, bucket, ["policy", "macro"], 0.975, columns))


@query("global_median", f"WITH {SCORED}, x AS (SELECT 1) SELECT round(median(neg_prob), 6) AS median FROM scored")
def global_median(spark, sf):
    return r6(tn.global_median(scored(spark, sf)))


INFORMATIVE = f"""{SCORED},
base AS (SELECT * FROM scored WHERE neg_prob IS NOT NULL),
med AS (SELECT median(neg_prob) AS m FROM base),
ns AS (SELECT year, quarter, count(*) AS n FROM base GROUP BY ALL),
ks AS (SELECT *, CAST(least(n, 200, greatest(50, round_even(0.2e0 * n, 0))) AS INTEGER) AS k FROM ns),
info AS (
  SELECT id, b.year, b.quarter, neg_prob, abs(neg_prob - m) AS info, k,
         row_number() OVER (PARTITION BY b.year, b.quarter ORDER BY abs(neg_prob - m) DESC, id) AS rank
  FROM base b, med, ks WHERE ks.year = b.year AND ks.quarter = b.quarter),
top AS (SELECT * FROM info WHERE rank <= k),
sorted AS (
  SELECT *, row_number() OVER (PARTITION BY year, quarter ORDER BY neg_prob, id) AS r, count(*) OVER (PARTITION BY year, quarter) AS c FROM top),
alltone AS (
  SELECT year, quarter, avg(neg_prob) FILTER (WHERE r > floor(0.1e0 * c) AND r <= c - floor(0.1e0 * c)) AS tone_all,
         quantile_cont(neg_prob, 0.9) AS tone_tail_all, CAST(count(*) AS INTEGER) AS n_selected
  FROM sorted GROUP BY ALL)"""


@query(
    "topk_informative",
    f"WITH {INFORMATIVE} SELECT id, year, quarter, neg_prob, round(info, 6) AS info, CAST(rank AS INTEGER) AS rank, k FROM top",
)
def topk_informative(spark, sf):
    rows = tn.topk_informative(scored(spark, sf))
    return r6(rows.select("id", "year", "quarter", "neg_prob", "info", "rank", "k"), "info")


@query(
    "trimmed_mean",
    f"""WITH {SCORED}, s AS (SELECT section, neg_prob AS v, row_number() OVER (PARTITION BY section ORDER BY neg_prob) AS r,
  count(*) OVER (PARTITION BY section) AS c FROM scored WHERE neg_prob IS NOT NULL)
SELECT section, round(avg(v) FILTER (WHERE r > floor(0.1e0 * c) AND r <= c - floor(0.1e0 * c)), 6) AS trimmed_mean FROM s GROUP BY ALL""",
)
def trimmed_mean(spark, sf):
    return r6(distributed_trimmed_mean(scored(spark, sf), ["section"], "neg_prob", 0.1))


@query(
    "tone_all",
    f"WITH {INFORMATIVE} SELECT year, quarter, round(tone_all, 6) AS tone_all, round(tone_tail_all, 6) AS tone_tail_all, n_selected FROM alltone",
)
def tone_all(spark, sf):
    return r6(tn.tone_all(scored(spark, sf)))


_PLAIN_INFORMATIVE = INFORMATIVE[len(SCORED) + 1:]


@query(
    "coverage_report",
    f"""WITH {SELECTION}, {_PLAIN_INFORMATIVE}
SELECT v.year, v.quarter, v.topic, n_sentences AS total_sentences, n_top1, n_confident, tau_used, n_eligible, n_target,
       CAST(coalesce(n_selected, 0) AS INTEGER) AS n_selected, round(coalesce(n_selected, 0) / n_sentences, 6) AS coverage,
       round(coalesce(avg_weight, 0), 6) AS avg_weight, round(coalesce(avg_top_score, 0), 6) AS avg_top_score, round(coalesce(avg_gap, 0), 6) AS avg_gap
FROM levels v LEFT JOIN toned t ON t.year = v.year AND t.quarter = v.quarter AND t.topic = v.topic
UNION ALL
SELECT s.year, s.quarter, 'all', s.n, NULL, NULL, NULL, NULL,
       CAST(least(CASE WHEN s.n <= 0 THEN 0 ELSE least(80, greatest(30, round(0.12e0 * s.n))) END, coalesce(n_selected, 0)) AS INTEGER),
       coalesce(n_selected, 0), round(coalesce(n_selected, 0) / s.n, 6), NULL, NULL, NULL
FROM sizes s LEFT JOIN alltone a ON a.year = s.year AND a.quarter = s.quarter""",
)
def coverage_report(spark, sf):
    rows = weighted(spark, sf)
    levels = tn.thresholds(rows)
    toned = tn.weighted_tone(tn.select_weighted(rows, levels=levels))
    return r6(tn.coverage_report(levels, toned, tn.tone_all(rows)))


@query(
    "zscore_columns",
    f"""WITH {QUARTERLY}
SELECT year, quarter, round((tone_policy - avg(tone_policy) OVER ()) / stddev_samp(tone_policy) OVER (), 6) + 0e0 AS tone_policy_z,
       round((tone_macro - avg(tone_macro) OVER ()) / stddev_samp(tone_macro) OVER (), 6) + 0e0 AS tone_macro_z,
       0e0 AS flat_z
FROM quarterly""",
)
def zscore_columns(spark, sf):
    rows = quarterly(spark, sf).withColumn("flat", F.lit(3.0))
    out = zscore(rows, ["tone_policy", "tone_macro", "flat"])
    return r6(out.select("year", "quarter", "tone_policy_z", "tone_macro_z", "flat_z"))


@query(
    "weights_writeback",
    f"""WITH {SELECTION}
SELECT w.id, w.year, w.quarter, round(coalesce(p.weight, 0), 6) AS weight_policy, round(coalesce(m.weight, 0), 6) AS weight_macro
FROM weighted w LEFT JOIN (SELECT * FROM selected WHERE topic = 'policy') p ON p.id = w.id
LEFT JOIN (SELECT * FROM selected WHERE topic = 'macro') m ON m.id = w.id""",
)
def weights_writeback(spark, sf):
    rows = weighted(spark, sf)
    out = tn.write_back(rows, tn.select_weighted(rows))
    return r6(out.select("id", "year", "quarter", "weight_policy", "weight_macro"))


FLAGS = f"""{SCORED},
flags AS (
  SELECT *, CASE WHEN year = 2002 AND quarter = 3 THEN section IN ('S1', 'S2', 'S3') ELSE section IN ('S1', 'S2', 'S3', 'S4') END AS is_real,
         CASE WHEN year = 2002 AND quarter = 3 THEN section = 'S4' ELSE section = 'S5' END AS is_guid FROM scored)"""


@query("section_flags", f"WITH {FLAGS} SELECT id, section, is_real, is_guid FROM flags")
def section_flags(spark, sf):
    return tn.section_flags(scored(spark, sf)).select("id", "section", "is_real", "is_guid")


@query(
    "section_tone",
    f"""WITH {FLAGS}, {QUARTERLY},
t AS (SELECT year, quarter, avg(1 - neg_prob) AS tone_all, avg(1 - neg_prob) FILTER (WHERE is_real) AS tone_real,
        avg(1 - neg_prob) FILTER (WHERE is_guid) AS tone_guid FROM flags GROUP BY ALL)
SELECT t.year, t.quarter, round(tone_all, 6) AS tone_all, round(tone_real, 6) AS tone_real, round(tone_guid, 6) AS tone_guid,
  round((tone_all - avg(tone_all) OVER ()) / stddev_samp(tone_all) OVER (), 6) + 0e0 AS tone_all_z,
  round((tone_real - avg(tone_real) OVER ()) / stddev_samp(tone_real) OVER (), 6) + 0e0 AS tone_real_z,
  round((tone_guid - avg(tone_guid) OVER ()) / stddev_samp(tone_guid) OVER (), 6) + 0e0 AS tone_guid_z, report_date
FROM t LEFT JOIN quarterly q ON q.year = t.year AND q.quarter = t.quarter""",
)
def section_tone(spark, sf):
    return r6(tn.section_tone(scored(spark, sf), quarterly(spark, sf)))


def _z(c):
    sd = f"stddev_samp({c}) OVER ()"
    return f"CASE WHEN coalesce({sd}, 0) = 0 THEN 0e0 ELSE round(({c} - avg({c}) OVER ()) / {sd}, 6) + 0e0 END AS {c}_z"


_TONES = ("tone_all", "tone_tail_all", "tone_policy", "tone_tail_policy", "tone_macro", "tone_tail_macro")


@query(
    "quarterly_tone",
    f"""WITH {SELECTION}, {_PLAIN_INFORMATIVE},
j AS (
  SELECT s.year, s.quarter, s.n AS n_sentences, {QUOTA.replace('n ', 's.n ').replace('* n)', '* s.n)')} AS topn_target, tone_all, tone_tail_all,
         p.tone AS tone_policy, p.tail AS tone_tail_policy, m.tone AS tone_macro, m.tail AS tone_tail_macro
  FROM sizes s LEFT JOIN alltone a ON a.year = s.year AND a.quarter = s.quarter
  LEFT JOIN (SELECT * FROM toned WHERE topic = 'policy') p ON p.year = s.year AND p.quarter = s.quarter
  LEFT JOIN (SELECT * FROM toned WHERE topic = 'macro') m ON m.year = s.year AND m.quarter = s.quarter)
SELECT year, quarter, n_sentences, topn_target, {', '.join(f'round(round({c}, 9), 6) AS {c}' for c in _TONES)}, {', '.join(map(_z, _TONES))} FROM j""",
)
def quarterly_tone(spark, sf):
    """Tones are rounded to nine digits first: tails often lie halfway between two sixth digits."""
    out = tn.quarterly_tone(weighted(spark, sf))
    return r6(out.withColumns({c: F.round(c, 9) for c in _TONES}))
