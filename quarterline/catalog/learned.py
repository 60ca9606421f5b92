"""Learned topic scores and calibrated tone."""

from pyspark.sql import functions as F

from quarterline.catalog.base import TOKENISED, query, r6, tokenised
from quarterline.catalog.weak import SPLIT, toned
from quarterline.operators import calibrate as cal
from quarterline.operators import topics as tp
from quarterline.operators import weak as wk
from quarterline.plans.text_tone import trained
from quarterline.session import checkpoint, stored

SEEDS = {"policy": ("the", "of", "la"), "macro": ("and", "de", "der")}
TOPICS = list(SEEDS)


def _vectors_sql():
    flags = ", ".join(f"CAST(list_has_any(tokens, {list(ws)}) AS INTEGER) AS {t}" for t, ws in SEEDS.items())
    weight = lambda t: (
        f"CASE WHEN token IN ({', '.join(repr(w) for w in SEEDS[t])}) THEN 0e0 ELSE "
        f"ln((c.{t} + 1) / (a.{t} + 2)) - ln((c.n - c.{t} + 1) / (a.n - a.{t} + 2)) END"
    )
    nine = lambda x: f"CAST(round({x}, 9) AS DECIMAL(20, 9))"
    return f"""{TOKENISED},
flagged AS (SELECT id, doc_id, tokens, {flags} FROM toks),
learn AS (SELECT * FROM flagged WHERE doc_id % 10 <> 0),
a AS (SELECT count(*) AS n, {', '.join(f'sum({t}) AS {t}' for t in TOPICS)} FROM learn),
c AS (SELECT token, count(*) AS n, {', '.join(f'sum({t}) AS {t}' for t in TOPICS)} FROM (SELECT unnest(list_distinct(tokens)) AS token, {', '.join(TOPICS)} FROM learn) GROUP BY token),
v AS (SELECT token, {', '.join(f'{nine(weight(t))} AS {t}' for t in TOPICS)} FROM c, a),
prior AS (SELECT {', '.join(f'{nine(f"ln(({t} + 1) / (n - {t} + 1))")} AS {t}' for t in TOPICS)} FROM a),
summed AS (SELECT id, {', '.join(f'sum(v.{t}) AS {t}' for t in TOPICS)} FROM (SELECT id, unnest(list_distinct(tokens)) AS token FROM toks) JOIN v USING (token) GROUP BY id),
scored_topics AS (SELECT f.id, f.doc_id, {', '.join(f'f.{t} AS seed_{t}, 1 / (1 + exp(-CAST(coalesce(s.{t}, 0) + prior.{t} AS DOUBLE))) AS score_{t}' for t in TOPICS)}
  FROM flagged f LEFT JOIN summed s ON s.id = f.id, prior)"""


VECTORS = _vectors_sql()


def learned(spark, sf, only="true"):
    """Learned from nine tenths of the documents, all sentences scored (or those that ``only`` names)."""
    rows = stored(tokenised(spark, sf).select("id", "doc_id", "tokens"))
    vectors, priors = tp.topic_vectors(rows.where("doc_id % 10 <> 0"), SEEDS, with_counts=True)
    return tp.learned_scores(rows.where(only), checkpoint(vectors), checkpoint(priors), TOPICS)


@query("topic_scores_learned", f"WITH {VECTORS} SELECT id, round(score_policy, 6) AS score_policy, round(score_macro, 6) AS score_macro FROM scored_topics")
def topic_scores_learned(spark, sf):
    return r6(learned(spark, sf).select("id", "score_policy", "score_macro"))


def _agreement_sql(t):
    return f"""SELECT '{t}' AS topic, count(*) AS n, count(*) FILTER (WHERE seed_{t} = 1) AS n_seeded,
  round(count(*) FILTER (WHERE seed_{t} = 1 AND score_{t} >= 0.5e0) / nullif(count(*) FILTER (WHERE seed_{t} = 1), 0), 6) AS recall,
  round(count(*) FILTER (WHERE seed_{t} = 0 AND score_{t} < 0.5e0) / nullif(count(*) FILTER (WHERE seed_{t} = 0), 0), 6) AS specificity
FROM scored_topics WHERE doc_id % 10 = 0"""


@query("topic_agreement", f"WITH {VECTORS} {' UNION ALL '.join(map(_agreement_sql, TOPICS))}")
def topic_agreement(spark, sf):
    """Agreement with the seeds on the held-out tenth of the documents."""
    return r6(tp.seed_agreement(learned(spark, sf, "doc_id % 10 = 0"), SEEDS))


CALIBRATED = f"""{SPLIT},
held AS (SELECT s.label AS y, b.p, s.shuffle % 2 AS side FROM split s JOIN prob b ON b.id = s.id WHERE NOT is_train),
bins AS (SELECT CAST(least(99, floor(round(p, 9) * 100)) AS INTEGER) AS bin, count(*) AS n, sum(y) AS pos FROM held WHERE side = 0 GROUP BY 1),
ends AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cn, sum(pos) OVER (ORDER BY bin) AS cp, n, pos FROM bins),
spans AS (SELECT j.bin AS j, k.bin AS k, (k.cp - j.cp + j.pos) / (k.cn - j.cn + j.n) AS share FROM ends j JOIN ends k ON j.bin <= k.bin),
fitted AS (SELECT i AS bin, max(low) AS v FROM (SELECT i.bin AS i, j, min(share) AS low FROM bins i JOIN spans ON j <= i.bin AND k >= i.bin GROUP BY 1, 2) GROUP BY i),
steps AS (SELECT b.bin, coalesce((SELECT arg_max(v, f.bin) FROM fitted f WHERE f.bin <= b.bin), (SELECT arg_min(v, f.bin) FROM fitted f)) AS v
  FROM (SELECT unnest(range(0, 100)) AS bin) b)"""


def calibrated_rows(spark, sf):
    """Scored sentences, the held-out rows, and the blocks fitted to the even half of these."""
    scored = stored(toned(spark, sf))
    weights, held = trained(scored)
    held = checkpoint(wk.score_sentences(weights, held).select("id", "shuffle", "label", "neg_prob"))
    blocks = checkpoint(cal.pooled(cal.bin_counts(held.where("shuffle % 2 = 0"), "neg_prob", "label")))
    return wk.score_sentences(weights, scored), held, blocks


@query(
    "calibrated_tone",
    f"""WITH {CALIBRATED}
SELECT id, year, quarter, round(p, 6) AS neg_prob, round(v, 6) AS calibrated FROM prob JOIN steps ON bin = CAST(least(99, floor(round(p, 9) * 100)) AS INTEGER)""",
)
def calibrated_tone(spark, sf):
    rows, _, blocks = calibrated_rows(spark, sf)
    rows = cal.with_calibrated(rows.select("id", "year", "quarter", "neg_prob"), "neg_prob", blocks)
    return r6(rows)


def _ece_sql(p):
    return f"""(SELECT sum(n * gap) / sum(n) FROM (SELECT count(*) AS n, abs(avg({p}) - avg(y)) AS gap FROM other
  GROUP BY CAST(least(9, floor(round({p}, 9) * 10)) AS INTEGER)))"""


@query(
    "calibration_error",
    f"""WITH {CALIBRATED},
other AS (SELECT y, p, v FROM held JOIN steps ON bin = CAST(least(99, floor(round(p, 9) * 100)) AS INTEGER) WHERE side = 1)
SELECT (SELECT count(*) FROM other) AS n, round({_ece_sql('p')}, 6) AS before, round({_ece_sql('v')}, 6) AS after""",
)
def calibration_error(spark, sf):
    """Expected calibration error on the held-out rows the blocks were not fitted to."""
    _, held, blocks = calibrated_rows(spark, sf)
    other = cal.with_calibrated(held.where("shuffle % 2 = 1"), "neg_prob", blocks, "v")
    before, after = cal.calibration_error(other, "neg_prob", "label"), cal.calibration_error(other, "v", "label")
    return r6(before.select("n", F.col("ece").alias("before"), after.select("ece").scalar().alias("after")))
