"""Weak labels, sampling and the classifier."""

from pyspark.sql import functions as F

from quarterline.catalog.base import DIGITS, count_sql, query, r6, sentences, table
from quarterline.catalog.lexicon import DICT_TONE, POS_NEG, PROFILE, net_rows, word_table
from quarterline.operators import weak as wk
from quarterline.plans.text_tone import classified, scored_sentences
from quarterline.plans.text_tone import classifier_metrics as held_out_metrics

SIGN = f"""{DICT_TONE},
labelled AS (SELECT id, text, tone, CASE WHEN tone > 0 THEN 0 ELSE 1 END AS label FROM dict_tone
  WHERE valid = 1 AND length(text) > 4 AND abs(tone) > 0)"""


def toned(spark, sf):
    return scored_sentences(
        sentences(spark, sf), tokenised_column(), word_table(spark), PROFILE
    )


def tokenised_column():
    from quarterline.functions.tokens import latin_tokens

    return latin_tokens(F.col("text"))


def labelled(spark, sf):
    return wk.weak_labels_sign(toned(spark, sf))


@query("weak_labels_sign", f"WITH {SIGN} SELECT id, label FROM labelled")
def weak_labels_sign(spark, sf):
    return labelled(spark, sf).select("id", "label")


@query(
    "weak_labels_quantile",
    f"""WITH {POS_NEG},
kept AS (SELECT id, "Neg_net" AS s FROM net WHERE length(text) >= 5 AND {count_sql('text', DIGITS)} / length(text) <= 0.15),
cut AS (SELECT quantile_cont(s, 0.1) AS lo, quantile_cont(s, 0.9) AS hi FROM kept)
SELECT id, 0 AS label FROM kept, cut WHERE s <= lo UNION ALL SELECT id, 1 FROM kept, cut WHERE s >= hi""",
)
def weak_labels_quantile(spark, sf):
    return wk.weak_labels_quantile(net_rows(spark, sf)).select("id", "label")


BALANCED = f"""{SIGN},
hashed AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS r FROM labelled),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM labelled GROUP BY label)),
sample AS (SELECT id, label, row_number() OVER (ORDER BY md5('42:' || id), id) AS shuffle FROM hashed, m WHERE r <= m)"""


def sampled(spark, sf):
    return wk.balanced_sample(labelled(spark, sf).select("id", "label"))


@query("balanced_sample", f"WITH {BALANCED} SELECT id, label, shuffle FROM sample")
def balanced_sample(spark, sf):
    return sampled(spark, sf)


@query(
    "train_eval_split",
    f"WITH {BALANCED} SELECT id, label, shuffle, CASE WHEN shuffle <= floor(0.9e0 * count(*) OVER ()) THEN 'train' ELSE 'eval' END AS split FROM sample",
)
def train_eval_split(spark, sf):
    return wk.train_eval_split(sampled(spark, sf))


@query(
    "binary_metrics",
    """WITH j AS (SELECT lang, quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM j GROUP BY lang)
SELECT *, round((n - fp - fn) / n, 6) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def binary_metrics(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("p")
    )
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    return r6(wk.binary_metrics(rows, "quality", "p", ["lang"]))


@query(
    "two_class_softmax",
    "SELECT event_id, round(exp(user_id / 1e2) / (exp(value / 1e2) + exp(user_id / 1e2)), 6) AS neg_prob FROM events",
)
def two_class_softmax(spark, sf):
    p = wk.two_class_softmax(F.col("value") / 100, F.col("user_id") / 100)
    return r6(table(spark, sf, "events").select("event_id", p.alias("neg_prob")))


SPLIT = f"""{BALANCED},
split AS (SELECT *, shuffle <= floor(0.9e0 * count(*) OVER ()) AS is_train FROM sample),
counts AS (SELECT token, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0
  FROM split s JOIN tok t ON t.id = s.id WHERE is_train GROUP BY token),
totals AS (SELECT sum(n1) AS s1, sum(n0) AS s0, count(*) AS v FROM counts),
weights AS (SELECT token, CAST(round(ln((n1 + 1) / (s1 + v)) - ln((n0 + 1) / (s0 + v)), 9) AS DECIMAL(20, 9)) AS w FROM counts, totals),
sums_w AS (SELECT t.id, CAST(sum(w) AS DOUBLE) AS s FROM tok t JOIN weights USING (token) GROUP BY t.id),
prob AS (SELECT d.id, year, quarter, 1 / (1 + exp(-coalesce(u.s, 0e0))) AS p FROM dict_tone d LEFT JOIN sums_w u ON u.id = d.id WHERE valid = 1)"""


@query("weak_classifier", f"WITH {SPLIT} SELECT id, year, quarter, round(p, 6) AS neg_prob FROM prob")
def weak_classifier(spark, sf):
    """Train on balanced weak labels and score every valid sentence."""
    return classified(toned(spark, sf)).select("id", "year", "quarter", F.round("neg_prob", 6).alias("neg_prob"))


@query(
    "classifier_metrics",
    f"""WITH {SPLIT},
held AS (SELECT label AS y, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS p FROM split s JOIN prob b ON b.id = s.id WHERE NOT is_train),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM held)
SELECT *, round((n - fp - fn) / n, 6) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def classifier_metrics(spark, sf):
    """Accuracy and F1 on the held-out tenth."""
    return r6(held_out_metrics(toned(spark, sf)))
