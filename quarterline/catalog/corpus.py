"""Readability, TF-IDF and similarity."""

from pyspark.sql import functions as F

from quarterline.catalog.base import (
    QUARTERLY, SENTENCES, TOKENISED, quarterly, query, r6, sentences, tokenised,
)
from quarterline.functions.text import add_once
from quarterline.functions.tokens import explode_tokens, filter_tokens
from quarterline.operators import corpus as cp

PERIOD = ["year", "quarter"]
STOP = ("the", "of", "de", "and")

ROLLUP = f"""{SENTENCES},
rollup_ AS (
  SELECT year, quarter, CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS total_chars, count(*) AS n_rows,
         CAST(sum(len(regexp_extract_all(text, '[。！？.!?]'))) + count(*) - 1 AS BIGINT) AS marks
  FROM sents GROUP BY ALL),
docs AS (SELECT year, quarter, total_chars, n_rows, CASE WHEN marks > 0 THEN marks ELSE n_rows END AS n_marks FROM rollup_)"""


def rollup(spark, sf):
    return cp.document_rollup(sentences(spark, sf))


@query("document_rollup", f"WITH {ROLLUP} SELECT * FROM docs")
def document_rollup(spark, sf):
    return rollup(spark, sf)


@query(
    "readability",
    f"WITH {ROLLUP} SELECT year, quarter, round(total_chars / n_marks, 6) AS avg_sent_len, round(total_chars / n_rows, 6) AS avg_sent_len_rows FROM docs",
)
def readability(spark, sf):
    out = cp.readability(rollup(spark, sf))
    return r6(out.select(*PERIOD, "avg_sent_len", "avg_sent_len_rows"))


@query(
    "filter_tokens",
    rf"""WITH {SENTENCES}, w AS (SELECT year, quarter, unnest(string_split(text, ' ')) AS token FROM sents)
SELECT year, quarter, token, count(*) AS n FROM w
WHERE token <> '' AND NOT regexp_matches(token, '^\p{{Nd}}+(\.\p{{Nd}}+)?$') AND NOT regexp_matches(token, '^[^\p{{L}}\p{{N}}]+$')
  AND token NOT IN {STOP} GROUP BY ALL""",
)
def filter_tokens_query(spark, sf):
    words = add_once(sentences(spark, sf), {"tokens": F.split("text", " ")})
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    kept = filter_tokens(explode_tokens(words, PERIOD), stop)
    return kept.groupBy(*PERIOD, "token").agg(F.count("*").alias("n"))


def terms(spark, sf):
    return cp.term_counts(explode_tokens(tokenised(spark, sf), PERIOD))


def documents(spark, sf):
    return sentences(spark, sf).select(*PERIOD).distinct()


TERMS = f"""{TOKENISED},
tf AS (SELECT year, quarter, token AS term, count(*) AS tf FROM tok GROUP BY ALL),
docs AS (SELECT DISTINCT year, quarter, year * 4 + quarter AS q FROM sents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
plain AS (SELECT tf.*, tf * ln((SELECT count(*) FROM docs) / df) AS w FROM tf JOIN df USING (term)),
smooth AS (SELECT tf.*, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))"""


def _normalised(t):
    return f"""n_{t} AS (SELECT year, quarter, sqrt(sum(w * w)) AS norm FROM {t} GROUP BY ALL),
v_{t} AS (SELECT t.year, t.quarter, term, w / norm AS w FROM {t} t JOIN n_{t} n ON n.year = t.year AND n.quarter = t.quarter WHERE w <> 0)"""


def _similarity(t, name):
    return f"""{_normalised(t)},
o_{t} AS (SELECT *, row_number() OVER (ORDER BY year, quarter) AS ord FROM docs),
d_{t} AS (SELECT o.ord, sum(a.w * b.w) AS dot FROM v_{t} a JOIN o_{t} o ON o.year = a.year AND o.quarter = a.quarter
  JOIN o_{t} p ON p.ord = o.ord - 1 JOIN v_{t} b ON b.year = p.year AND b.quarter = p.quarter AND b.term = a.term GROUP BY o.ord),
{name} AS (SELECT o.year, o.quarter, CASE WHEN o.ord > 1 THEN least(1e0, greatest(0e0, coalesce(dot, 0e0))) END AS sim
  FROM o_{t} o LEFT JOIN d_{t} d ON d.ord = o.ord)"""


@query("tfidf_unsmoothed", f"WITH {TERMS}, {_normalised('plain')} SELECT year, quarter, term, round(w, 6) AS w FROM v_plain")
def tfidf_unsmoothed(spark, sf):
    return r6(cp.tfidf(terms(spark, sf), documents(spark, sf)))


@query("tfidf_smoothed", f"WITH {TERMS}, {_normalised('smooth')} SELECT year, quarter, term, round(w, 6) AS w FROM v_smooth")
def tfidf_smoothed(spark, sf):
    return r6(cp.tfidf(terms(spark, sf), documents(spark, sf), smooth=True))


def similar(spark, sf, **kw):
    return cp.similarity_prev(terms(spark, sf), documents(spark, sf), **kw)


@query(
    "similarity_prev",
    f"WITH {TERMS}, {_similarity('plain', 's')} SELECT year, quarter, round(sim, 6) AS similarity_prev, round(1 - sim, 6) AS surprise_prev FROM s",
)
def similarity_prev(spark, sf):
    return r6(similar(spark, sf))


@query(
    "similarity_prev_smoothed",
    f"WITH {TERMS}, {_similarity('smooth', 's')} SELECT year, quarter, round(sim, 6) AS similarity_prev, round(1 - sim, 6) AS surprise_prev FROM s",
)
def similarity_prev_smoothed(spark, sf):
    return r6(similar(spark, sf, smooth=True, clip=False))


CONTINUITY = """
flagged AS (
  SELECT *, CASE WHEN q - lag(q) OVER (ORDER BY q) = 1 THEN 1 ELSE 0 END AS avail, min(q) OVER () AS first FROM docs)"""


@query(
    "period_continuity",
    f"""WITH {TERMS}, {CONTINUITY}
SELECT year, quarter, q AS q_idx, avail AS prev_quarter_available, CASE WHEN avail = 0 AND q > first THEN 1 ELSE 0 END AS is_gap FROM flagged""",
)
def period_continuity(spark, sf):
    flagged = cp.period_continuity(documents(spark, sf))
    gaps = cp.gap_report(flagged).select(*PERIOD, F.lit(1).alias("is_gap"))
    return flagged.join(gaps, PERIOD, "left").fillna(0, subset=["is_gap"])


STRICT = f"""{_similarity('plain', 's')}, {CONTINUITY},
strict AS (SELECT f.year, f.quarter, avail, CASE WHEN avail = 1 THEN sim END AS sim
  FROM flagged f JOIN s ON s.year = f.year AND s.quarter = f.quarter)"""


def strict(spark, sf):
    flagged = cp.period_continuity(documents(spark, sf))
    return cp.strict_gap_null(flagged.join(similar(spark, sf), PERIOD))


@query(
    "strict_gap_null",
    f"WITH {TERMS}, {STRICT} SELECT year, quarter, avail AS prev_quarter_available, round(sim, 6) AS similarity_prev, round(1 - sim, 6) AS surprise_prev FROM strict",
)
def strict_gap_null(spark, sf):
    return r6(strict(spark, sf).drop("q_idx"))


@query(
    "overwrite_columns",
    f"""WITH {ROLLUP}, {QUARTERLY}
SELECT q.year, q.quarter, round(tone_policy, 6) AS tone_policy, round(total_chars / n_marks, 6) AS avg_sent_len, n_rows
FROM quarterly q LEFT JOIN docs d ON d.year = q.year AND d.quarter = q.quarter""",
)
def overwrite_columns(spark, sf):
    left = quarterly(spark, sf).select(*PERIOD, "tone_policy", "avg_sent_len")
    fresh = cp.readability(rollup(spark, sf))
    once = cp.overwrite_columns(left, fresh, PERIOD, ["avg_sent_len", "n_rows"])
    return r6(cp.overwrite_columns(once, fresh, PERIOD, ["avg_sent_len", "n_rows"]))


@query(
    "quantile_diagnostics",
    f"""WITH {TERMS}, {_similarity('plain', 's')}
SELECT {', '.join(f'round(quantile_cont(sim, {p}), 6) AS q{int(p * 100):03d}' for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))},
       count(*) FILTER (WHERE sim < 0 OR sim > 1) AS n_outside FROM s""",
)
def quantile_diagnostics(spark, sf):
    return r6(cp.quantile_diagnostics(similar(spark, sf), "similarity_prev"))
