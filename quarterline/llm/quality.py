"""Quality rules with thresholds that adapt to each language and source.

Per document a few ratios are measured (symbols, repeated words, repeated lines, capitals, word
length). Their distribution within a (language, source) is held as a mergeable quantile sketch:
counts in log-linear buckets, whose relative width is at most 1/32. Sketches add up, so they are
plain grouped counts that combine on the map side, and a small source falls back on the merged
sketch of its language. The cut-off of a ratio is an outer fence of its sketch, whatever its size, and
the documents are joined with the cut-offs and filtered.

Most ratios are zero in most documents, where quartiles alone would reject a single symbol. Two
rules cover that, neither of them a cut-off: the first few events of a document (ALLOWED) are not
counted, as a share of three lines or sixty words says little; and the spread of a sketch is at least
its resolution (LEAST_SPREAD, BUCKETS).

Cases: a document at its cut-off is kept; a null or empty text has no words and fails; null language or source is a group of its own
like any other; repeated rows count as often as they occur; empty tables give empty results;
extra columns pass through ``filter_quality`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import WORD, fresh, query, small_batches, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Of a sketch with fewer documents the merged one of the language is used.
MIN_GROUP = 100
#: Multiples of the interquartile range above the upper quartile.
FENCE = 3
#: Events of a document that its ratio leaves out: three symbols, three windows repeated once, three
#: lines. Capitals and word length are no events.
ALLOWED = {"symbols": 3, "repeats": 18, "lines": 3, "capitals": 0, "length": 0}
#: The interquartile range (in 1/10000) counts as at least this much, up to where buckets are exact, and
#: as at least the width of the upper quartile's bucket, a share of 1/BUCKETS of it.
LEAST_SPREAD = 64
BUCKETS = 32
RATIOS = list(ALLOWED)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = T.StructType(
    [T.StructField(n, T.LongType()) for n in [*BASE, "n_lines", "n_capitals"]]
)
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def repeated_words(ids: np.ndarray) -> int:
    """Word positions inside any 3-word window that occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(
        pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True
    )
    at = np.flatnonzero(counts[inverse] >= 2)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The seven counts of one text."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, len(found))
    chars = len(text) - sum(text.count(c) for c in _SPACE_CHARS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        len(found), chars, symbols, len(lines) - len(set(lines)),
        repeated_words(ids) if len(seen) < len(found) else 0, len(lines), capitals,
    )


@F.pandas_udf(_MEASURED)
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=_MEASURED.names, dtype="int64")


measured = _measured.asNondeterministic()  # so that filters don't run it a second time


def ratios(of) -> dict:
    """The ratios in whole 1/10000 from the counts; ``of`` gives a count's column."""
    counts = {
        "symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"),
        "capitals": ("n_capitals", "word_chars"), "length": ("word_chars", "n_words"),
    }

    def part(ratio: str):
        events, total = (of(n) for n in counts[ratio])
        counted = F.greatest(events - ALLOWED[ratio], F.lit(0).cast("long"))
        return F.when(total > 0, F.floor(counted * 10_000 / total)).otherwise(0).cast("long")

    return {r: part(r) for r in RATIOS}


def bucket_sql(v: str) -> str:
    """The lower end of a value's bucket: exact under 64, then 32 buckets for each doubling."""
    cases = " ".join(
        f"WHEN {v} < {64 << k} THEN {v} - {v} % {1 << k}" for k in range(0, 26)
    )
    return f"CASE {cases} ELSE {64 << 25} END"


def sketches(scored: DataFrame, lang: str, source: str, prefix: str) -> DataFrame:
    """``lang, source, ratio, bucket, c``: grouped counts of all documents with a word."""
    names = ", ".join(f"'{r}', `{prefix}{r}`" for r in RATIOS)
    long = scored.select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.expr(f"stack({len(RATIOS)}, {names}) AS (ratio, v)"),
    )
    return long.groupBy("lang", "source", "ratio", F.expr(bucket_sql("v")).alias("bucket")).agg(
        F.count("*").alias("c")
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source, cut_<ratio>`` from the sketches; one row per language and source."""

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        group = W.partitionBy(*keys, "ratio")
        s = s.withColumns({"n": F.sum("c").over(group), "upto": F.sum("c").over(group.orderBy("bucket"))})
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, F.col("bucket")))
        return s.groupBy(*keys, "ratio").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("n").alias("n"))

    own = quartiles(sketch, ["lang", "source"])
    merged = sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("c").alias("c"))
    whole = quartiles(merged, ["lang"]).select(
        F.col("lang").alias("l"), F.col("ratio").alias("r"), F.col("q1").alias("w1"), F.col("q3").alias("w3")
    )
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r")))
    big = F.col("n") >= MIN_GROUP
    q1, q3 = F.when(big, F.col("q1")).otherwise(F.col("w1")), F.when(big, F.col("q3")).otherwise(F.col("w3"))
    cuts = []
    fence = q3 + FENCE * F.greatest(q3 - q1, F.lit(LEAST_SPREAD), F.floor(q3 / BUCKETS))
    for r in RATIOS:
        cuts.append(F.max(F.when(F.col("ratio") == r, fence)).cast("long").alias(f"cut_{r}"))
    return both.groupBy("lang", "source").agg(*cuts)


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"):
    """Every row of ``docs`` with its counts and verdict.

    Returns the frame and the name of one added struct column with the fields of BASE,
    ``base_failed``, ``kept`` and a cut-off per ratio.
    """
    small_batches(docs.sparkSession)
    m, l2, s2, out, prefix = fresh(docs, "measured", "lang2", "source2", "quality", "ratio_")
    scored = docs.withColumn(m, measured(F.col(f"`{text}`")))
    scored = scored.withColumns({f"{prefix}{r}": e for r, e in ratios(lambda n: F.col(f"{m}.{n}")).items()})
    slim = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), measured(F.col(f"`{text}`")).alias("m"))
    slim = slim.where(F.col("m.n_words") > 0)
    slim = slim.withColumns({f"r_{r}": e for r, e in ratios(lambda n: F.col(f"m.{n}")).items()})
    cuts = thresholds(sketches(slim, "lang", "source", "r_"))
    cuts = cuts.withColumnsRenamed({"lang": l2, "source": s2})
    cut_names = [f"cut_{r}" for r in RATIOS]
    packed = fresh(docs, "cuts")[0]
    cuts = cuts.select(l2, s2, F.struct(*cut_names).alias(packed))
    joined = scored.join(
        cuts, F.col(f"`{lang}`").eqNullSafe(F.col(l2)) & F.col(f"`{source}`").eqNullSafe(F.col(s2)), "left"
    )
    n, rep = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    over = F.lit(False)
    for r in RATIOS:
        over = over | F.coalesce(F.col(f"{prefix}{r}") > F.col(f"{packed}.cut_{r}"), F.lit(False))
    verdict = F.struct(
        *[F.col(f"{m}.{b}").alias(b) for b in BASE],
        failed.alias("base_failed"),
        (~failed & ~over).alias("kept"),
        *[F.col(f"{packed}.{c}").alias(c) for c in cut_names],
    )
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias(out)), out


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    judged, q = judge_quality(docs)
    return judged.where(F.col(f"{q}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


_DUCK_BUCKET = bucket_sql("v")
_QUARTILES = """
  SELECT {keys}, ratio, max(n) AS n,
    min(CASE WHEN upto * 4 >= n THEN bucket END) AS q1, min(CASE WHEN upto * 4 >= n * 3 THEN bucket END) AS q3
  FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}, ratio) AS n,
               sum(c) OVER (PARTITION BY {keys}, ratio ORDER BY bucket) AS upto FROM {sketch}) GROUP BY {keys}, ratio
"""


def quality_ctes(docs: str) -> str:
    """WITH items (without the keyword) up to ``judged``: DuckDB SQL for the rules on a relation."""
    over = " OR ".join(f"coalesce(r_{r} > cut_{r}, false)" for r in RATIOS)
    cuts = ", ".join(
        f"max(CASE WHEN o.ratio = '{r}' AND n >= {MIN_GROUP} THEN q3 + {FENCE} * greatest(q3 - q1, {LEAST_SPREAD}, q3 // {BUCKETS}) "
        f"WHEN o.ratio = '{r}' THEN w3 + {FENCE} * greatest(w3 - w1, {LEAST_SPREAD}, w3 // {BUCKETS}) END) AS cut_{r}"
        for r in RATIOS
    )
    stack = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, r_{r} AS v FROM ratioed WHERE n_words > 0" for r in RATIOS)
    return f"""
q_in AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
q_words AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM q_in),
q_pos AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM q_words),
q_win AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM q_pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
q_cnt AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM q_win WHERE w3 IS NOT NULL),
q_rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM q_cnt WHERE c >= 2) GROUP BY rid),
counted AS (SELECT q_in.*, CAST(len(q.w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(coalesce(text, ''), '[{WORD[2:-2]}]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
  length(regexp_replace(coalesce(text, ''), '[^A-Z]+', '', 'g')) AS n_capitals
  FROM q_in JOIN q_words q USING (rid) LEFT JOIN q_rep r USING (rid)),
ratioed AS (SELECT *,
  CASE WHEN word_chars > 0 THEN greatest(n_symbols - {ALLOWED['symbols']}, 0) * 10000 // word_chars ELSE 0 END AS r_symbols,
  CASE WHEN n_words > 0 THEN greatest(n_repeat_words - {ALLOWED['repeats']}, 0) * 10000 // n_words ELSE 0 END AS r_repeats,
  CASE WHEN n_lines > 0 THEN greatest(n_dup_lines - {ALLOWED['lines']}, 0) * 10000 // n_lines ELSE 0 END AS r_lines,
  CASE WHEN word_chars > 0 THEN n_capitals * 10000 // word_chars ELSE 0 END AS r_capitals,
  CASE WHEN n_words > 0 THEN word_chars * 10000 // n_words ELSE 0 END AS r_length FROM counted),
q_sketch AS (SELECT lang, source, ratio, {_DUCK_BUCKET} AS bucket, count(*) AS c FROM ({stack}) GROUP BY ALL),
q_merged AS (SELECT lang, ratio, bucket, sum(c) AS c FROM q_sketch GROUP BY ALL),
q_own AS ({_QUARTILES.format(keys="lang, source", sketch="q_sketch")}),
q_whole AS (SELECT lang, ratio, q1 AS w1, q3 AS w3 FROM ({_QUARTILES.format(keys="lang", sketch="q_merged")})),
q_cuts AS (SELECT o.lang, o.source, {cuts} FROM q_own o JOIN q_whole h ON o.lang IS NOT DISTINCT FROM h.lang AND o.ratio = h.ratio
  GROUP BY o.lang, o.source),
judged AS (SELECT r.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR {over}) AS kept
  FROM ratioed r LEFT JOIN q_cuts t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source)"""


OP9_COLUMNS = ["doc_id", *BASE, "base_failed", "kept"]


@query("op9_quality_rules", f"WITH {quality_ctes('documents')} SELECT {', '.join(OP9_COLUMNS)} FROM judged")
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged, q = judge_quality(docs)
    return judged.select("doc_id", *[F.col(f"{q}.{c}").alias(c) for c in OP9_COLUMNS[1:]])
