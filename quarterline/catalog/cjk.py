"""Unspaced script: the tables' words with every Latin letter written as a Han character."""

from pyspark.sql import functions as F

from quarterline.catalog.base import SENTENCES, TOKENISED, query, sentences, tokenised
from quarterline.operators import segment as sg

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: One Han character for each letter, in their order.
HAN = "中国人民银行货币政策执报告经济增长物价稳定金融市场利"


def han(column):
    return F.translate(F.lower(column), LETTERS, HAN)


def han_words(spark, sf):
    """The tables' words of up to four letters with their counts: a dictionary of parts of the longer words."""
    words = tokenised(spark, sf).select(F.explode("tokens").alias("w")).where(F.length("w") <= 4)
    return words.groupBy(F.translate("w", LETTERS, HAN).alias("word")).agg(F.count("*").alias("freq"))


_PIECES = r"\p{Han}+|[A-Za-z]+|[0-9]+|(?s:.)"

CJK = f"""WITH RECURSIVE {TOKENISED},
lines AS (SELECT id, translate(lower(text), '{LETTERS}', '{HAN}') AS text FROM sents),
dict AS (SELECT translate(token, '{LETTERS}', '{HAN}') AS word, count(*) AS f FROM tok WHERE length(token) <= 4 GROUP BY 1),
total AS (SELECT CAST(sum(f) AS DOUBLE) AS t FROM dict),
costs AS (SELECT word, CAST(round((ln(t) - ln(f)) * 1000000) AS BIGINT) AS c FROM dict, total),
pieces AS (SELECT id, unnest(regexp_extract_all(text, '{_PIECES}')) AS piece, generate_subscripts(regexp_extract_all(text, '{_PIECES}'), 1) AS i FROM lines),
runs AS (SELECT DISTINCT piece AS run FROM pieces WHERE regexp_matches(piece, '^\\p{{Han}}')),
edges AS (SELECT run, pos_, list(struct_pack(l := l, c := c)) AS e FROM (
    SELECT s.run, s.pos_, s.l, coalesce(c, CAST(round(ln(t) * 1000000) AS BIGINT)) AS c
    FROM (SELECT run, pos_, unnest(range(1, least(4, length(run) - pos_ + 1) + 1)) AS l FROM (SELECT run, unnest(range(1, length(run) + 1)) AS pos_ FROM runs)) s
    LEFT JOIN costs ON word = substring(run, pos_, l), total WHERE c IS NOT NULL OR l = 1) GROUP BY run, pos_),
way AS (SELECT run, length(run) + 1 AS pos_, [CAST(0 AS BIGINT)] AS best, CAST([] AS BIGINT[]) AS lens FROM runs
  UNION ALL
  SELECT run, pos_, list_prepend(s.c, best), list_prepend(-s.m, lens) FROM (
    SELECT w.run, e.pos_, best, lens, list_min(list_transform(e.e, lambda x: struct_pack(c := x.c + best[x.l], m := -x.l))) AS s
    FROM way w JOIN edges e ON e.run = w.run AND e.pos_ = w.pos_ - 1)),
walk AS (SELECT run, lens, CAST(1 AS BIGINT) AS pos_, CAST([] AS VARCHAR[]) AS words FROM way WHERE pos_ = 1
  UNION ALL
  SELECT run, lens, pos_ + lens[pos_], list_append(words, substring(run, pos_, lens[pos_])) FROM walk WHERE pos_ <= len(lens)),
known AS (SELECT run, words FROM walk WHERE pos_ = len(lens) + 1)
SELECT id, CAST(sum(coalesce(len(words), 1)) AS INTEGER) AS n_tokens, string_agg(coalesce(array_to_string(words, '/'), piece), '/' ORDER BY i) AS words
FROM pieces LEFT JOIN known ON piece = run GROUP BY id"""


@query("tokenize_cjk", CJK)
def tokenize_cjk(spark, sf):
    """Sentences in Han characters, segmented by the cheapest path."""
    lines = sentences(spark, sf).select("id", han(F.col("text")).alias("text")).where(F.length("text") > 0)
    out = sg.segment(lines, han_words(spark, sf))
    return out.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "/").alias("words"))
