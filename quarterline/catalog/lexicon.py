"""Lexicon scoring."""

from pyspark.sql import functions as F

from quarterline.catalog.base import (
    DIGITS, SCORED, TOKENISED, count_sql, query, r6, scored, texts,
    tokenised,
)
from quarterline.functions.tokens import latin_tokens
from quarterline.operators import lexicon as lx
from quarterline.operators.tone import centered_score
from quarterline.profiles import CountProfile, ToneProfile
from quarterline.session import stored

# Frequent words of the tables stand in for the sentiment vocabulary.
POSITIVE = ("the", "and", "in", "to", "is", "la", "que", "for", "was")
NEGATIVE = ("of", "a", "en", "der", "on", "it", "as", "die", "le")
PROFILE = ToneProfile(
    negators=("de", "no", "not", "un", "by"),
    improvers=("an", "er", "st", "with"),
    bad_context=("th", "on"),
    volume_up=("and", "in", "to"),
    price_topic=("that", "der", "que"),
    price_bad=("the", "and"),
    price_good=("of", "la", "die"),
)
COUNTS = CountProfile(
    negators=("de", "to", "un"),
    stopwords=("the", "la", "a"),
    reversal_phrases=("ed the", "on the", "de la"),
)


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def word_table(spark):
    rows = [(w, 1) for w in POSITIVE] + [(w, -1) for w in NEGATIVE]
    return spark.createDataFrame(rows, "word string, weight int")


@query(
    "tokenize",
    f"WITH {TOKENISED} SELECT id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS words FROM toks",
)
def tokenize(spark, sf):
    return tokenised(spark, sf).select(
        "id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("words")
    )


# every language's documents are one word sheet; the last sheet holding a word decides
SHEETS = """
sheets AS (
  SELECT CASE lang WHEN 'en' THEN 'My Positive list' WHEN 'fr' THEN 'NEG' WHEN 'de' THEN '政治' ELSE 'other' END AS sheet,
         CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS sheet_order, doc_id AS row,
         unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
lexicon AS (
  SELECT word, CAST(arg_max(CASE sheet WHEN 'NEG' THEN -1 ELSE 1 END, sheet_order) AS INTEGER) AS weight
  FROM sheets WHERE sheet <> 'other' AND word <> 'word' GROUP BY word)"""


def sheets(spark, sf):
    lang = F.col("lang")
    name = F.when(lang == "en", "My Positive list").when(lang == "fr", "NEG").when(lang == "de", "政治").otherwise("other")
    order = F.when(lang == "en", 1).when(lang == "fr", 2).when(lang == "de", 3).otherwise(4)
    docs = texts(spark, sf, "documents", "doc_id", "lang", "text")
    return docs.select(
        name.alias("sheet"), order.alias("sheet_order"), F.col("doc_id").alias("row"),
        F.explode(latin_tokens(F.col("text"))).alias("word"),
    )


@query("build_lexicon", f"WITH {SHEETS} SELECT word, weight FROM lexicon")
def build_lexicon(spark, sf):
    return lx.build_lexicon(sheets(spark, sf))


EXTRA_POSITIVE, EXTRA_NEGATIVE = ("qqpositive", "the", "la"), ("qqnegative", "of")


@query(
    "supplement_lexicon",
    f"""WITH {SHEETS}, extra AS (
  SELECT unnest({list(EXTRA_POSITIVE)}) AS word, 1 AS weight UNION ALL SELECT unnest({list(EXTRA_NEGATIVE)}), -1)
SELECT word, weight FROM lexicon UNION ALL
SELECT word, CAST(weight AS INTEGER) FROM extra WHERE word NOT IN (SELECT word FROM lexicon)""",
)
def supplement_lexicon(spark, sf):
    return lx.supplement_lexicon(lx.build_lexicon(sheets(spark, sf)), EXTRA_POSITIVE, EXTRA_NEGATIVE)


@query(
    "valid_unit",
    f"""WITH {TOKENISED}
SELECT id, CASE WHEN (length(text) > 0 AND {count_sql('text', DIGITS)} / length(text) > 0.5) OR len(tokens) = 0 THEN 0 ELSE 1 END AS valid,
       CASE WHEN length(text) > 0 AND {count_sql('text', DIGITS)} / length(text) > 0.15 THEN 1 ELSE 0 END AS is_numeric
FROM toks""",
)
def valid_unit(spark, sf):
    share = lx.digit_share(F.col("text"))
    return tokenised(spark, sf).select(
        "id",
        lx.valid_unit(F.col("text"), F.col("tokens")).alias("valid"),
        F.when((F.length("text") > 0) & (share > 0.15), 1).otherwise(0).alias("is_numeric"),
    )


ANCHORS = f"""{TOKENISED},
lex AS (SELECT unnest({list(POSITIVE)}) AS token, 1e0 AS weight UNION ALL SELECT unnest({list(NEGATIVE)}), -1e0),
hits AS (
  SELECT k.id, CAST(k.pos AS INTEGER) AS pos, k.token AS word, weight,
         CAST(coalesce(lag(k.pos) OVER (PARTITION BY k.id ORDER BY k.pos), -1) AS INTEGER) AS prev
  FROM tok k JOIN lex USING (token)),
a1 AS (
  SELECT h.*, t.tokens, CASE WHEN list_has_any(t.tokens, {list(PROFILE.price_topic)}) AND word IN {_list(PROFILE.price_bad)} THEN -1e0
    WHEN list_has_any(t.tokens, {list(PROFILE.price_topic)}) AND word IN {_list(PROFILE.price_good)} THEN 1e0 ELSE weight END AS topic
  FROM hits h JOIN toks t ON t.id = h.id),
a2 AS (
  SELECT *, CASE WHEN topic = 1 AND word IN {_list(PROFILE.volume_up)}
    AND len(list_filter(tokens[greatest(pos - 5, 0) + 1 : pos], lambda w: {_any('w', PROFILE.bad_context)})) > 0 THEN -1e0 ELSE topic END AS context
  FROM a1),
a3 AS (
  SELECT *, CASE WHEN context < 0 AND (list_has_any(tokens[pos + 2 : pos + 4], {list(PROFILE.improvers)})
    OR list_has_any(tokens[greatest(pos - 3, 0) + 1 : pos], {list(PROFILE.improvers)})) THEN context * 0.5e0 ELSE context END AS attenuated
  FROM a2),
a4 AS (
  SELECT *, CAST(len(list_filter(tokens[greatest(prev + 1, pos - 6) + 1 : pos], lambda w: w IN {_list(PROFILE.negators)})) AS INTEGER) AS negations
  FROM a3),
a5 AS (SELECT *, CASE WHEN negations % 2 = 1 THEN -attenuated ELSE attenuated END AS final FROM a4)"""


def anchor_steps(spark, sf, *columns):
    tone = lx.dict_tone(tokenised(spark, sf), word_table(spark), PROFILE)
    return tone.select("id", F.inline("scored")).select("id", "pos", "word", *columns)


@query("sentiment_anchors", f"WITH {ANCHORS} SELECT id, pos, word, weight, prev FROM hits")
def sentiment_anchors(spark, sf):
    rows = lx.with_hits(tokenised(spark, sf), word_table(spark))
    return rows.select("id", F.inline(lx.anchors())).select("id", "pos", "word", "weight", "prev")


@query(
    "sentiment_anchors_joined",
    f"WITH {ANCHORS} SELECT id // 2 AS id, pos, word, weight, prev FROM hits",
)
def sentiment_anchors_joined(spark, sf):
    """The way of large lexicons, with words listed twice (the larger weight holds) and ids that two sentences share."""
    twice = word_table(spark).unionByName(word_table(spark).withColumn("weight", F.col("weight") - 3))
    rows = lx.with_joined_hits(tokenised(spark, sf).withColumn("id", F.floor(F.col("id") / 2)), twice)
    return rows.select("id", F.inline(lx.anchors())).select("id", "pos", "word", "weight", "prev")


@query("topic_override", f"WITH {ANCHORS} SELECT id, pos, word, weight, topic FROM a1")
def topic_override(spark, sf):
    return anchor_steps(spark, sf, "weight", "topic")


@query("context_flip", f"WITH {ANCHORS} SELECT id, pos, word, topic, context FROM a2")
def context_flip(spark, sf):
    return anchor_steps(spark, sf, "topic", "context")


@query("improvement_attenuation", f"WITH {ANCHORS} SELECT id, pos, word, context, attenuated FROM a3")
def improvement_attenuation(spark, sf):
    return anchor_steps(spark, sf, "context", "attenuated")


@query("negation_flip", f"WITH {ANCHORS} SELECT id, pos, word, negations, final + 0e0 AS final FROM a5")
def negation_flip(spark, sf):
    return anchor_steps(spark, sf, "negations", "final")


DICT_TONE = f"""{ANCHORS},
sums AS (SELECT id, sum(final) AS s FROM a5 GROUP BY id),
dict AS (
  SELECT t.id, year, quarter, text, tokens,
    CASE WHEN (length(text) > 0 AND {count_sql('text', DIGITS)} / length(text) > 0.5) OR len(tokens) = 0 THEN 0 ELSE 1 END AS valid, s
  FROM toks t LEFT JOIN sums u ON u.id = t.id),
dict_tone AS (SELECT *, CASE WHEN valid = 1 THEN coalesce(s / len(tokens), 0e0) ELSE 0e0 END AS tone FROM dict)"""


@query(
    "dict_tone",
    f"WITH {DICT_TONE} SELECT id, round(tone, 6) + 0e0 AS dict_tone, valid AS is_valid_unit FROM dict_tone",
)
def dict_tone(spark, sf):
    tone = lx.dict_tone(tokenised(spark, sf), word_table(spark), PROFILE)
    return r6(tone.select("id", "dict_tone", "is_valid_unit"))


POS_NEG = f"""{TOKENISED},
counted AS (
  SELECT id, token, lag(token) OVER (PARTITION BY id ORDER BY pos) AS before FROM tok),
flags AS (
  SELECT id, token IN {_list(POSITIVE)} AS up, token IN {_list(NEGATIVE)} AS down,
         coalesce(before IN {_list(COUNTS.negators)}, false) AS negated, token NOT IN {_list(COUNTS.stopwords)} AS counts
  FROM counted),
tally AS (
  SELECT id, count(*) FILTER (WHERE counts) AS total,
         count(*) FILTER (WHERE counts AND ((up AND NOT negated) OR (down AND negated))) AS pos,
         count(*) FILTER (WHERE counts AND ((down AND NOT negated) OR (up AND negated))) AS neg
  FROM flags GROUP BY id),
shares AS (
  SELECT t.id, year, quarter, text,
    coalesce((pos + {' + '.join(f"CASE WHEN contains(text, '{p}') THEN 1 ELSE 0 END" for p in COUNTS.reversal_phrases)}) / greatest(total, 1), 0e0) AS "Pos",
    coalesce(neg / greatest(total, 1), 0e0) AS "Neg",
    CASE WHEN len(tokens) > 0 AND {count_sql('text', DIGITS)} / length(text) > 0.15 THEN 1 ELSE 0 END AS is_numeric
  FROM toks t LEFT JOIN tally y ON y.id = t.id),
net AS (SELECT *, "Neg" - "Pos" AS "Neg_net" FROM shares)"""


def net_rows(spark, sf):
    return lx.pos_neg_net(tokenised(spark, sf), POSITIVE, NEGATIVE, COUNTS)


@query(
    "pos_neg_net",
    f'WITH {POS_NEG} SELECT id, round("Pos", 6) AS "Pos", round("Neg", 6) AS "Neg", round("Neg_net", 6) + 0e0 AS "Neg_net", is_numeric FROM net',
)
def pos_neg_net(spark, sf):
    return r6(net_rows(spark, sf).select("id", "Pos", "Neg", "Neg_net", "is_numeric"))


@query(
    "dict_tone_by_period",
    f"""WITH {POS_NEG} SELECT year, quarter, round(avg("Pos"), 6) AS "Pos", round(avg("Neg"), 6) AS "Neg",
  round(avg("Neg_net"), 6) + 0e0 AS "Neg_net" FROM net GROUP BY ALL""",
)
def dict_tone_by_period(spark, sf):
    return r6(lx.mean_by_period(net_rows(spark, sf), ["Pos", "Neg", "Neg_net"]))


@query(
    "extreme_sentences",
    f"""WITH {POS_NEG},
low AS (SELECT id, "Neg_net", 'lowest' AS side FROM net ORDER BY "Neg_net", id LIMIT 3),
high AS (SELECT id, "Neg_net", 'highest' AS side FROM net ORDER BY "Neg_net" DESC, id LIMIT 3),
n AS (SELECT count(*) FILTER (WHERE "Neg_net" <> 0) AS nonzero, count(*) AS "rows" FROM net)
SELECT id, round("Neg_net", 6) + 0e0 AS "Neg_net", side, nonzero, "rows" FROM (SELECT * FROM low UNION ALL SELECT * FROM high), n""",
)
def extreme_sentences(spark, sf):
    rows = stored(net_rows(spark, sf).select("id", "Neg_net"))
    counts = lx.nonzero_count(rows, "Neg_net")
    ends = lx.extreme_rows(rows, "Neg_net", "id")
    return r6(
        ends.withColumns({c: counts.select(c).scalar() for c in ("nonzero", "rows")}), "Neg_net"
    )


@query(
    "centered_score_by_period",
    f"""WITH {SCORED} SELECT year, quarter, round(avg(neg_prob - 0.5e0), 6) + 0e0 AS tone_mean,
  round(quantile_cont(neg_prob - 0.5e0, 0.5), 6) + 0e0 AS tone_median, count(*) AS n_sentences
FROM scored WHERE neg_prob IS NOT NULL GROUP BY ALL""",
)
def centered_score_by_period(spark, sf):
    return r6(centered_score(scored(spark, sf), "neg_prob"))


