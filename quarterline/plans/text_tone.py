"""Pages to quarterly indicators in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.text import add_once
from quarterline.functions.tokens import explode_tokens, filter_tokens
from quarterline.operators import corpus, lexicon, textprep, tone, weak

from quarterline.profiles import (
    TONE_RULES, TOPIC_WORDS, ZH, ZH_TONE, TextProfile, ToneProfile, ToneRules,
)
from quarterline.session import checkpoint, stored


def scored_sentences(
    sentences: DataFrame, tokens: Column, words: DataFrame, profile: ToneProfile = ZH_TONE
) -> DataFrame:
    """Valid sentences with tokens and lexicon tone."""
    scored = lexicon.dict_tone(add_once(sentences, {"tokens": tokens}), words, profile)
    return scored.where("is_valid_unit = 1").drop("scored")


def trained(scored: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Token weights fitted to the first nine tenths of the balanced sample, and the last tenth."""
    labels = weak.balanced_sample(weak.weak_labels_sign(scored), "id", "label", seed)
    split = weak.train_eval_split(labels)
    weights = checkpoint(weak.token_weights(split.where("split = 'train'"), with_counts=True))
    return weights, split.where("split = 'eval'")


def classified(scored: DataFrame, seed: int = 42) -> DataFrame:
    """Train the classifier on balanced weak labels and score every sentence.

    Sampling and scoring each read the sentences, so they are stored first.
    """
    scored = stored(scored)
    return weak.score_sentences(trained(scored, seed)[0], scored)


def classifier_metrics(scored: DataFrame, seed: int = 42) -> DataFrame:
    """Accuracy and F1 on the tenth of the balanced sample that was not trained on."""
    weights, held = trained(stored(scored), seed)
    found = weak.score_sentences(weights, held)
    return weak.binary_metrics(found.withColumn("p", (F.col("neg_prob") >= 0.5).cast("int")), "label", "p")


def indicators(
    sentences: DataFrame, stopwords: DataFrame | None = None, topic_words=None,
    profile: TextProfile = ZH, rules: ToneRules = TONE_RULES,
) -> DataFrame:
    """Quarterly tone, similarity and readability from classified sentences
    (``id, year, quarter, text, tokens, neg_prob``). Rows without period or text are left out
    first; the scored rows are then fixed once, for every step that reads them."""
    sentences = checkpoint(sentences.dropna(subset=[*corpus.PERIOD, "text"]))
    weighted = tone.topic_scores(sentences, words=topic_words or TOPIC_WORDS)
    weighted = tone.raw_weights(tone.top_topics(weighted, rules), rules)
    quarterly = tone.quarterly_tone(weighted, rules=rules)
    docs = corpus.readability(corpus.document_rollup(sentences, profile=profile))
    terms = corpus.term_counts(filter_tokens(explode_tokens(sentences, corpus.PERIOD), stopwords))
    similar = corpus.similarity_prev(terms, docs)
    flagged = corpus.period_continuity(docs.join(similar, list(corpus.PERIOD)))
    strict = corpus.strict_gap_null(flagged)
    return corpus.overwrite_columns(
        quarterly,
        strict,
        corpus.PERIOD,
        ["similarity_prev", "surprise_prev", "avg_sent_len", "avg_sent_len_rows", "prev_quarter_available"],
    )


def pages_to_sentences(pages: DataFrame, profile: TextProfile = ZH) -> DataFrame:
    """Numbered sentences with year and quarter read from the report id."""
    from quarterline.functions.coerce import period_from_text

    year, quarter = period_from_text(F.col("report_id"))
    return textprep.report_sentences(pages, profile).withColumns({"year": year, "quarter": quarter})
