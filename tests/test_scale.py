"""Steps that must not move or sort wide rows, and their sums for any split of the work."""

import contextlib
import io
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarterline.catalog import lexicon, weak as weak_queries
from quarterline.functions.tokens import array_key, token_sums
from quarterline.operators import regress, topics, weak

ROWS = [
    (1, ["a", "b", "a"]), (2, ["a", "b", "a"]), (3, ["b"]), (4, ["zz"]), (5, []), (6, None), (None, ["c", "d", "b"]), (None, ["c", "d", "b"]),
]
WEIGHTS = {"a": ("0.100000001", 9), "b": ("-2.000000003", 5), "c": ("3.333333333", 2), "d": ("0.700000000", 1)}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("head", [1, 2, 3, 100])
def test_token_sums_are_exact_for_any_head(spark, head):
    rows = spark.createDataFrame(ROWS, "id long, tokens array<string>").withColumn("k", array_key("tokens"))
    listed = [(t, Decimal(w), n) for t, (w, n) in WEIGHTS.items()]
    weights = spark.createDataFrame(listed, "token string, w decimal(20,9), n long")
    sums = token_sums(rows, weights, ["w"], "k", "tokens", head)
    assert dict(sums.dtypes)["w"] == "decimal(30,9)"  # a wider one loses decimals in sums
    assert sums.count() == sums.select("k").distinct().count()
    got = rows.join(sums, "k", "left").select("id", "tokens", "w").collect()
    assert len(got) == len(ROWS)
    for r in got:
        known = [Decimal(WEIGHTS[t][0]) for t in r.tokens or [] if t in WEIGHTS]
        assert r.w == (sum(known) if known else None)


def test_scores_look_weights_up_where_the_sentences_are(spark):
    weights = spark.createDataFrame([("a", Decimal("1.5"), 3)], "token string, weight decimal(20,9), n long")
    rows = spark.createDataFrame(ROWS, "id long, tokens array<string>")
    assert "BroadcastHashJoin" in plan(weak.score_sentences(weights, rows).select("id", "neg_prob"))
    vectors = weights.select("token", F.col("weight").alias("t"), "n")
    priors = spark.createDataFrame([(Decimal("0.5"),)], "t decimal(20,9)")
    assert "BroadcastHashJoin" in plan(topics.learned_scores(rows, vectors, priors, ["t"]).select("id", "score_t"))


def test_robust_errors_sum_numbers_only(spark):
    rows = spark.range(200).select(
        (F.col("id") % 2).alias("g"), (F.col("id") * 1.0).alias("y"), (F.col("id") % 7 * 1.0).alias("x")
    )
    text = plan(regress.ols_hc1(rows, "y", ["x"], ["g"]))
    assert "SortAggregate" not in text and "SortMergeJoin" not in text


def test_sentences_are_scored_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", "The end of it. On and on.")], "doc_id long, source string, lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert "regexp_extract_all" not in plan(lexicon.extreme_sentences(spark, str(tmp_path)))
    assert plan(weak_queries.toned(spark, str(tmp_path))).count("regexp_extract_all(lower(") <= 1 + plan(
        weak_queries.sentences(spark, str(tmp_path)).select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    ).count("regexp_extract_all(lower(")
