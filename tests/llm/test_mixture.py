"""Poisson replication: mean rates, defined cases."""

import math

import pytest
from pyspark.sql import functions as F

from quarterline.llm import mixture


def test_cdf_is_the_poisson_distribution(spark):
    for lam in (0.05, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(mixture.poisson_cdf(F.lit(lam)).alias("c")).first().c
        k = int(lam)
        p = sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k + 1))
        assert cdf[k] == pytest.approx(p, rel=1e-9) and cdf[-1] == pytest.approx(1, abs=1e-9)


def test_shares_follow_the_weights(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 4500, "a").otherwise("b").alias("source")
    )
    out, names = mixture.mix(docs, weights={"a": 1.0, "b": 3.0})
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(got["a"] - 1500) < 150 and abs(got["b"] - 4500) < 250
    places = [r[names["place"]] for r in out.collect()]
    assert places == sorted(places) and len(set(places)) == len(places)
    again, _ = mixture.mix(docs.repartition(5), weights={"a": 1.0, "b": 3.0})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_cases(spark):
    rows = [(1, "x", None, 1, "c"), (1, "x", None, 1, "c"), (None, None, "s", 2, "d"), (None, "y", "s", 3, "e")]
    docs = spark.createDataFrame(rows * 5, "doc_id long, text string, source string, __copy int, RATE string")
    out, names = mixture.mix(docs)
    assert out.columns[:5] == docs.columns and len(set(map(str.lower, out.columns))) == len(out.columns)
    per = {}
    for r in out.collect():
        per.setdefault((r.doc_id, r.text), set()).add(r[names["copies"]])
    assert all(len(v) == 1 for v in per.values())
    assert mixture.mix(docs.limit(0))[0].count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
