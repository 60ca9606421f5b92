"""Distributed order statistics against plain NumPy, with a third of the rows in one key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterline.functions import ranks as rk


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "key": rng.integers(0, 6, n), "value": rng.lognormal(0, 2, n)})
    pdf.loc[pdf.id % 3 == 0, "key"] = 99
    pdf.loc[(pdf.id % 3 == 0) & (pdf.id % 2 == 0), "value"] = 1.25  # a heavy tie
    pdf["pos"] = rng.permutation(n)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_quantiles(data, buckets):
    pdf, df = data
    probs = {"a": 0.1, "b": 0.5, "c": 0.975}
    got = rk.exact_quantiles(df, ["key"], "value", probs, buckets).toPandas().set_index("key")
    for key, g in pdf.groupby("key"):
        want = np.percentile(g.value, [10, 50, 97.5])
        assert np.allclose(got.loc[key, ["a", "b", "c"]].astype(float), want)
    whole = rk.exact_quantiles(df, [], "value", {"m": 0.5}, buckets).first().m
    assert whole == pytest.approx(pdf.value.median())


@pytest.mark.parametrize("trim", [0.0, 0.1, 0.49, 0.7])
def test_trimmed_mean(data, trim):
    pdf, df = data
    got = rk.trimmed_mean(df, ["key"], "value", trim, "m", 16).toPandas().set_index("key").m
    for key, g in pdf.groupby("key"):
        x = np.sort(g.value)
        k = int(trim * len(x)) if trim < 0.5 else 0
        assert got[key] == pytest.approx(x[k : len(x) - k].mean())


def test_trimmed_mean_small(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert rk.trimmed_mean(df, [], "v", 0.1, "m").first().m == 5.5


@pytest.mark.parametrize("chunk", [1, 10, 10_000])
def test_running(data, chunk):
    pdf, df = data
    out = rk.running_sum(df, ["key"], "pos", F.col("id"), "s", chunk=chunk)
    marked = F.when(F.col("id") % 5 == 0, F.col("id"))
    out = rk.running_last(out, ["key"], "pos", marked, "upto", chunk=chunk)
    out = rk.running_last(out, ["key"], "pos", marked, "before", chunk=chunk, include_current=False)
    got = out.toPandas().sort_values(["key", "pos"]).reset_index(drop=True)
    want = pdf.sort_values(["key", "pos"]).reset_index(drop=True)
    by = want.groupby("key")
    assert (got.s == by.id.cumsum()).all()
    mark = want.id.where(want.id % 5 == 0)
    upto = mark.groupby(want.key).ffill()
    before = mark.groupby(want.key).shift().groupby(want.key).ffill()
    pd.testing.assert_series_equal(got.upto, upto, check_names=False, check_dtype=False)
    pd.testing.assert_series_equal(got.before, before, check_names=False, check_dtype=False)


def test_hash_ranks(data):
    pdf, df = data
    a = rk.hash_ranks(df, ["key"], "id", 42).toPandas()
    b = rk.hash_ranks(df.repartition(11), ["key"], "id", 42).toPandas()
    for _, g in a.groupby("key"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
    left, right = (x.set_index("id")["rank"].sort_index() for x in (a, b))
    assert (left == right).all()
    other = rk.hash_ranks(df, ["key"], "id", 43).toPandas().set_index("id")["rank"].sort_index()
    assert (left != other).any()


def test_ordered_offsets(spark):
    df = spark.createDataFrame([(f"r{i:03d}", i) for i in range(200)], "name string, n int").repartition(6)
    got = rk.ordered_offsets(df, "name", F.col("n"), "o").orderBy("name").toPandas()
    assert (got.o == got.n.cumsum() - got.n).all()


def test_one_value_of_most_rows_leaves_the_ranges_to_the_others(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 1000 == 0, F.col("id") / 7.0).otherwise(0.0).alias("v"))
    distinct = rows.groupBy("v").count()
    used = rk.with_value_bucket(distinct, "v", "b").where("v > 0").select("b").distinct().count()
    assert used >= 100
    got = rk.exact_quantiles(rows, [], "v", {"q": 0.9995}).first().q
    values = sorted(r.v for r in rows.collect())
    at = 0.9995 * (len(values) - 1)
    low = int(at)
    assert got == pytest.approx(values[low] + (values[low + 1] - values[low]) * (at - low))
