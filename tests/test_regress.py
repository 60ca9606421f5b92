"""Regressions against NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterline.functions.linalg import student_two_sided
from quarterline.operators import regress as rg


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    frames = []
    for key, n in (("a", 120), ("b", 40)):
        x = rng.normal(size=(n, 2)) + [0, 3]
        u = np.convolve(rng.normal(size=n + 3), [1, 0.5, 0.3, 0.1])[3 : n + 3] * (1 + np.abs(x[:, 0]))
        frames.append(
            pd.DataFrame({"key": key, "t": np.arange(n), "x": x[:, 0], "z": x[:, 1], "y": 1 + 2 * x[:, 0] - x[:, 1] + u})
        )
    return pd.concat(frames, ignore_index=True)


def numpy_fit(g, lags=None):
    X = np.column_stack([np.ones(len(g)), g.x, g.z])
    y = g.y.to_numpy()
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    u = y - X @ beta
    v = X * u[:, None]
    S = v.T @ v
    for ell in range(1, (lags or 0) + 1):
        G = v[ell:].T @ v[:-ell]
        S += (1 - ell / (lags + 1)) * (G + G.T)
    if lags is None:
        S *= len(g) / (len(g) - 3)
    r2 = 1 - u @ u / ((y - y.mean()) ** 2).sum()
    return beta, np.sqrt(np.diag(inv @ S @ inv)), r2, u


@pytest.mark.parametrize("lags", [None, 4])
def test_robust_errors(spark, rows, lags):
    df = spark.createDataFrame(rows).repartition(5)
    args = (df, "y", ["x", "z"])
    out = rg.ols_hc1(*args, ["key"]) if lags is None else rg.newey_west(*args, ["t"], ["key"], lags)
    got = out.toPandas()
    for key, g in rows.groupby("key"):
        beta, se, r2, _ = numpy_fit(g, lags)
        part = got[got.key == key].set_index("term").loc[["const", "x", "z"]]
        assert np.allclose(part.beta, beta) and np.allclose(part.se, se)
        assert np.allclose(part.r2, r2) and (part.df == len(g) - 3).all()
        assert np.allclose(part.p, student_two_sided(part.t, part.df))


def test_single_model_and_residuals(spark, rows):
    df = spark.createDataFrame(rows[rows.key == "a"])
    got = rg.newey_west(df, "y", ["x", "z"], ["t"]).toPandas().set_index("term")
    beta, se, _, u = numpy_fit(rows[rows.key == "a"], 4)
    assert np.allclose(got.loc[["const", "x", "z"], "se"], se)
    resid = rg.with_residuals(df, rg.fit(df, "y", ["x", "z"]), "y", ["x", "z"]).toPandas()
    assert np.allclose(resid.sort_values("t").resid, u)
    shocks, report = rg.residual_shocks(
        df.withColumns({"year": F.col("t"), "quarter": F.lit(1)}), "y", ["x"]
    )
    one = report.first()
    s = shocks.orderBy("t").toPandas().shock_raw.to_numpy()
    assert one.n_used == 119 and one.dw == pytest.approx((np.diff(s) ** 2).sum() / (s**2).sum())
    assert np.allclose(shocks.orderBy("t").toPandas().shock_z, s / s.std())


def test_singular_and_small(spark, rows):
    df = spark.createDataFrame(rows).withColumn("same", F.col("x") * 2)
    got = rg.ols_hc1(df, "y", ["x", "same"], ["key"]).toPandas()
    assert (got.beta.isna() == (got.term == "same")).all() and (got.n > 0).all()
    got = rg.ols_hc1(df, "y", ["x"], ["key"], min_n=50).toPandas()
    assert got[got.key == "b"].beta.isna().all() and got[got.key == "a"].beta.notna().all()


def test_student():
    # two-sided 5 percent points of Student's t
    for df, t in ((1, 12.706205), (5, 2.570582), (30, 2.042272), (1000, 1.962339)):
        assert student_two_sided([t], [df])[0] == pytest.approx(0.05, abs=1e-6)
    assert student_two_sided([0.0, 1e6], [7, 7]) == pytest.approx([1.0, 0.0], abs=1e-12)


def test_midas(spark):
    x = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(2000 + i // 4, i % 4 + 1, v) for i, v in enumerate(x)], "year int, quarter int, x double")
    got = [r.midas for r in rg.midas_term(df, "x", 3, (0.2, -0.1)).orderBy("year", "quarter").collect()]
    w = [math.exp(0.2 * j - 0.1 * j * j) for j in range(3)]
    want = [sum(w[j] * x[i - j] for j in range(min(3, i + 1))) / sum(w[: min(3, i + 1)]) for i in range(4)]
    assert got == pytest.approx(want)


def test_midas_search(spark):
    rng = np.random.default_rng(1)
    q = pd.DataFrame({"year": 2000 + np.arange(20) // 4, "quarter": np.arange(20) % 4 + 1, "x": rng.normal(size=20)})
    days = q.loc[q.index.repeat(15)].assign(r=lambda d: rng.normal(size=len(d)))
    grid = [(a / 2, b / 5) for a in range(-1, 2) for b in range(-1, 2)]
    got = rg.midas_weight_search(spark.createDataFrame(days), spark.createDataFrame(q), "r", "x", grid).first()
    ssr = {}
    for a, b in grid:
        w = np.exp(a * np.arange(8) + b * np.arange(8) ** 2)
        term = np.array([(w[: i + 1] * q.x[i::-1][:8]).sum() / w[: i + 1].sum() if i < 8 else (w * q.x[i:i - 8:-1]).sum() / w.sum() for i in range(20)])
        X = np.column_stack([np.ones(300), np.repeat(term, 15)])
        ssr[a, b] = np.linalg.lstsq(X, days.r**2, rcond=None)[1][0]
    best = min(ssr, key=ssr.get)
    assert (got.theta1, got.theta2) == best and got.ssr == pytest.approx(ssr[best])


def test_projection_keeps_empty_models(spark):
    dates = pd.date_range("2020-01-01", periods=60).date
    pdf = pd.DataFrame({"s": "F", "date": dates, "r": 0.1, "e": 1, "k": 1.0, "c": None})
    df = spark.createDataFrame(pdf, "s string, date date, r double, e int, k double, c double")
    got = rg.local_projections(df, "s", "r", "e", ["k"], ["c"], [0, 1]).toPandas()
    assert len(got) == 2 and (got.nobs == 0).all() and got.beta.isna().all()


def test_clean_regressors(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, float("nan"), 5.0), (None, 1.0, 5.0)], "y double, a double, b double")
    out = rg.clean_regressors(df, "y", ["a", "b"])
    assert out.columns == ["y", "a"] and sorted(r.a for r in out.collect()) == [0.0, 2.0]
    rows = rg.event_regression_rows(df.withColumn("date", F.current_date()), "y", ["a"], ["rate"])
    assert rows.count() == 1 and rows.first().y == 100.0


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e9])
def test_large_means_keep_their_digits(spark, mean):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 2000)
    rows = [(float(mean + a), float(1 + 2 * a + e)) for a, e in zip(x, rng.normal(0, 0.01, 2000))]
    df = spark.createDataFrame(rows, "x double, y double")
    for table in (rg.ols(df, "y", ["x"]), rg.ols_hc1(df, "y", ["x"])):
        got = {r.term: r for r in table.collect()}
        assert got["x"].beta == pytest.approx(2, abs=2e-3) and 1e-4 < got["x"].se < 4e-4 and got["x"].r2 > 0.999


def test_constant_and_redundant_regressors_are_left_out(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(5, 1, 500), rng.normal(0, 1, 500)
    y = 1 + 2 * x - z + rng.normal(0, 0.1, 500)
    rows = [(float(a), 3.0, float(2 * a + 1), float(b), float(c)) for a, b, c in zip(x, z, y)]
    df = spark.createDataFrame(rows, "x double, k double, twice double, z double, y double")
    plain = {r.term: r for r in rg.ols_hc1(df, "y", ["x", "z"]).collect()}
    for fit in (rg.ols_hc1, rg.ols):
        got = {r.term: r for r in fit(df, "y", ["x", "k", "twice", "z"]).collect()}
        assert got["k"].beta is None and got["twice"].beta is None and got["x"].df == 497
        for t in ("const", "x", "z"):
            assert got[t].beta == pytest.approx(plain[t].beta)
    assert {t: r.se for t, r in ((t, got[t]) for t in ("x",))}["x"] > 0
    hc = {r.term: r for r in rg.ols_hc1(df, "y", ["x", "k", "twice", "z"]).collect()}
    assert all(hc[t].se == pytest.approx(plain[t].se) for t in plain)
