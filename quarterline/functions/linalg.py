"""Small dense algebra on aggregated cross-products (at most a dozen regressors)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAY = T.ArrayType(T.DoubleType())


def _square(flat) -> np.ndarray:
    a = np.asarray(flat, dtype=float)
    k = math.isqrt(len(a))
    return a.reshape(k, k)


#: A column whose part not explained by the columns before it is below this share is redundant.
REDUNDANT = 1e-11


def ordered_inverse(m: np.ndarray) -> np.ndarray | None:
    """Inverse over the columns that are not redundant given those before them.

    Redundant and constant columns have zero rows and columns. NULL where a cell isn't finite.
    """
    if not np.isfinite(m).all():
        return None
    scale = np.sqrt(np.abs(np.diag(m)))
    kept = []
    for j in range(len(m)):
        if scale[j] == 0:
            continue
        own = m[np.ix_([*kept, j], [*kept, j])] / np.outer(scale[[*kept, j]], scale[[*kept, j]])
        rest = own[-1, -1] - own[-1, :-1] @ np.linalg.solve(own[:-1, :-1], own[:-1, -1]) if kept else own[-1, -1]
        if rest > REDUNDANT:
            kept.append(j)
    out = np.zeros_like(m)
    if kept:
        size = np.outer(scale[kept], scale[kept])
        out[np.ix_(kept, kept)] = np.linalg.inv(m[np.ix_(kept, kept)] / size) / size
    return out


@F.pandas_udf(ARRAY)
def inverse(flat: pd.Series) -> pd.Series:
    """``ordered_inverse`` of a row-major square matrix, row-major."""

    def one(a):
        m = None if a is None else ordered_inverse(_square(a))
        return None if m is None else m.ravel()

    return flat.map(one)


@F.pandas_udf(ARRAY)
def sandwich_se(inv: pd.Series, meat: pd.Series, means: pd.Series) -> pd.Series:
    """Standard errors from inv * meat * inv of a design with centred regressors.

    ``means`` are the regressors' means; the first error is that of the constant of the design
    as it was. NULL for redundant columns.
    """

    def one(a, s, m):
        if a is None or s is None:
            return None
        bread = _square(a)
        v = bread @ _square(s) @ bread
        back = np.eye(len(bread))
        back[0, 1:] = -np.asarray(m, float)
        v = np.diag(back @ v @ back.T)
        return [float(np.sqrt(max(x, 0.0))) if d > 0 else None for x, d in zip(v, np.diag(bread))]

    return pd.Series([one(a, s, m) for a, s, m in zip(inv, meat, means)], dtype=object)


@F.pandas_udf(ARRAY)
def subset_rss(gram: pd.Series, chosen: pd.Series) -> pd.Series:
    """Residual sums of squares of models from one centred Gram matrix whose last row and column
    belong to the response; ``chosen`` lists the regressors' places of each model.

    Eliminating the regressors (a Cholesky factor) leaves the sum in the response's diagonal cell;
    redundant regressors are left to least squares.
    """

    def one(a, sets):
        if a is None:
            return None
        m = _square(a)
        out = []
        for s in sets:
            at = [*[int(i) for i in s], len(m) - 1]
            part = m[np.ix_(at, at)]
            try:
                out.append(float(np.linalg.cholesky(part)[-1, -1] ** 2))
            except np.linalg.LinAlgError:
                b = np.linalg.lstsq(part[:-1, :-1], part[:-1, -1], rcond=None)[0]
                out.append(float(max(0.0, part[-1, -1] - part[:-1, -1] @ b)))
        return np.asarray(out)

    return pd.Series([one(a, s) for a, s in zip(gram, chosen)])


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t: I_x(df/2, 1/2) at x = df/(df+t^2)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    a, b = df / 2.0, np.full_like(df, 0.5)
    x, rest = df / (df + t * t), t * t / (df + t * t)
    lg = np.vectorize(math.lgamma, otypes=[float])
    logs = a * np.log(x) + b * np.log(np.maximum(rest, 1e-300))
    front = np.exp(lg(a + b) - lg(a) - lg(b) + logs)
    swap = x >= (a + 1.0) / (a + b + 2.0)
    direct = front * _beta_fraction(a, b, np.where(swap, 0.5, x)) / a
    mirrored = 1.0 - front * _beta_fraction(b, a, np.where(swap, rest, 0.5)) / b
    return np.clip(np.where(swap, mirrored, direct), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = student_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out
