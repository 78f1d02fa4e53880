"""Student's t distribution with real degrees of freedom, in vectorised numpy.

The cumulative distribution is a regularised incomplete beta function, evaluated by Lentz's continued
fraction; quantiles are found by bisection. Used on result frames that hold one row a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d, c = 1 / guard(1 + step * d), guard(1 + step / c)
            delta = c * d
            out *= delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    y = np.clip(y, 0, 1)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y > 0, front * _fraction(p, q, y), 0.0)
    return np.where(swap, 1 - value, value)


def two_sided_p(t, dof) -> np.ndarray:
    """P(|T| >= |t|)."""
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def quantile(p: float, dof) -> np.ndarray:
    """The value that T is below with probability ``p`` of at least a half."""
    dof = np.asarray(dof, dtype=float)
    low, high = np.zeros_like(dof), np.ones_like(dof)
    for _ in range(200):
        short = 1 - two_sided_p(high, dof) / 2 < p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(200):
        middle = (low + high) / 2
        below = 1 - two_sided_p(middle, dof) / 2 < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _defined(f, *series: pd.Series) -> pd.Series:
    frame = pd.concat(series, axis=1).astype(float)
    good = frame.notna().all(axis=1) & (frame.iloc[:, -1] > 0)
    out = pd.Series(np.nan, index=frame.index)
    if good.any():
        out[good] = f(*(frame.loc[good].iloc[:, k].to_numpy() for k in range(frame.shape[1])))
    return out.where(out.notna(), None)


def p_value(t: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _defined(two_sided_p, a, b)

    return run(t, dof)


def t_quantile(p: float, dof: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return _defined(lambda d: quantile(p, d), a)

    return run(dof)
