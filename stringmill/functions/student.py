"""Tail probability of Student's t, applied to the few rows left after aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALTERNATIVES = ("two-sided", "less", "greater")


def alternative_name(name: str) -> str:
    """Both spellings of the two-sided alternative are accepted."""
    name = name.lower().replace("_", "-")
    if name not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}, not {name!r}")
    return name


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""

    def kept(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > 1e-300, v, 1e-300)

    d, c = 1.0 / kept(1.0 - (a + b) * x / (a + 1.0)), np.ones_like(x)
    value = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / kept(1.0 + numerator * d)
            c = kept(1.0 + numerator / c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return value


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """``lgamma(a + 1/2) - lgamma(a)``: asymptotic from 100 on, brought there by the recurrence."""
    moved = np.where(a < 100.0, a + 100.0, a)
    far = 0.5 * np.log(moved) - 1.0 / (8.0 * moved) + 1.0 / (192.0 * moved**3)
    near = np.log1p(0.5 / (a[:, None] + np.arange(100.0))).sum(axis=1)
    return np.where(a < 100.0, far - near, far)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z): a series of positive terms near the middle, a continued fraction in the tail."""
    x = np.abs(z) / math.sqrt(2.0)
    small = np.minimum(x, 2.5)
    term = total = small
    for n in range(1, 120):
        term = term * 2.0 * small * small / (2 * n + 1)
        total = total + term
    middle = 1.0 - 2.0 / math.sqrt(math.pi) * np.exp(-small * small) * total
    large, fraction = np.maximum(x, 2.5), np.zeros_like(x)
    for n in range(120, 0, -1):
        fraction = n / 2.0 / (large + fraction)
    tail = np.exp(-large * large) / (math.sqrt(math.pi) * (large + fraction))
    half = 0.5 * np.where(x < 2.5, middle, tail)
    return np.where(z > 0, half, 1.0 - half)


def upper_tail(t: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """P(T > t) for df degrees of freedom, for all values at once."""
    t, df = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (t, df))
    result = np.full(t.shape, np.nan)
    known = ~np.isnan(t) & ~np.isnan(df) & (df > 0)
    ends = known & np.isinf(t)
    result[ends] = np.where(t[ends] > 0, 0.0, 1.0)
    # normal tail with the first-order correction; the error is of order 1 / df^2
    far = known & ~ends & (df > 1e6)
    result[far] = _normal_tail(t[far] * (1.0 - 0.25 / df[far]) / np.sqrt(1.0 + t[far] ** 2 / (2.0 * df[far])))
    inner = known & ~ends & ~far
    result[inner] = _beta_tail(t[inner], df[inner])
    return result


def _beta_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    a, square = df / 2.0, t * t / df
    x, rest = 1.0 / (1.0 + square), square / (1.0 + square)
    with np.errstate(divide="ignore"):
        front = np.exp(
            _log_gamma_step(a) - 0.5 * math.log(math.pi) - a * np.log1p(square) + 0.5 * np.log(rest)
        )
    direct, half = x < (a + 1.0) / (a + 2.5), np.full(a.shape, 0.5)
    first, second = np.where(direct, a, half), np.where(direct, half, a)
    part = front * _beta_fraction(first, second, np.where(direct, x, rest)) / first
    both = np.where(direct, part, 1.0 - part)
    return np.where(t > 0, both / 2.0, 1.0 - both / 2.0)


@F.pandas_udf(T.DoubleType())
def _upper_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(upper_tail(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def t_p_value(t: Column, df: Column, alternative: Column) -> Column:
    """p-value; ``alternative`` is a column holding two-sided, less or greater."""
    above = _upper_tails(t, df)
    two = F.lit(2.0) * F.least(above, F.lit(1.0) - above)
    p = (
        F.when(alternative == "greater", above)
        .when(alternative == "less", F.lit(1.0) - above)
        .otherwise(two)
    )
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(t), p)
