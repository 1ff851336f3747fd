"""Probability that a node is dead, from the gamma posterior of its announce rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prior (alpha, beta in seconds) and the up/down rates of the stationary model (fixed values).
PRIOR_ALPHA, PRIOR_BETA = 1.0, 1800.0
RATE_DOWN, RATE_UP = 2.3589191441985017e-06, 4.121957095269658e-05


_SOLVED: dict[tuple[float, float], float] = {}


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    from math import lgamma

    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    lead = np.where(x > 0, np.exp(a * np.log(np.where(x > 0, x, 1)) - x - np.vectorize(lgamma, otypes=[float])(a)), 0.0)
    low = x < a + 1
    term = 1 / a
    total, n = term.copy(), a.copy()
    for _ in range(3000):
        n = n + 1
        term = term * x / n
        total = total + np.where(low, term, 0)
        if not (low & (term > total * 1e-17)).any():
            break
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full_like(x, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 3000):
        k = -i * (i - a)
        b = b + 2
        d = k * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + k / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = np.where(low, h, h * step)
        if not (~low & (np.abs(step - 1) > 1e-16)).any():
            break
    return np.clip(np.where(low, lead * total, 1 - lead * h), 0, 1)


def unit_gamma_ppf(p: float, alpha: np.ndarray) -> np.ndarray:
    """Quantile of the gamma distribution with rate 1, by bisection; NaN where alpha is not positive."""
    alpha = np.asarray(alpha, dtype=float)
    ok = np.isfinite(alpha) & (alpha > 0)
    a = np.where(ok, alpha, 1.0)
    lo, hi = np.zeros_like(a), a + 40 * np.sqrt(a) + 40
    for _ in range(64):
        mid = (lo + hi) / 2
        below = gamma_cdf(a, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.where(ok, (lo + hi) / 2, np.nan)


def unit_quantile(p: float, alpha: Column) -> Column:
    """The quantile per row; a batch solves each distinct alpha once."""

    def run(s: pd.Series) -> pd.Series:
        values, back = np.unique(s.to_numpy(dtype=float), return_inverse=True)
        new = np.array([v for v in values if (p, v) not in _SOLVED])
        if len(_SOLVED) > 200_000:
            _SOLVED.clear()
        _SOLVED.update(zip([(p, v) for v in new], unit_gamma_ppf(p, new)))
        return pd.Series(np.array([_SOLVED[p, v] if v == v else np.nan for v in values])[back])

    return F.pandas_udf(run, "double")(alpha.cast("double"))


def pi_down(dt: Column) -> Column:
    total = RATE_DOWN + RATE_UP
    return F.when(dt <= 0, 0.0).otherwise(F.lit(RATE_DOWN / total) * (1 - F.exp(-total * dt)))


def dead_given_rate(rate: Column, dt: Column) -> Column:
    """P(dead) when announces come at a known rate and none came for dt seconds."""
    pi, silent = pi_down(dt), F.exp(-rate * dt)
    return F.when(pi + (1 - pi) * silent > 0, pi / (pi + (1 - pi) * silent)).otherwise(F.lit(1.0))


def dead_interval(alpha: Column, beta: Column, dt: Column, ci: float = 0.90) -> tuple[Column, Column]:
    """Credible interval (low, high) of P(dead); null parameters take the prior; dt is at least 0."""
    if not 0 < ci < 1:
        raise ValueError("ci must lie between 0 and 1")
    a, b = F.coalesce(alpha, F.lit(PRIOR_ALPHA)), F.coalesce(beta, F.lit(PRIOR_BETA))
    dt = F.greatest(dt, F.lit(0.0))
    q = (1 - ci) / 2
    ends = [F.least(F.greatest(dead_given_rate(F.greatest(unit_quantile(p, a) / b, F.lit(0.0)), dt), F.lit(0.0)), F.lit(1.0)) for p in (q, 1 - q)]
    return F.least(*ends), F.greatest(*ends)


def prior_quantile(p: float, beta: Column) -> Column:
    """Closed form for alpha 1."""
    return -F.log(F.lit(1 - p)) / beta


def alive_text(low: Column, high: Column) -> Column:
    """Chance of being alive in per cent, as a range where the interval is wide."""
    a, b = F.format_string("%.0f", (1 - high) * 100), F.format_string("%.0f", (1 - low) * 100)
    return F.when(high - low >= 0.01, F.concat(a, F.lit("-"), b, F.lit("%"))).otherwise(F.concat(b, F.lit("%")))


def status_icon(low: Column, high: Column) -> Column:
    return F.when(low >= 0.9, "dead").when(high <= 0.1, "alive").otherwise("unknown")
