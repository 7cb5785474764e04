"""Statistics of short series (one number per month or day of a book) on the driver.

The series come from aggregations, so their length is bounded by the
calendar, not by the data.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

EULER = 0.5772156649015329
_NORMAL = NormalDist()


def clean(x) -> np.ndarray:
    a = np.array([np.nan if v is None else v for v in x], float)
    return a[~np.isnan(a)]


def autocovariance(d: np.ndarray, lag: int) -> float:
    return float(d[lag:] @ d[: len(d) - lag])


def hac_t(x, lags: int) -> float | None:
    """Newey-West t of the mean with Bartlett weights; None under 3 values or without variance."""
    a = clean(x)
    n = len(a)
    if n < 3:
        return None
    d = a - a.mean()
    if autocovariance(d, 0) == 0:
        return None
    top = min(max(lags, 0), n - 1)
    weights = [1.0] + [2 * (1 - k / (top + 1)) for k in range(1, top + 1)]
    long_run = sum(w * autocovariance(d, k) for k, w in enumerate(weights)) / n
    return float(a.mean() / math.sqrt(max(long_run, 1e-18) / n))


def lag_rule(horizon: float, sampling: float, x=None, most: int = 24) -> int:
    """Overlap lags, raised to the run of positive autocorrelations of the series; at most ``most``."""
    base = math.ceil(horizon / sampling)
    a = clean(x) if x is not None else np.empty(0)
    if len(a) > 8:
        d = a - a.mean()
        whole = autocovariance(d, 0)
        if whole > 0:
            run = 0
            while run < min(most, len(a) // 3) and autocovariance(d, run + 1) > 0:
                run += 1
            base = max(base, run)
    return min(base, most)


def best_of_null(trials: int) -> float:
    """Expected largest of so many standard normal draws (two-term approximation)."""
    if trials <= 1:
        return 0.0
    return (1 - EULER) * _NORMAL.inv_cdf(1 - 1 / trials) + EULER * _NORMAL.inv_cdf(1 - 1 / (trials * math.e))


def deflated_t(t: float, trials: int, two_sided: bool = True) -> dict:
    ceiling = best_of_null(2 * trials if two_sided else trials)
    margin = abs(t) - ceiling
    return {"emax_null": ceiling, "margin": margin, "prob_exceeds_null_max": _NORMAL.cdf(margin)}


def naive_t(x) -> float | None:
    a = clean(x)
    if len(a) < 3 or a.std(ddof=1) == 0:
        return None
    return float(a.mean() / (a.std(ddof=1) / math.sqrt(len(a))))


def summary(x, horizon: float = 21, sampling: float = 21, lags: int | None = None, trials: int | None = None) -> dict:
    """n, mean, std, icir, hit rate, t (None where observations overlap) and HAC t of a series."""
    a = clean(x)
    if len(a) < 3:
        return {"ok": False, "n": len(a)}
    overlap = sampling < horizon
    if lags is None:
        lags = lag_rule(horizon, sampling, a)
    elif overlap:
        lags = max(lags, math.ceil(horizon / sampling))
    mean, std = float(a.mean()), float(a.std(ddof=1))
    out = {"ok": True, "n": len(a), "mean": mean, "std": std, "icir": mean / std if std > 0 else 0.0, "hit_rate": float((a > 0).mean()), "t_naive": None if overlap else (naive_t(a) or 0.0), "hac_lags": lags, "t_hac": hac_t(a, lags)}
    return out | ({"deflated": deflated_t(out["t_hac"], trials)} if trials and out["t_hac"] is not None else {})


def effective_number(corr: np.ndarray) -> dict:
    """Effective number of columns of a correlation matrix (NaN counts as 0): Li-Ji, capped, Nyholt."""
    r = np.nan_to_num(np.array(corr, float))
    np.fill_diagonal(r, 1.0)
    ev = np.linalg.eigvalsh(r)
    up = np.maximum(ev, 0)
    m = len(ev)
    return {"li_ji": float(((up >= 1) + up - np.floor(up)).sum()), "capped": float(np.minimum(up, 1).sum()), "nyholt": float(1 + (m - 1) * (1 - ev.var(ddof=1) / m)) if m > 1 else 1.0, "eigenvalues": sorted(ev.tolist(), reverse=True)}


def ols_hac(y: np.ndarray, x: np.ndarray, lags: int) -> dict:
    """OLS with a constant and Newey-West errors: coefficients, t values, R2 and residual deviation."""
    a = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.pinv(a.T @ a)
    beta = inverse @ (a.T @ y)
    e = y - a @ beta
    u = a * e[:, None]
    meat = u.T @ u
    for k in range(1, min(lags, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    total = ((y - y.mean()) ** 2).sum()
    return {"beta": beta, "t": np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0), "r2": float(1 - (e**2).sum() / total) if total > 0 else 0.0, "resid_std": float(e.std(ddof=a.shape[1]))}
