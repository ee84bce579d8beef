"""GARCH(1,1) with zero mean and normal errors: all three parameters by maximum likelihood, refit on folds.

All folds of a series are fitted side by side: the variance recursion runs once over the sessions with a column a fold,
carrying the derivatives, and each step of Fisher scoring is a 3 x 3 solve a fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import log_return

#: Sessions before the first forecast, and between refits.
FIRST, REFIT = 500, 21
#: Decay and length of the weighted mean of squares that the recursion begins with.
DECAY, BACK = 0.94, 75
#: Starting points: persistence, and the share of news in it. Of each share the likeliest persistence is followed to its optimum.
_SHARES, _PERSISTENCE = (0.002, 0.05, 0.2, 0.6), (0.1, 0.3, 0.6, 0.85, 0.95, 0.99)
_STARTS = [(p, q) for q in _SHARES for p in _PERSISTENCE]
FOLLOWED = len(_SHARES)


def fold_bounds(n: int, first: int = FIRST, refit: int = REFIT) -> list[tuple[int, int]]:
    """Stretches [start, end) that share a fit on all before start; the last is cut at n."""
    return [(start, min(start + refit, n)) for start in range(first, n, refit)]


def _parameters(z: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """omega, alpha, beta of free coordinates (log of omega / v, logits of persistence and of the share of news), and their derivatives."""
    p, q = 1 / (1 + np.exp(-z[1])), 1 / (1 + np.exp(-z[2]))
    p = 0.9999 * p
    omega, dp, dq = v * np.exp(z[0]), p * (1 - p / 0.9999), q * (1 - q)
    zero = np.zeros_like(p)
    jacobian = np.array([[omega, zero, zero], [zero, q * dp, p * dq], [zero, (1 - q) * dp, -p * dq]])
    return omega, p * q, p * (1 - q), jacobian


def _likelihood(z: np.ndarray, r2: np.ndarray, back: np.ndarray, v: np.ndarray, ends: np.ndarray, slopes: bool = True) -> tuple:
    """Twice the negative log likelihood (without constant) of each column up to its end; its gradient and information."""
    omega, alpha, beta, jacobian = _parameters(z, v)
    k = z.shape[1]
    s, d = back.copy(), np.zeros((3, k))
    total, grad, info = np.zeros(k), np.zeros((3, k)), np.zeros((3, 3, k))
    last = back
    for t in range(int(ends.max())):
        if slopes:
            d = np.stack([np.ones(k), last, s]) + beta * d
        s = omega + alpha * last + beta * s
        on = t < ends
        total += np.where(on, np.log(s) + r2[t] / s, 0.0)
        if slopes:
            u = np.where(on, d / s, 0.0)
            grad += u * (1 - r2[t] / s)
            info += u[:, None] * u[None, :]
        last = np.full(k, r2[t])
    if not slopes:
        return total, None, None
    return total, np.einsum("ijk,ik->jk", jacobian, grad), np.einsum("iak,ijk,jbk->abk", jacobian, info, jacobian)


def backcast(r2: np.ndarray) -> float:
    w = DECAY ** np.arange(min(BACK, len(r2)))
    return float((r2[: len(w)] * w).sum() / w.sum())


def fit(returns: np.ndarray, ends: np.ndarray, rounds: int = 100, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """(parameters omega, alpha, beta by column, twice the negative log likelihood) of the returns up to each end.

    Bounds: omega > 0, alpha and beta >= 0, alpha + beta < 0.9999. The likelihood can have several optima; the best of
    FOLLOWED is taken. A stretch without variance has NaN parameters.
    """
    r2, ends = np.square(np.asarray(returns, float)), np.asarray(ends)
    v = np.array([r2[:e].mean() if e else 0.0 for e in ends])
    fine = v > 0
    v = np.where(fine, v, 1.0)
    back = np.maximum(np.where(fine, backcast(r2), 1.0), v * 1e-6)
    n, logit = len(ends), lambda x: np.log(x / (1 - x))
    starts = np.array([(np.log(1 - p), logit(p / 0.9999), logit(q)) for p, q in _STARTS])
    wide = lambda x, times: np.tile(x, times)
    k = len(starts)
    first = _likelihood(np.repeat(starts.T, n, axis=1), r2, wide(back, k), wide(v, k), wide(ends, k), slopes=False)[0].reshape(k, n)
    best = first.reshape(FOLLOWED, -1, n).argmin(axis=1) + np.arange(FOLLOWED)[:, None] * len(_PERSISTENCE)
    z, back, v, ends = starts[best].transpose(2, 0, 1).reshape(3, -1), wide(back, FOLLOWED), wide(v, FOLLOWED), wide(ends, FOLLOWED)
    damp = np.full(z.shape[1], 1e-3)
    total, grad, info = _likelihood(z, r2, back, v, ends)
    for _ in range(rounds):
        diagonal = np.einsum("iik->ik", info) + 1e-9
        a = np.moveaxis(info, 2, 0) + (damp[:, None] * diagonal.T)[:, :, None] * np.eye(3)
        step = np.clip(np.linalg.solve(a, grad.T[:, :, None])[:, :, 0].T, -2, 2)
        tried = np.clip(z - step, -25, 25)
        new, new_grad, new_info = _likelihood(tried, r2, back, v, ends)
        better = new < total
        gain = np.where(better, total - new, 0.0)
        z, total = np.where(better, tried, z), np.where(better, new, total)
        grad, info = np.where(better, new_grad, grad), np.where(better, new_info, info)
        damp = np.clip(np.where(better, damp / 5, damp * 8), 1e-9, 1e9)
        if ((gain <= tolerance * np.abs(total)) & (better | (damp > 1e6))).all():
            break
    pick = total.reshape(FOLLOWED, n).argmin(axis=0) * n + np.arange(n)
    omega, alpha, beta, _ = _parameters(z[:, pick], v[pick])
    return np.where(fine, np.stack([omega, alpha, beta]), np.nan), np.where(fine, total[pick], np.nan)


def one_step(returns: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Variance foreseen for each session of the bounds from those before it: the fit of its stretch, and the recursion up to it.

    A return that is no number counts as none (0). Sessions outside the bounds have NaN.
    """
    out = np.full(len(returns), np.nan)
    if not bounds:
        return out
    r = np.where(np.isfinite(returns), returns, 0.0)
    r2 = np.square(r)
    (omega, alpha, beta), _ = fit(r, np.array([a for a, _ in bounds]))
    s = np.full(len(bounds), max(backcast(r2[: bounds[0][0]]), 1e-300))
    last = s
    begin, end = np.array(bounds).T
    for t in range(int(end.max())):
        s = omega + alpha * last + beta * s
        on = np.flatnonzero((begin <= t) & (t < end))
        if len(on):
            out[t] = s[on[0]]
        last = np.full(len(bounds), r2[t])
    return out


def forecasts(bars: DataFrame, first: int = FIRST, refit: int = REFIT) -> DataFrame:
    """(series_id, session, garch_forecast): the variance of log returns foreseen for a session from those before it; null before `first`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        r = pdf["r"].to_numpy(float)
        return pd.DataFrame({"series_id": pdf["series_id"], "session": pdf["session"], "garch_forecast": one_step(r, fold_bounds(len(r), first, refit))})

    got = bars.select("series_id", "session", log_return(F.col("close")).alias("r")).groupBy("series_id").applyInPandas(run, "series_id string, session date, garch_forecast double")
    return got.withColumn("garch_forecast", F.when(~F.isnan("garch_forecast"), F.col("garch_forecast")))
