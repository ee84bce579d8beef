"""Seeded draws cut over tasks against one loop, and the GARCH fit against a grid and a plain recursion."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import garch, resampling


def frame(spark, series):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d), float(v)) for k, x in series.items() for d, v in enumerate(x)]
    return spark.createDataFrame([*rows, (next(iter(series)), dt.date(2019, 1, 1), None)], "series_id string, session date, net double").repartition(3)


def one_loop(x, statistic, draws=10_000, seed=42, level=0.95):
    rng, out = np.random.RandomState(seed), []
    for at in range(0, draws, 512):
        out.append(statistic(x[rng.randint(0, len(x), size=(min(512, draws - at), len(x)))]))
    return tuple(np.quantile(np.concatenate(out), [(1 - level) / 2, (1 + level) / 2]))


R = np.random.RandomState(3)
SERIES = {"a": R.normal(0.001, 0.02, 300), "b": R.normal(0, 0.01, 300), "c": R.normal(0, 0.01, 41), "d": np.array([0.5]), "e": np.full(9, 0.25)}


@pytest.mark.parametrize("kind", sorted(resampling.STATISTICS))
def test_bits_of_one_stream(spark, kind):
    """All 10,000 draws, to the last bit, from more tasks than there are series."""
    with np.errstate(all="ignore"):
        got = {r.series_id: (r.lo, r.hi) for r in resampling.interval(frame(spark, {k: SERIES[k] for k in "abce"}), kind).collect()}
        assert got == {k: one_loop(SERIES[k], resampling.STATISTICS[kind]) for k in "abce"}


def test_chunks_are_rows_of_their_own(spark):
    """A series is as many rows as its stream has chunks before anything is computed."""
    chunks = list(resampling.states(300, 10_000, 42))
    assert len(chunks) == 20 and chunks[-1][1] == 10_000 - 19 * 512
    x = SERIES["a"]
    for k in (0, 7, 19):
        rng = np.random.RandomState(42)
        for j in range(k):
            rng.randint(0, 300, size=(512, 300))
        rows = chunks[k][1]
        assert np.array_equal(resampling.chunk_of(x, resampling.mean, *chunks[k][1:]), x[rng.randint(0, 300, size=(rows, 300))].mean(axis=1))


def test_any_statistic(spark):
    def spread(x):
        return float(np.quantile(x, 0.9) - np.quantile(x, 0.1))

    got = {r.series_id: r for r in resampling.interval(frame(spark, {k: SERIES[k] for k in "acd"}), resampling.each(spread), draws=1100, seed=5, level=0.8).collect()}
    for k in "acd":
        assert (got[k].lo, got[k].hi) == one_loop(SERIES[k], resampling.each(spread), 1100, 5, 0.8) and got[k].estimate == spread(SERIES[k]) and got[k].n == len(SERIES[k])
    with pytest.raises(Exception, match="not finite"):
        resampling.interval(frame(spark, {"a": SERIES["a"]}), resampling.each(lambda x: math.nan), draws=10).collect()
    assert resampling.interval(frame(spark, {"a": SERIES["a"]}).limit(0)).count() == 0


def test_paired_difference(spark):
    pairs = frame(spark, {"up": SERIES["a"], "even": SERIES["b"]}).withColumn("left", F.when(F.col("series_id") == "up", F.col("net") + 0.01).otherwise(F.col("net"))).withColumn("right", F.when(F.col("series_id") == "even", F.col("net") + F.when(F.dayofyear("session") % 2 == 0, 0.001).otherwise(-0.001)).otherwise(F.col("net") * 0.9))
    got = {r.series_id: r for r in resampling.paired_interval(pairs, "left", "right", draws=2000).collect()}
    d = (SERIES["a"] + 0.01) - SERIES["a"] * 0.9
    assert (got["up"].lo, got["up"].hi) == one_loop(d, resampling.mean, 2000)
    assert (got["up"].verdict, got["even"].verdict) == ("above", "open")


def test_dominance_by_interval(spark):
    levels = [0.0, 0.0005, 0.002, 0.01]
    got = resampling.dominance_intervals(frame(spark, {k: SERIES[k] for k in "ab"}).withColumnRenamed("net", "d"), levels, draws=1500).collect()
    for k in "ab":
        mine = sorted((r for r in got if r.series_id == k), key=lambda r: r.level)
        assert [(r.lo, r.hi) for r in mine] == [one_loop(SERIES[k] - x, resampling.mean, 1500) for x in levels]
        assert all(r.monotone for r in mine)
        below = [r.level for r in mine if r.hi < 0]
        assert {r.dominated_from for r in mine} == {min(below)} and mine[-1].sign == "negative"


def simulated(n, omega, alpha, beta, seed=1):
    rng, s, out = np.random.default_rng(seed), omega / (1 - alpha - beta), []
    for _ in range(n):
        out.append(rng.normal() * math.sqrt(s))
        s = omega + alpha * out[-1] ** 2 + beta * s
    return np.array(out)


def plain_likelihood(r, omega, alpha, beta):
    w = 0.94 ** np.arange(min(75, len(r)))
    last = s = float((r[: len(w)] ** 2 * w).sum() / w.sum())
    total = 0.0
    for x in r:
        s = omega + alpha * last + beta * s
        total += math.log(s) + x * x / s
        last = x * x
    return total


@pytest.mark.parametrize("omega,alpha,beta", [(1e-6, 0.08, 0.9), (1e-5, 0.2, 0.6), (5e-5, 0.02, 0.3)])
def test_garch_is_no_worse_than_a_grid(omega, alpha, beta):
    r = simulated(1200, omega, alpha, beta)
    ends = np.array([600, 1200])
    params, totals = garch.fit(r, ends)
    for k, e in enumerate(ends):
        x, v = r[:e], (r[:e] ** 2).mean()
        assert totals[k] == pytest.approx(plain_likelihood(x, *params[:, k]), rel=1e-10)
        a, b, w = (g.ravel() for g in np.meshgrid(np.linspace(0, 0.5, 26), np.linspace(0, 0.99, 34), v * np.geomspace(0.002, 1, 24)))
        fine = a + b < 0.9999
        a, b, w = a[fine], b[fine], w[fine]
        s, last, total = np.full(len(a), garch.backcast(x * x)), np.full(len(a), garch.backcast(x * x)), np.zeros(len(a))
        for y in x * x:
            s = w + a * last + b * s
            total += np.log(s) + y / s
            last = np.full(len(a), y)
        assert totals[k] <= total.min() + 1e-6
        assert params[0, k] > 0 and (params[1:, k] >= 0).all() and params[1:, k].sum() < 1


def test_gradient_is_that_of_the_likelihood():
    r2 = simulated(300, 1e-5, 0.1, 0.8) ** 2
    v, ends = np.array([r2.mean()] * 2), np.array([200, 300])
    z = np.array([[-2.0, -1.0], [1.5, 0.5], [-1.0, 0.3]])
    back = np.full(2, garch.backcast(r2))
    _, grad, _ = garch._likelihood(z, r2, back, v, ends)
    for i in range(3):
        step = np.zeros_like(z)
        step[i] = 1e-6
        slope = (garch._likelihood(z + step, r2, back, v, ends)[0] - garch._likelihood(z - step, r2, back, v, ends)[0]) / 2e-6
        assert slope == pytest.approx(grad[i], rel=1e-4, abs=1e-4)


def test_garch_forecasts_are_the_recursion(spark):
    """Bounds of folds, a fit a fold on what lies before it, the recursion up to each session; nothing later is seen."""
    assert garch.fold_bounds(542) == [(500, 521), (521, 542)] and garch.fold_bounds(500) == [] and garch.fold_bounds(503) == [(500, 503)]
    r = simulated(400, 1e-5, 0.1, 0.8, seed=4)
    close = 100 * np.exp(np.cumsum(r))
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(c)) for k, c in enumerate(close)]
    got = [x.garch_forecast for x in garch.forecasts(spark.createDataFrame(rows, "series_id string, session date, close double"), first=300, refit=40).orderBy("session").collect()]
    x = np.r_[0.0, np.diff(np.log(close))]
    assert got[:300] == [None] * 300
    for a, b in garch.fold_bounds(400, 300, 40):
        (omega, alpha, beta), _ = garch.fit(x[:a], np.array([a]))
        s = last = garch.backcast(x[:a] ** 2)
        for t in range(b):
            s = omega[0] + alpha[0] * last + beta[0] * s
            if t >= a:
                assert got[t] == pytest.approx(s, rel=1e-3)  # of two fits, each stopped near the optimum
            last = x[t] ** 2
    flat, _ = garch.fit(np.zeros(50), np.array([20, 50]))
    assert np.isnan(flat).all()
