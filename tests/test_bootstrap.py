"""Bootstrap intervals against a plain numpy loop."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import metrics
from tidemark.plans import catalog


def interval(x, draws=10_000):
    """The reference's procedure: RandomState(42), 512 draws at a time, linear quantiles of the sorted means."""
    rng, means = np.random.RandomState(42), []
    while len(means) < draws:
        for at in rng.randint(0, len(x), size=(min(512, draws - len(means)), len(x))):
            means.append(sum(x[i] for i in at) / len(x))
    means.sort()

    def quantile(p):
        at = (draws - 1) * p
        low = int(at)
        return means[low] * (1 - at + low) + means[min(low + 1, draws - 1)] * (at - low)

    return quantile(0.025), quantile(0.975)


def test_registered_query_takes_all_draws(spark, monkeypatch):
    r = np.random.RandomState(1)
    series = {"a": r.normal(0.001, 0.02, 30), "b": r.normal(0, 0.01, 17), "c": np.array([0.5])}
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(v)) for k, x in series.items() for d, v in enumerate(x)] + [("a", dt.date(2023, 1, 1), None)]
    returns = spark.createDataFrame(rows, "series_id string, session date, net double").repartition(3)
    monkeypatch.setattr(catalog, "_simulated", lambda spark, sf: returns)
    want = {k: interval(x) for k, x in series.items()}
    for got in (catalog.QUERIES["bootstrap_intervals"](spark, "").collect(), metrics.bootstrap(returns).collect()):
        assert {x.series_id for x in got} == set(want)
        for x in got:
            assert (x.lo, x.hi) == pytest.approx(want[x.series_id], abs=2e-8)
