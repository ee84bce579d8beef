"""Small fixtures for the edges that the driver tables don't show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import asof, features, labels, metrics, quality
from tidemark.sources.store import Store

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]


def bars(spark, closes):
    rows = [("x", D[k], c, c, c, c, 1) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id string, session date, open double, high double, low double, close double, volume long")


def test_as_of_carries_nulls_and_keeps_targets(spark):
    t = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, at int")
    v = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None)], "k string, at int, x double")
    loose = {(r.k, r.at): r.x for r in asof.as_of(t, v, ["k"], "at", ["x"]).collect()}
    strict = {(r.k, r.at): r.x for r in asof.as_of(t, v, ["k"], "at", ["x"], strict=True).collect()}
    assert loose == {("a", 1): 10.0, ("a", 3): None, ("b", 2): None}
    assert strict == {("a", 1): None, ("a", 3): None, ("b", 2): None}


def test_windows_need_every_row(spark):
    got = features.technical(bars(spark, [float(k + 1) for k in range(25)])).orderBy("session").collect()
    assert got[18].dist_sma_20 is None and got[19].dist_sma_20 == pytest.approx(20 / 10.5 - 1)
    assert got[0].ret_1 is None


@pytest.mark.parametrize(("closes", "last"), [([5.0] * 20, 50.0), ([float(k) for k in range(1, 21)], 100.0), ([float(30 - k) for k in range(20)], 0.0)])
def test_rsi_edges(spark, closes, last):
    got = features.wilder_rsi(bars(spark, closes)).orderBy("session").collect()
    assert got[13].rsi_14 is None and got[-1].rsi_14 == last


def test_barriers_tie_is_a_stop_for_both(spark):
    rows = [(D[0], 100.0, 130.0, 70.0, 100.0, 0.1, 1), (D[1], 100.0, 105.0, 95.0, 104.0, 0.1, 4), (D[2], 100.0, 105.0, 95.0, 104.0, 0.1, 1)]
    days = spark.createDataFrame(rows, "session date, entry double, high double, low double, close double, sigma double, expected int")
    ticks = spark.createDataFrame([(D[0], 2, 80.0, 80.0), (D[0], 1, 120.0, 80.0), (D[1], 1, 120.0, 100.0)], "session date, k long, high double, low double")
    tie, low, none = labels.triple_barrier(days, ticks).orderBy("session").collect()
    assert (none.order_source, none.label_long) == ("daily", "time")
    assert (tie.label_long, tie.label_short, tie.tie) == ("stop", "stop", True)
    assert (low.order_source, low.label_long, low.exit_long) == ("daily", "time", 104.0)


def test_constant_returns_and_no_losses(spark):
    r = bars(spark, [1.0] * 5).select("series_id", "session", F.lit(0.01).alias("net"))
    got = metrics.performance(r.withColumn("net", F.col("net"))).collect()[0]
    assert got.sharpe == 0.0 and got.profit_factor is None and got.sortino is None


def test_stale_runs_break_on_gaps(spark):
    assert quality.stale_runs(bars(spark, [1.0] * 5)).collect()[0].n == 5
    assert quality.stale_runs(bars(spark, [1.0] * 4)).count() == 0


def test_store_appends_revises_and_reads_the_past(spark, tmp_path):
    schema = T.StructType.fromDDL("source string, series_id string, as_of date, fetched_at timestamp, published_at timestamp, version long, value double")
    s = Store(spark, f"file://{tmp_path}/store", {"raw.macro": schema})
    at = lambda day, v: spark.createDataFrame([("s", "x", D[0], dt.datetime(2024, 2, day), None, 1, v)], schema)
    assert s.append("raw.macro", at(1, 1.0)) == {"new": 1}
    assert s.append("raw.macro", at(1, 1.0)) == {"unchanged": 1}
    with pytest.raises(ValueError, match="differ"):
        s.append("raw.macro", at(2, 2.0))
    s.append("raw.macro", at(2, 2.0), revise=True)
    assert [(r.version, r.value) for r in s.current("raw.macro").collect()] == [(2, 2.0)]
    assert [r.value for r in s.read_pit("raw.macro", "2024-02-01 12:00:00").collect()] == [1.0]
    assert s.sql("SELECT count(*) AS n FROM raw_macro").collect()[0].n == 1
