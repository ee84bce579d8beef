"""The gap before the open against its SQL: fractions of a second, values that are missing, events at one instant."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources import formats

COLUMNS = "series_id, CAST(session AS VARCHAR), last, close, gap_pct"
ROWS = {
    "a fraction after the time": [(1, "2024-01-01 20:00:00", "a", 10.0), (2, "2024-01-02 08:44:59.999999", "a", 11.0), (3, "2024-01-02 08:45:00.000001", "a", 12.0), (4, "2024-01-03 08:45:00", "a", 13.0), (5, "2024-01-03 08:45:00.5", "a", 14.0), (6, "2024-01-04 08:45:00.9", "a", 15.0)],
    "a value missing at the end": [(1, "2024-01-01 20:00:00", "a", 10.0), (2, "2024-01-01 21:00:00", "a", None), (3, "2024-01-02 08:00:00", "a", 11.0), (4, "2024-01-02 08:30:00", "a", None), (5, "2024-01-03 08:00:00", "a", None), (6, "2024-01-04 08:00:00", "a", 9.0)],
    "events at one instant": [(k, f"2024-01-0{1 + k // 10} 08:00:00", "a", 10.0 + k * 7 % 11) for k in range(1, 40)],
    "no instant or no series": [(1, None, "a", 10.0), (2, "2024-01-01 08:00:00", "a", 11.0), (3, "2024-01-02 08:00:00", None, 12.0), (4, "2024-01-02 08:00:00", "a", 13.0), (5, None, "a", 14.0)],
    "values of no sign": [(1, "2024-01-01 08:00:00", "a", 0.0), (2, "2024-01-02 08:00:00", "a", 5.0), (3, "2024-01-03 08:00:00", "a", -5.0), (4, "2024-01-04 08:00:00", "a", float("nan")), (5, "2024-01-05 08:00:00", "a", 1.0)],
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_odd_events_give_what_the_sql_gives(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", ROWS[name])
    con.execute(f"COPY (SELECT * FROM events ORDER BY event_id) TO '{tmp_path}/events.parquet'")
    want = con.execute(f"SELECT {COLUMNS} FROM ({catalog.SQL['premarket_gap']})").fetchall()
    got = catalog.QUERIES["premarket_gap"](spark, f"file://{tmp_path}").selectExpr("series_id", "string(session)", "last", "close", "gap_pct").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_the_clock_is_the_local_one(spark):
    at = lambda *x: dt.datetime(2024, 1, 2, *x, tzinfo=dt.UTC)
    ticks = spark.createDataFrame([("a", at(13, 30), 101.0, 1), ("a", at(13, 45), 102.0, 2), ("a", at(13, 45), 103.0, 3), ("a", at(13, 45, 0, 1), 104.0, 4)], "series_id string, at timestamp, price double, id long")
    closes = spark.createDataFrame([("a", dt.date(2024, 1, 2), 100.0)], "series_id string, session date, previous_close double")
    for order, last in ((("at", "id"), 103.0), (("at", -F.col("id")), 102.0)):
        assert [r.last for r in formats.premarket_gap(ticks, closes, order=order).collect()] == [last]
    assert [r.last for r in formats.premarket_gap(ticks, closes, clock="08:30").collect()] == [101.0]
