"""The bars of a stream are those of the table."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming.bars import windowed_bars

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def rows(first, n):
    start = dt.datetime(2024, 1, 1)
    return [(k, start + dt.timedelta(minutes=7 * k), k % 3, "ab"[k % 2], float((k * 37) % 11), "{}") for k in range(first, first + n)]


def test_stream_matches_table(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (rows(0, 40), rows(40, 40), [(999, dt.datetime(2024, 1, 9), 0, "a", 1.0, "{}")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    query = windowed_bars(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    got = {(r.event_type, r.bar, r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(out).collect()}
    table = windowed_bars(spark.read.schema(SCHEMA).parquet(src)).where(F.col("bar") < F.lit("2024-01-08").cast("timestamp"))
    want = {(r.event_type, r.bar, r.open, r.high, r.low, r.close, r.volume) for r in table.collect()}
    assert got == want and len(want) > 15
