"""Landed files as data sources: rows, pruned files, streams by file, adapters of one's own."""

import datetime as dt
import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import landed

UTC = dt.UTC


def ticks(spark, n=400):
    start = dt.datetime(2024, 3, 10, 4, tzinfo=UTC)
    rows = [("ab"[k % 2], start + dt.timedelta(minutes=7 * k, milliseconds=k), 1.1 + k / 1000, 1.0 + k / 1000) for k in range(n)]
    return spark.createDataFrame([*rows, (None, start, 1.0, 1.0), ("a", None, 1.0, 1.0)], "series_id string, at timestamp, ask double, bid double"), rows


def test_ticks_come_back_as_they_were_landed(spark, tmp_path):
    landed.register(spark)
    df, rows = ticks(spark)
    files = landed.land_ticks(df, f"{tmp_path}/t", most=3).collect()
    assert sum(f.n for f in files) == len(rows) and max(f.n for f in files) <= 3
    again = landed.land_ticks(df, f"{tmp_path}/t", most=3).collect()  # a task that runs twice
    assert sorted(map(tuple, again)) == sorted(map(tuple, files))
    got = spark.read.format("ticks").load(f"{tmp_path}/t")
    assert {(r.series_id, r.at.timestamp(), round(r.ask, 6), round(r.bid, 6)) for r in got.collect()} == {(s, a.timestamp(), round(x, 6), round(y, 6)) for s, a, x, y in rows}
    assert got.count() == len(rows)
    assert spark.read.format("ticks").load(f"{tmp_path}/none").count() == 0


def test_filters_open_no_file_that_cannot_match(spark, tmp_path):
    """Files outside the filters are spoiled: a scan that opened one would fail."""
    landed.register(spark)
    df, rows = ticks(spark)
    landed.land_ticks(df, f"{tmp_path}/t").collect()
    for folder, _, names in os.walk(f"{tmp_path}/t"):
        for name in names:
            if "/a" not in folder or not name.startswith("2024-03-10T0"):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"spoiled")
    cut = dt.datetime(2024, 3, 10, 10, tzinfo=UTC)
    noon = F.lit("2024-03-10T10:00:00Z").cast("timestamp")
    want = [r for r in rows if r[0] == "a" and r[1] < cut]
    only = {"series_id": ["a", "zz"], "at": (None, cut - dt.timedelta(milliseconds=1))}
    got = landed.load(spark, "ticks", f"{tmp_path}/t", only)
    assert got.count() == len(want) > 20
    read = lambda: spark.read.format("ticks").option("pushdown", True).load(f"{tmp_path}/t")
    assert read().where((F.col("series_id") == "a") & (F.col("at") < noon)).count() == len(want)
    assert read().where((F.col("series_id").isin("a", "zz")) & (F.col("at") < noon)).count() == len(want)
    with pytest.raises(Exception, match="spoiled|format|lzma|LZMA"):
        read().where(F.col("series_id") == "b").count()
    with pytest.raises(Exception, match="spoiled|format|lzma|LZMA"):
        landed.load(spark, "ticks", f"{tmp_path}/t").count()
    with pytest.raises(ValueError, match="zone"):
        landed.load(spark, "ticks", f"{tmp_path}/t", {"at": (dt.datetime(2024, 1, 1), None)})


def test_one_use_of_a_frame_leaves_the_next_alone(spark, tmp_path):
    landed.register(spark)
    names = [(f"{s}/2024-02-0{k}.json", json.dumps({"observations": [{"date": "2024-01-01", "value": "1"}]})) for s in "abc" for k in (1, 2)]
    landed.land_json(spark.createDataFrame(names, "name string, payload string"), str(tmp_path)).collect()
    df = spark.read.format("vintages").load(str(tmp_path))
    assert [df.count(), df.where("series_id = 'a'").count(), df.count()] == [6, 2, 6]
    assert sorted(r[0] for r in df.where("series_id = 'a'").union(df.where("series_id = 'b'")).select("series_id").collect()) == ["a", "a", "b", "b"]
    part = landed.load(spark, "vintages", str(tmp_path), {"series_id": ["a", "b"], "requested": (dt.date(2024, 2, 2), None)})
    assert [part.count(), part.where("series_id = 'b'").count(), part.count()] == [2, 1, 2]


def test_partitions_are_files(tmp_path):
    adapter = landed.Ticks()
    os.makedirs(f"{tmp_path}/x")
    for h in range(5):
        open(f"{tmp_path}/x/2024-01-01T0{h}.bi5", "wb").close()
    open(f"{tmp_path}/x/.2024-01-01T00.bi5.tmp", "wb").close()
    reader = landed.LandedReader(adapter, {"path": str(tmp_path)})
    assert len(reader.partitions()) == 5 and len(landed.LandedReader(adapter, {"path": str(tmp_path), "filesPerTask": "2"}).partitions()) == 3
    at = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=UTC)
    for filters, n in [
        ([ds.GreaterThan(("at",), at(3))], 2), ([ds.GreaterThanOrEqual(("at",), at(5))], 0), ([ds.LessThan(("at",), at(1))], 1), ([ds.LessThanOrEqual(("at",), at(1))], 2), ([ds.EqualTo(("at",), at(2))], 1),
        ([ds.EqualTo(("series_id",), "y")], 0), ([ds.In(("series_id",), ("x", "y"))], 5), ([ds.In(("series_id",), ("y",))], 0), ([ds.IsNull(("series_id",))], 0), ([ds.Not(ds.EqualTo(("series_id",), "x"))], 5), ([ds.EqualTo(("ask",), 1.0)], 5), ([ds.StringStartsWith(("series_id",), "z")], 0),
    ]:
        reader = landed.PushedReader(adapter, {"path": str(tmp_path)})
        assert list(reader.pushFilters(filters)) == filters
        assert sum(len(p.files) for p in reader.partitions()) == n, filters
    with pytest.raises(ValueError, match="folder"):
        landed.LandedReader(adapter, {})


def test_a_stream_reads_each_file_once(spark, tmp_path):
    landed.register(spark)
    df, rows = ticks(spark, 60)
    cut = dt.datetime(2024, 3, 10, 8, tzinfo=UTC)
    src, out = f"{tmp_path}/t", f"{tmp_path}/out"
    stream = lambda: spark.readStream.format("ticks").load(src).select("series_id", "at", "ask").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out).awaitTermination(120)
    landed.land_ticks(df.where(F.col("at") < F.lit(cut)), src).collect()
    stream()
    first = spark.read.parquet(out).count()
    assert first == sum(r[1] < cut for r in rows)
    time.sleep(0.05)
    landed.land_ticks(df.where(F.col("at") >= F.lit(cut)), src).collect()
    stream()
    stream()  # nothing new
    got = spark.read.parquet(out)
    assert got.count() == len(rows) == got.distinct().count()


def test_vintages_and_earnings(spark, tmp_path):
    landed.register(spark)
    obs = lambda *v: json.dumps({"observations": [{"date": f"2024-01-0{k + 1}", "realtime_start": "2024-02-01", "realtime_end": "9999-12-31", "value": x} for k, x in enumerate(v)]})
    names = [("DFF/2024-02-01.json", obs("1.5", ".", "-2e1", "x")), ("DFF/2024-03-01.json", ""), ("CPI/2024-02-01-1.json", obs("7"))]
    landed.land_json(spark.createDataFrame(names, "name string, payload string"), f"{tmp_path}/v").collect()
    got = spark.read.format("vintages").load(f"{tmp_path}/v")
    assert sorted((r.series_id, str(r.date), r.value) for r in got.collect() if r.value is not None) == [("CPI", "2024-01-01", 7.0), ("DFF", "2024-01-01", 1.5), ("DFF", "2024-01-03", -20.0)]
    assert got.count() == 5 and got.where("requested = DATE'2024-03-01'").count() == 0
    rows = json.dumps([{"symbol": "X", "date": "2024-05-01", "hour": "amc"}, {"symbol": "", "date": "2024-05-01"}, {"symbol": "Y", "date": None}])
    landed.land_json(spark.createDataFrame([("2024-04-30.json", rows)], "name string, payload string"), f"{tmp_path}/e").collect()
    assert [tuple(r) for r in spark.read.format("earnings").load(f"{tmp_path}/e").collect()] == [("X", dt.date(2024, 5, 1), "amc", None, dt.date(2024, 4, 30))]


def own_adapter():
    """A subclass is all that an adapter of one's own needs (made here, so that workers get it by value)."""

    class Lines(landed.Adapter):
        name, columns, pattern = "day_lines", "day date, line string", r"(?P<day>\d{4}-\d{2}-\d{2})\.txt"

        def bounds(self, of):
            return {"day": (dt.date.fromisoformat(of["day"]),) * 2}

        def read(self, content, of, options):
            lines = content.decode().split()
            yield pa.RecordBatch.from_arrays([pa.array([dt.date.fromisoformat(of["day"])] * len(lines), pa.date32()), pa.array(lines, pa.string())], names=["day", "line"])

    return Lines


def test_plug_in_and_canonical_records(spark, tmp_path):
    landed.register(spark, own_adapter())
    for d, t in (("2024-01-01", "a b"), ("2024-01-02", "c")):
        with open(f"{tmp_path}/{d}.txt", "w") as f:
            f.write(t)
    df = spark.read.format("day_lines").load(str(tmp_path))
    assert df.count() == 3 and [r.line for r in df.where("day = DATE'2024-01-02'").collect()] == ["c"]
    schema = T._parse_datatype_string("source string, series_id string, as_of date, fetched_at timestamp, published_at timestamp, version int, line string, more double")
    got = landed.canonical(df.withColumn("series_id", F.lit("s")), schema, "own", F.col("day"), F.lit("2024-02-01 00:00:00"))
    assert got.schema.simpleString() == schema.simpleString()
    assert {(r.source, r.series_id, str(r.as_of), r.version, r.line, r.more) for r in got.collect()} == {("own", "s", "2024-01-01", 1, "a", None), ("own", "s", "2024-01-01", 1, "b", None), ("own", "s", "2024-01-02", 1, "c", None)}
