"""Landed files as Spark data sources: `spark.read.format("ticks").load(path)`, the same for streams.

An adapter says how a file's path tells what it holds and how its bytes become rows; registered, it is a format of
Spark. One partition reads one file (or `filesPerTask`). Conditions on what the path tells, such as the series or the
hour, skip files that can hold no matching row: `load` takes them, for frames that may be used in any way. With the option
`pushdown` Spark's own filters do the same, but only for a frame that is used once: Spark 4.1 keeps the filters of one use
of a Python data source for the next use of the same frame. A stream reads each landed file once; its offset is the place
in the order of landing.

Files are found and read through pyarrow's file systems, so a path may be local, shared, or of a store that these know
(hdfs, s3, gs); writers land a file by moving it into place whole.
"""

from __future__ import annotations

import datetime as dt
import json
import lzma
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.formats import _TICK

HOUR = dt.timedelta(hours=1)


class Adapter:
    """How files of a kind are named and read; a subclass is all that a new source needs.

    pattern: a regular expression of a file's path below the folder, with named groups. bounds: least and most value of
    columns that the groups tell. read: the rows of a file as Arrow batches of the declared columns.
    """

    name: str
    columns: str
    pattern: str

    def bounds(self, of: dict[str, str]) -> dict[str, tuple]:
        return {}

    def read(self, content: bytes, of: dict[str, str], options: dict) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class Ticks(Adapter):
    """Packed ticks of a series and hour, named series/2024-01-31T13[-part].bi5; option `scale`: points a unit (100000)."""

    name = "ticks"
    columns = "series_id string, at timestamp, ask double, bid double, ask_volume float, bid_volume float"
    pattern = r"(?P<series>[^/]+)/(?P<hour>\d{4}-\d{2}-\d{2}T\d{2})(?:-[^/]*)?\.bi5"

    def bounds(self, of: dict[str, str]) -> dict[str, tuple]:
        start = dt.datetime.fromisoformat(of["hour"] + ":00:00")
        return {"series_id": (of["series"], of["series"]), "at": (start, start + HOUR - dt.timedelta(microseconds=1))}

    def read(self, content: bytes, of: dict[str, str], options: dict) -> Iterator[pa.RecordBatch]:
        raw = lzma.decompress(content) if content else b""
        if len(raw) % _TICK.itemsize:
            raise ValueError(f"{of['series']} {of['hour']}: the file ends within a tick")
        t, scale = np.frombuffer(raw, _TICK), float(options.get("scale", 100_000))
        at = np.datetime64(of["hour"], "us") + t["ms"].astype("timedelta64[ms]")
        if len(t):
            yield pa.RecordBatch.from_arrays(
                [pa.array([of["series"]] * len(t)), pa.array(at, pa.timestamp("us", "UTC")), pa.array(t["ask"] / scale), pa.array(t["bid"] / scale), *(pa.array(t[v].astype(np.float32)) for v in ("ask_volume", "bid_volume"))],
                names=["series_id", "at", "ask", "bid", "ask_volume", "bid_volume"],
            )


class Vintages(Adapter):
    """JSON answers with a list `observations`, named series/2024-01-31.json by the day of the request; "." is no value."""

    name = "vintages"
    columns = "series_id string, requested date, date date, realtime_start date, realtime_end date, value double"
    pattern = r"(?P<series>[^/]+)/(?P<day>\d{4}-\d{2}-\d{2})(?:-[^/]*)?\.json"

    def bounds(self, of: dict[str, str]) -> dict[str, tuple]:
        day = dt.date.fromisoformat(of["day"])
        return {"series_id": (of["series"], of["series"]), "requested": (day, day)}

    def read(self, content: bytes, of: dict[str, str], options: dict) -> Iterator[pa.RecordBatch]:
        rows = json.loads(content).get("observations", []) if content.strip() else []
        day = lambda x: pa.array([dt.date.fromisoformat(r[x]) if r.get(x) else None for r in rows], pa.date32())
        plain = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
        value = [float(v) if plain.fullmatch(v := str(r.get("value", "")).strip()) else None for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([of["series"]] * len(rows), pa.string()), pa.array([dt.date.fromisoformat(of["day"])] * len(rows), pa.date32()), day("date"), day("realtime_start"), day("realtime_end"), pa.array(value, pa.float64())],
            names=["series_id", "requested", "date", "realtime_start", "realtime_end", "value"],
        )


class Earnings(Adapter):
    """JSON lists of {symbol, date, hour, fiscal}, named 2024-01-31.json by the day they were known; entries without a symbol or date are left out."""

    name = "earnings"
    columns = "symbol string, date date, hour string, fiscal string, known date"
    pattern = r"(?:.*/)?(?P<day>\d{4}-\d{2}-\d{2})(?:-[^/]*)?\.json"

    def bounds(self, of: dict[str, str]) -> dict[str, tuple]:
        day = dt.date.fromisoformat(of["day"])
        return {"known": (day, day)}

    def read(self, content: bytes, of: dict[str, str], options: dict) -> Iterator[pa.RecordBatch]:
        rows = [r for r in (json.loads(content) if content.strip() else []) if r.get("symbol") and r.get("date")]
        text = lambda k: pa.array([r.get(k) for r in rows], pa.string())
        known = dt.date.fromisoformat(of["day"])
        yield pa.RecordBatch.from_arrays(
            [text("symbol"), pa.array([dt.date.fromisoformat(r["date"][:10]) for r in rows], pa.date32()), text("hour"), text("fiscal"), pa.array([known] * len(rows), pa.date32())], names=["symbol", "date", "hour", "fiscal", "known"]
        )


ADAPTERS: dict[str, type[Adapter]] = {a.name: a for a in (Ticks, Vintages, Earnings)}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; `file:/x` and bare paths are local."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Found:
    path: str
    landed: int
    of: tuple[tuple[str, str], ...]


@dataclass
class Files(ds.InputPartition):
    files: tuple[Found, ...]


def listed(path: str, pattern: str) -> list[Found]:
    """Files below a folder whose path fits, in the order of landing (time, then path)."""
    fs, base = opened(path)
    base = base.rstrip("/")
    out = []
    for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        hit = re.fullmatch(pattern, info.path[len(base) :].lstrip("/")) if info.type == pafs.FileType.File else None
        if hit:
            out.append(Found(info.path, info.mtime_ns or 0, tuple(sorted(hit.groupdict().items()))))
    return sorted(out, key=lambda f: (f.landed, f.path))


def possible(f: ds.Filter, bounds: dict[str, tuple]) -> bool:
    """Whether a file whose columns lie within the bounds can hold a row that the filter lets pass."""
    column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
    if column not in bounds:
        return True
    low, high = bounds[column]

    def same(v):
        """The value as the bounds have it: instants in UTC without a zone."""
        if isinstance(v, dt.datetime) and v.tzinfo is not None:
            v = v.astimezone(dt.UTC).replace(tzinfo=None)
        return v if isinstance(v, type(low)) else None

    if isinstance(f, ds.In):
        values = [same(v) for v in f.value]
        return any(v is None or low <= v <= high for v in values) if values else False
    if isinstance(f, ds.IsNull):
        return False
    v = same(f.value) if hasattr(f, "value") else None
    if v is None:
        return True
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return low <= v <= high
    if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
        return high > v or (isinstance(f, ds.GreaterThanOrEqual) and high == v)
    if isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
        return low < v or (isinstance(f, ds.LessThanOrEqual) and low == v)
    if isinstance(f, ds.StringStartsWith):
        return not isinstance(low, str) or low != high or low.startswith(v)
    return True


class _Reads:
    """What batch and stream readers share."""

    def __init__(self, adapter: Adapter, options: dict) -> None:
        self.adapter, self.options = adapter, dict(options)
        if "path" not in self.options:
            raise ValueError(f"{adapter.name}: give the folder of the files")

    def _parts(self, files: list[Found]) -> list[Files]:
        n = max(1, int(self.options.get("filesPerTask", 1)))
        return [Files(tuple(files[k : k + n])) for k in range(0, len(files), n)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for f in partition.files:
            fs, _ = opened(self.options["path"])
            with fs.open_input_stream(f.path) as stream:
                yield from self.adapter.read(stream.read(), dict(f.of), self.options)


class LandedReader(_Reads, ds.DataSourceReader):
    def __init__(self, adapter: Adapter, options: dict) -> None:
        super().__init__(adapter, options)
        self.filters: list[ds.Filter] = wanted(json.loads(self.options.get("only", "{}")))

    def partitions(self) -> list[Files]:
        files = listed(self.options["path"], self.adapter.pattern)
        return self._parts([f for f in files if all(possible(x, self.adapter.bounds(dict(f.of))) for x in self.filters)])


class PushedReader(LandedReader):
    def pushFilters(self, filters: list[ds.Filter]):
        """Filters prune files; Spark still applies every one to the rows."""
        self.filters = [*self.filters, *filters]
        yield from filters


class LandedStreamReader(_Reads, ds.DataSourceStreamReader):
    """Offsets are (landed, path) of the last file taken. `settle` (seconds, 0): how long a file must have stood."""

    def initialOffset(self) -> dict:
        return {"landed": -1, "path": ""}

    def latestOffset(self) -> dict:
        edge = (dt.datetime.now(dt.UTC).timestamp() - float(self.options.get("settle", 0))) * 1e9
        files = [f for f in listed(self.options["path"], self.adapter.pattern) if f.landed <= edge]
        return {"landed": files[-1].landed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        at = lambda o: (o["landed"], o["path"])
        return self._parts([f for f in listed(self.options["path"], self.adapter.pattern) if at(start) < (f.landed, f.path) <= at(end)])

    def commit(self, end: dict) -> None:
        """Files stay where they landed."""


def source_of(adapter: type[Adapter]) -> type[ds.DataSource]:
    """The data source of an adapter."""

    class Landed(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return adapter.name

        def schema(self) -> str:
            return adapter.columns

        def reader(self, schema: StructType) -> LandedReader:
            pushed = str(dict(self.options).get("pushdown", "false")).lower() == "true"
            return (PushedReader if pushed else LandedReader)(adapter(), self.options)

        def streamReader(self, schema: StructType) -> LandedStreamReader:
            return LandedStreamReader(adapter(), self.options)

    return Landed


def register(spark: SparkSession, *more: type[Adapter]) -> None:
    """Make the formats of ADAPTERS and of the given adapters known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for adapter in (*ADAPTERS.values(), *more):
        spark.dataSource.register(source_of(adapter))


def _plain(v):
    return {"t": v.astimezone(dt.UTC).replace(tzinfo=None).isoformat()} if isinstance(v, dt.datetime) else {"d": v.isoformat()} if isinstance(v, dt.date) else v


def _value(v):
    if isinstance(v, dict):
        return dt.datetime.fromisoformat(v["t"]) if "t" in v else dt.date.fromisoformat(v["d"])
    return v


def wanted(only: dict) -> list[ds.Filter]:
    """Filters of {column: {"in": [...]} or {"from": least, "to": most}}."""
    out: list[ds.Filter] = []
    for c, v in only.items():
        if "in" in v:
            out.append(ds.In((c,), tuple(map(_value, v["in"]))))
        out += [kind((c,), _value(v[k])) for k, kind in (("from", ds.GreaterThanOrEqual), ("to", ds.LessThanOrEqual)) if v.get(k) is not None]
    return out


def load(spark: SparkSession, name: str, path: str, only: dict | None = None, **options) -> DataFrame:
    """A landed folder as a frame. only: {column: values} as a list, or as a tuple (least, most) of which either may be None.

    Files that can hold no such row are not opened, and rows that are not such are filtered. Instants have a zone.
    """
    only = only or {}
    for v in only.values():
        if any(isinstance(x, dt.datetime) and x.tzinfo is None for x in v):
            raise ValueError("instants need a zone")
    coded = {c: {"in": [_plain(x) for x in v]} if isinstance(v, list) else {"from": _plain(v[0]), "to": _plain(v[1])} for c, v in only.items()}
    df = spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).option("only", json.dumps(coded)).load(path)
    for c, v in only.items():
        if isinstance(v, list):
            df = df.where(F.col(c).isin(v))
        else:
            df = df.where((F.lit(True) if v[0] is None else F.col(c) >= F.lit(v[0])) & (F.lit(True) if v[1] is None else F.col(c) <= F.lit(v[1])))
    return df


def land_ticks(ticks: DataFrame, path: str, scale: float = 100_000, most: int = 200_000) -> DataFrame:
    """Write ticks (series_id, at, ask, bid) as files of a series and hour below path; (path, n) of each file.

    An hour of more than `most` ticks becomes several files, so no task holds more. Names and contents follow from the
    rows alone, and a file is moved into place whole: a task that runs again leaves what it left before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(path)
        held: list[pd.DataFrame] = []
        key, part = None, 0

        def written() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            t = np.zeros(len(rows), _TICK)
            t["ms"], t["ask"], t["bid"] = rows["ms"], np.rint(rows["ask"] * scale), np.rint(rows["bid"] * scale)
            folder, name = f"{base.rstrip('/')}/{key[0]}", f"{np.datetime64(int(key[1]), 'h')}-{part}.bi5"
            fs.create_dir(folder, recursive=True)
            early = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(early) as out:
                out.write(lzma.compress(t.tobytes(), preset=1))
            fs.move(early, f"{folder}/{name}")
            return pd.DataFrame({"path": [f"{folder}/{name}"], "n": [len(t)]})

        for pdf in batches:
            for k, rows in pdf.groupby(["series_id", "hour"], sort=False):
                for at in range(0, len(rows), most):
                    if key is not None and (k != key or sum(map(len, held)) >= most):
                        yield written()
                        part = part + 1 if k == key else 0
                    key = k
                    held.append(rows.iloc[at : at + most])
        if held:
            yield written()

    ms = F.unix_millis("at")  # hours of UTC, whatever the session's zone
    rows = ticks.where("series_id is not null and at is not null").select("series_id", F.floor(ms / 3_600_000).alias("hour"), F.pmod(ms, F.lit(3_600_000)).alias("ms"), "ask", "bid")
    rows = rows.repartition("series_id", "hour").sortWithinPartitions("series_id", "hour", "ms", "ask", "bid")
    return rows.mapInPandas(run, "path string, n long")


def land_json(payloads: DataFrame, path: str) -> DataFrame:
    """Write payloads (name, payload) as files below path, each moved into place whole; (path, n) with the bytes of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(path)
        for pdf in batches:
            for name, payload in zip(pdf["name"], pdf["payload"], strict=True):
                at = f"{base.rstrip('/')}/{name}"
                folder, last = at.rsplit("/", 1)
                fs.create_dir(folder, recursive=True)
                early = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with fs.open_output_stream(early) as out:
                    out.write(payload.encode())
                fs.move(early, at)
                yield pd.DataFrame({"path": [at], "n": [len(payload.encode())]})

    return payloads.select("name", "payload").mapInPandas(run, "path string, n long")


def canonical(rows: DataFrame, schema: StructType, source: str, as_of: Column, fetched_at: Column, published_at: Column | None = None) -> DataFrame:
    """rows (series_id and the payload of a dataset) as records of a store: its clocks, source and first version, in the declared types and order."""
    given = {"source": F.lit(source), "as_of": as_of, "fetched_at": fetched_at, "published_at": F.lit(None) if published_at is None else published_at, "version": F.lit(1)}
    full = rows.withColumns(given)
    return full.select(*((F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; on a local master alone, one of this machine if that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
