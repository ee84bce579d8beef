"""Bitemporal, append-only Parquet store: declared schema, revisions, current state and reads as known at an instant."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ("source", "series_id", "as_of")
#: Folders of a batch, a source and year each, that are broadcast at most.
FOLDERS = 50_000
MANDATORY = {"source", "series_id", "as_of", "fetched_at", "published_at", "version"}


def current(revisions: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The row of the highest version of each identity, by one aggregation combined before the shuffle."""
    rest = [c for c in revisions.columns if c not in identity and c != "version"]
    best = revisions.groupBy(*identity).agg(F.max_by(F.struct("version", *rest), F.struct("version", "fetched_at")).alias("x"))
    return best.select(*identity, "x.*").select(*revisions.columns)


def known_at(revisions: DataFrame, at: str, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The current rows among those published (or fetched, where never published) by `at`."""
    return current(revisions.where(F.coalesce("published_at", "fetched_at") <= F.lit(at).cast(revisions.schema["fetched_at"].dataType)), identity)


def classified(batch: DataFrame, stored: DataFrame, payload: list[str], identity: tuple[str, ...] = IDENTITY, noisy: tuple[str, ...] = ()) -> DataFrame:
    """batch with `verdict`: new, unchanged, or revise, against the current rows of stored; null equals null, noisy columns within a tolerance."""
    now = current(stored, identity).select(*[F.col(c).alias(f"_{c}") for c in (*identity, *payload)], F.col("version").alias("_version"))
    match = None
    for c in identity:
        match = F.col(c).eqNullSafe(F.col(f"_{c}")) if match is None else match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    same = F.lit(True)
    for c in payload:
        same = same & (nearly(F.col(c), F.col(f"_{c}")) if c in noisy else F.col(c).eqNullSafe(F.col(f"_{c}")))
    out = batch.join(now, match, "left")
    verdict = F.when(F.col("_version").isNull(), "new").when(same, "unchanged").otherwise("revise")
    return out.withColumns({"verdict": verdict, "next_version": F.coalesce(F.col("_version"), F.lit(0)) + 1}).select(*batch.columns, "verdict", "next_version")


def faults(batch: DataFrame) -> DataFrame:
    """batch with fault: the first thing wrong with a record, null if none. Text is named and not blank, the three clocks are in
    order (fetched no earlier than as_of, published no later than fetched), versions count from 1."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    day = F.to_date("as_of")
    rules = [
        ("source", blank("source")), ("series_id", blank("series_id")), ("as_of", F.col("as_of").isNull()), ("fetched_at", F.col("fetched_at").isNull()), ("fetched_before_as_of", F.to_date("fetched_at") < day),
        ("published_after_fetched", F.col("published_at") > F.col("fetched_at")), ("version", F.coalesce(F.col("version") < 1, F.lit(True))),
    ]
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return batch.withColumn("fault", out)


def nearly(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """Whether two numbers are the same for a noisy column: both null, or apart by at most the share of the larger."""
    close = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * tolerance
    return (a.isNull() & b.isNull()) | F.coalesce(close, F.lit(False))


class Store:
    """Datasets as Parquet folders root/layer/dataset, partitioned by source and year of as_of, compressed with zstd.

    noisy names columns, by dataset, whose values count as unchanged within a relative tolerance. A write judges the batch
    once, into a staged table beside the datasets, and appends from there: one job, all or nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], noisy: dict[str, tuple[str, ...]] | None = None) -> None:
        for name, schema in schemas.items():
            if missing := MANDATORY - set(schema.names):
                raise ValueError(f"{name} lacks {sorted(missing)}")
            if not re.fullmatch(r"[a-z]+\.[a-z][a-z0-9_]*", name):
                raise ValueError(f"{name} is no layer.dataset")
        self.spark, self.root, self.schemas, self.noisy = spark, root.rstrip("/"), schemas, noisy or {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _partitions(self, name: str) -> DataFrame:
        """All revisions with the columns _source and _year, whose values prune folders."""
        schema = self.schemas[name]
        wide = T.StructType([*schema.fields, T.StructField("_source", T.StringType()), T.StructField("_year", T.IntegerType())])
        fs, at = self._fs(self.path(name))
        return self.spark.read.schema(wide).parquet(self.path(name)) if fs.exists(at) else self.spark.createDataFrame([], wide)

    def read(self, name: str, source: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
        """All revisions; a column that older files lack is null; a dataset never written is empty. Source and years read their folders only."""
        df = self._partitions(name)
        if source is not None:
            df = df.where(F.col("_source") == source)
        if years is not None:
            df = df.where(F.col("_year").between(*years))
        return df.select(*self.schemas[name].names)

    def datasets(self, layer: str) -> list[str]:
        """The declared datasets of a layer that have been written."""
        return sorted(n for n in self.schemas if n.startswith(f"{layer}.") and (lambda f: f[0].exists(f[1]))(self._fs(self.path(n))))

    def layout(self, name: str) -> list[tuple[str, str]]:
        """(column, what is wrong) of the files' merged footers against the declaration: unknown, missing or of another type."""
        fs, at = self._fs(self.path(name))
        if not fs.exists(at):
            return []
        found = {f.name: f.dataType.simpleString() for f in self.spark.read.option("mergeSchema", True).parquet(self.path(name)).schema if f.name not in ("_source", "_year")}
        declared = {f.name: f.dataType.simpleString() for f in self.schemas[name]}
        wrong = [(c, "unknown") for c in found if c not in declared] + [(c, f"{found[c]} for {declared[c]}") for c in found if c in declared and found[c] != declared[c]]
        return sorted(wrong + [(c, "missing") for c in MANDATORY if c not in found])

    def current(self, name: str) -> DataFrame:
        return current(self.read(name))

    def read_pit(self, name: str, at: str, series_id: str | None = None) -> DataFrame:
        df = self.read(name)
        return known_at(df if series_id is None else df.where(F.col("series_id") == series_id), at)

    def touched(self, name: str, batch: DataFrame) -> DataFrame:
        """The revisions in the folders (source and year) that a batch has rows for; joined on the partition columns, these prune the scan."""
        folders = batch.select(F.col("source").alias("_source"), F.year("as_of").alias("_year")).distinct()
        if folders.limit(FOLDERS + 1).count() <= FOLDERS:
            folders = F.broadcast(folders)
        return self._partitions(name).join(folders, ["_source", "_year"]).select(*self.schemas[name].names)

    def append(self, name: str, batch: DataFrame, revise: bool = False) -> dict[str, int]:
        """Write what is new; changed payloads are refused unless `revise`, then written as next versions."""
        schema = self.schemas[name]
        payload = [c for c in schema.names if c not in MANDATORY]
        batch = batch.select(*schema.names)
        bad = {r["fault"]: r["count"] for r in faults(batch).where("fault is not null").groupBy("fault").count().collect()}
        if bad:
            raise ValueError(f"records break the rules: {bad}")
        if not batch.groupBy(*IDENTITY).count().where("count > 1").isEmpty():
            raise ValueError("an identity repeats in the batch")
        stored = self.touched(name, batch)
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        classified(batch, stored, payload, noisy=self.noisy.get(name, ())).write.parquet(staged)
        judged = self.spark.read.parquet(staged)
        fs, at = self._fs(staged)
        try:
            counts = {r["verdict"]: r["count"] for r in judged.groupBy("verdict").count().collect()}
            if counts.get("revise") and not revise:
                raise ValueError(f"{counts['revise']} rows differ from the stored ones")
            fresh = judged.where("verdict <> 'unchanged'").withColumn("version", F.col("next_version").cast(schema["version"].dataType)).select(*schema.names)
            fresh.withColumns({"_source": F.col("source"), "_year": F.year("as_of")}).write.mode("append").option("compression", "zstd").partitionBy("_source", "_year").parquet(self.path(name))
        finally:
            fs.delete(at, True)
        return counts

    def replace(self, name: str, batch: DataFrame) -> dict[str, int]:
        """Supersede rows of a derived dataset; what is raw is never replaced."""
        if name.startswith("raw."):
            raise ValueError(f"{name} is raw")
        return self.append(name, batch, revise=True)

    def sql(self, query: str) -> DataFrame:
        """SQL over the current rows of every dataset, as views named layer_dataset."""
        for name in self.schemas:
            self.current(name).createOrReplaceTempView(name.replace(".", "_"))
        return self.spark.sql(query)
