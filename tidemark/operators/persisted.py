"""Feature matrices and labels as records of a store, with digests and versions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.digests import row_digest, session_version
from tidemark.sources.store import Store

_CLOCKS = [("source", T.StringType()), ("series_id", T.StringType()), ("as_of", T.DateType()), ("fetched_at", T.TimestampType()), ("published_at", T.TimestampType()), ("version", T.IntegerType())]


def spec_digest(spec: Mapping[str, object]) -> str:
    """SHA-256 of a specification as canonical JSON."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def feature_schema(features: list[str]) -> T.StructType:
    """The dataset of a family: the store's columns, its features, and what identifies their making."""
    extra = [(f, T.DoubleType()) for f in features] + [("family", T.StringType()), ("feature_version", T.StringType()), ("row_sha256", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in (*_CLOCKS, *extra)])


def feature_records(matrix: DataFrame, family: str, features: list[str], spec: Mapping[str, object], series_id: str, fetched_at: str) -> DataFrame:
    """matrix (session, features...) as records: feature_version by specification and session, row_sha256 over the session and its features.

    A session that repeats is an error, raised by the task that meets it; values that are not finite are nulls.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    rows = matrix.select("session", *(value(c).alias(c) for c in features))
    rows = rows.withColumn("row_sha256", row_digest(rows))
    one = rows.groupBy("session").agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in (*features, "row_sha256")))
    one = one.withColumn("session", F.when(F.col("__n") == 1, F.col("session")).otherwise(F.raise_error(F.lit("a session repeats")).cast("date")))
    given = {"source": F.lit("features"), "series_id": F.lit(series_id), "as_of": F.col("session"), "fetched_at": F.lit(fetched_at).cast("timestamp"), "published_at": F.lit(None).cast("timestamp"), "version": F.lit(1), "family": F.lit(family), "feature_version": session_version(spec_digest(spec), F.col("session"))}
    return one.withColumns(given).select(*feature_schema(features).names)


def persist(store: Store, frames: Mapping[str, tuple[DataFrame, list[str]]], specs: Mapping[str, Mapping[str, object]], series_id: str, fetched_at: str, before: str | None = None, layer: str = "derived") -> dict[str, dict[str, int]]:
    """Write each family's matrix (frame, features) to layer.family; verdict counts of each.

    Only sessions that every family has are written, and with `before` only earlier ones. What is stored already and equal
    stays; what changed becomes the next version.
    """
    shared = None
    for df, _ in frames.values():
        days = df.select("session").distinct()
        shared = days if shared is None else shared.join(days, "session", "left_semi")
    if before is not None:
        shared = shared.where(F.col("session") < F.lit(before).cast("date"))
    out = {}
    for family, (df, features) in frames.items():
        records = feature_records(df.join(shared, "session", "left_semi"), family, features, specs[family], series_id, fetched_at)
        out[family] = store.replace(f"{layer}.{family}", records)
    return out


def label_records(labels: DataFrame, series_id: str, fetched_at: str) -> DataFrame:
    """Labels (session, label_long, label_short, ret_long, ret_short) as records with a digest of what they say."""
    said = ["label_long", "label_short", "ret_long", "ret_short"]
    rows = labels.select("session", *said)
    given = {"source": F.lit("labels"), "series_id": F.lit(series_id), "as_of": F.col("session"), "fetched_at": F.lit(fetched_at).cast("timestamp"), "published_at": F.lit(None).cast("timestamp"), "version": F.lit(1), "row_sha256": row_digest(rows)}
    return rows.withColumns(given).select(*(n for n, _ in _CLOCKS), *said, "row_sha256")


def label_schema() -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in (*_CLOCKS, ("label_long", T.StringType()), ("label_short", T.StringType()), ("ret_long", T.DoubleType()), ("ret_short", T.DoubleType()), ("row_sha256", T.StringType()))])
