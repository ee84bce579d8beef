"""Repeats within a horizon: the first of its kind counts, what follows within the horizon does not, what comes later is first again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(rows: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """The rows of a table that no kept row of the same key precedes by up to `hours`.

    A stream uses Spark's dropDuplicatesWithinWatermark instead: it keeps the first to arrive, and what repeats after the
    horizon counts again once the watermark has passed the horizon's end. On rows that come at most `hours` late, both keep
    the same keys as often, and the same rows where they come in the order of `at`. Ties of time go by the other columns.
    A table is read in order of key and time by each task, which holds one key and time, however often a key repeats;
    null keys and times are dropped.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    if rows.isStreaming:
        return rows.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark([key])
    kind, span = rows.schema.simpleString()[len("struct<") : -1], pd.Timedelta(hours=hours)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, since = None, None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key], pdf[at], strict=True):
                first = k != held or t - since > span
                if first:
                    held, since = k, t
                keep.append(first)
            yield pdf[keep]

    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.repartition(key).sortWithinPartitions(key, at, *rest).mapInPandas(run, kind)
