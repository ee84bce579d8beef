"""Headlines and events known at an instant: windows, duplicates, batches, merges with what is declared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import like_one_kept, normalised, suspicious, title_hash

HOURS, FUZZY = 24, 0.9


def prepared(headlines: DataFrame) -> DataFrame:
    """headlines (title, published_at, ...) with normal, headline_hash and suspicious."""
    df = headlines.withColumn("normal", normalised("title"))
    return df.withColumns({"headline_hash": title_hash(F.col("normal")), "suspicious": suspicious(F.col("title"), F.col("normal"))})


def in_window(headlines: DataFrame, at: str, hours: int = HOURS) -> DataFrame:
    """Those published in the hours up to the instant, both ends included."""
    when = F.lit(at).cast(headlines.schema["published_at"].dataType)
    return headlines.where(F.col("published_at").between(when - F.expr(f"INTERVAL {hours} HOURS"), when))


def first_of_each(prepared_: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """prepared rows with duplicate: another of the same hash came before (by published_at, then title), or it is in known (headline_hash)."""
    order = Window.partitionBy("headline_hash").orderBy("published_at", "title")
    df = prepared_.withColumn("duplicate", F.row_number().over(order) > 1)
    if known is not None:
        seen = known.select("headline_hash").distinct().withColumn("_known", F.lit(True))
        df = df.join(seen, "headline_hash", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("_known", F.lit(False))).drop("_known")
    return df


def nearly_same(fresh: DataFrame, threshold: float = FUZZY, by: str = "block", order: tuple[str, ...] = ("published_at", "title")) -> DataFrame:
    """fresh rows (block, published_at, title, normal) with near_duplicate: too similar to a title kept before it in its block.

    The rule depends on the order, so a block is one task; a block is what the caller can bound, such as an hour of a feed.
    Equal rows of the order count as they come: give it a column that tells them apart. Rows without normal are like none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold: over 0 and at most 1")
    kind = fresh.schema.simpleString()[len("struct<") : -1]

    def run(rows: pa.Table) -> pa.Table:
        ranked = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_end")
        normals = rows["normal"].take(ranked).to_pylist()
        first = list(dict.fromkeys(t for t in normals if t is not None))
        near = dict(zip(first, like_one_kept(first, threshold), strict=True))
        flags = np.zeros(len(normals), bool)
        for at, normal in zip(ranked.to_pylist(), normals, strict=True):
            if normal is not None:
                flags[at], near[normal] = near[normal], True
        return rows.append_column("near_duplicate", pa.array(flags))

    return fresh.groupBy(by).applyInArrow(run, f"{kind}, near_duplicate boolean")


def batch(headlines: DataFrame, at: str, known: DataFrame | None = None, hours: int = HOURS, most_chars: int = 200) -> DataFrame:
    """The new headlines of the window, each once, titles cut to most_chars; what is published after the instant never counts."""
    fresh = first_of_each(in_window(prepared(headlines), at, hours), known).where("not duplicate")
    return fresh.withColumn("title", F.substring("title", 1, most_chars)).drop("duplicate")


def batch_counts(headlines: DataFrame, at: str, known: DataFrame | None = None, hours: int = HOURS) -> DataFrame:
    """(n, n_future, n_old, n_window, n_duplicate, n_new) of a batch."""
    when = F.lit(at).cast(headlines.schema["published_at"].dataType)
    late, old = F.col("published_at") > when, F.col("published_at") < when - F.expr(f"INTERVAL {hours} HOURS")
    marked = first_of_each(in_window(prepared(headlines), at, hours), known)
    within = marked.agg(F.count("*").alias("n_window"), F.count_if("duplicate").alias("n_duplicate"), F.count_if(~F.col("duplicate")).alias("n_new"))
    return headlines.agg(F.count("*").alias("n"), F.count_if(late).alias("n_future"), F.count_if(old).alias("n_old")).crossJoin(within)


def earnings_known(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, symbol, moment, certainty): the last observation up to as_of of each symbol that has an event on the session.

    observations: (symbol, event_date, moment, certainty, observed_at); sessions: (session, as_of)."""
    got = observations.join(sessions, F.col("event_date") == F.col("session")).where(F.col("observed_at") <= F.col("as_of"))
    return got.groupBy("session", "symbol").agg(F.max_by(F.struct("moment", "certainty"), F.struct("observed_at", "moment", "certainty")).alias("x")).select("session", "symbol", "x.*")


def merged_events(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(symbol, event_date, certainty, origin) of observed and declared events (symbol, event_date): declared ones are confirmed,
    observed ones estimated unless declared."""
    o, d = observed.select("symbol", "event_date").distinct().withColumn("_o", F.lit(True)), declared.select("symbol", "event_date").distinct().withColumn("_d", F.lit(True))
    both = o.join(d, ["symbol", "event_date"], "full_outer")
    origin = F.when(F.col("_o") & F.col("_d"), "both").when(F.col("_d"), "declared").otherwise("observed")
    return both.select("symbol", "event_date", F.when(F.col("_d"), "confirmed").otherwise("estimated").alias("certainty"), origin.alias("origin"))


def publications(observations: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """(day, series_id, first_published): the series published on each local day, at their first instant of it."""
    day = F.to_date(F.from_utc_timestamp(F.col("published_at").cast("timestamp"), zone))
    return observations.where("published_at is not null").groupBy(day.alias("day"), "series_id").agg(F.min("published_at").alias("first_published"))

