"""Landed files and payloads as tables: series observations with vintages, articles, feeds, price files, ticks."""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from datetime import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
OBSERVATIONS = "array<struct<realtime_start:string,realtime_end:string,date:string,value:string>>"


def parsed_observations(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(series_id, date, realtime_start, value) of JSON payloads (series_id, payload) with a list `observations`."""
    lists = payloads.select("series_id", F.from_json(payload, f"observations {OBSERVATIONS}").alias("x"))
    rows = lists.select("series_id", F.explode("x.observations").alias("o"))
    return rows.select("series_id", F.to_date("o.date").alias("date"), F.to_date("o.realtime_start").alias("realtime_start"), as_number(F.col("o.value")).alias("value"))


def as_number(value: Column, missing: str = ".") -> Column:
    """A number written as text; the marker for a missing one, and whatever is no number, become null."""
    plain = F.regexp_extract(F.trim(value), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$", 0)
    return F.when((F.trim(value) != missing) & (plain != ""), plain.cast("double"))


def first_vintages(observations: DataFrame) -> DataFrame:
    """(series_id, date, realtime_start, value): of each date the earliest vintage that has a value; dates without any stay, null."""
    known = F.col("value").isNotNull()
    return observations.groupBy("series_id", "date").agg(F.min_by(F.when(known, F.struct("realtime_start", "value")), F.when(known, F.col("realtime_start"))).alias("x")).select("series_id", "date", "x.realtime_start", "x.value")


def published(day: Column, hour: Column, zone: str = NEW_YORK) -> Column:
    """The instant of a local hour on a release day; null without a declared hour (HH:mm:ss)."""
    return F.when(hour.isNotNull(), F.to_utc_timestamp(F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), hour)).cast("timestamp"), zone))


ARTICLES = "articles array<struct<url:string,title:string,seendate:string,domain:string>>"


def parsed_articles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(feed, title, url, published_at) of JSON payloads (feed, payload) with a list `articles`; incomplete ones are left out."""
    rows = payloads.select("feed", F.explode(F.from_json(payload, ARTICLES)["articles"]).alias("a"))
    when = F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    got = rows.select("feed", F.col("a.title").alias("title"), F.col("a.url").alias("url"), when.alias("published_at"))
    return got.where("title is not null and trim(title) <> '' and url is not null and published_at is not null")


def parsed_feed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(feed, title, url, published_at) of RSS payloads (feed, payload); items without a title or a readable date are left out."""
    schema = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string>>>>"
    rows = payloads.select("feed", F.explode(F.from_xml(payload, schema)["channel"]["item"]).alias("i"))
    clock = F.regexp_replace("i.pubDate", r"^[A-Za-z]+,\s*", "")
    when = F.coalesce(F.try_to_timestamp(clock, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(clock, "GMT|UTC", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    return rows.select("feed", F.trim("i.title").alias("title"), F.col("i.link").alias("url"), when.alias("published_at")).where("title is not null and title <> '' and published_at is not null")


PRICES = "Date date, Open double, High double, Low double, Close double, Volume double"


def read_prices(spark: SparkSession, path: str, symbols: dict[str, str] | None = None) -> DataFrame:
    """(series_id, session, open, high, low, close, volume) of price files Date,Open,High,Low,Close,Volume named by symbol.

    A file that isn't one (a block page) has no readable row: such rows are left out, and `blocked` lists the files.
    """
    raw = spark.read.schema(PRICES).option("header", True).option("mode", "PERMISSIVE").csv(path).withColumn("_f", F.input_file_name())
    symbol = F.lower(F.regexp_extract("_f", r"([^/]+)\.csv$", 1))
    name = symbol
    for s, series in (symbols or {}).items():
        name = F.when(symbol == s.lower(), series).otherwise(name)
    got = raw.select(name.alias("series_id"), F.col("Date").alias("session"), *(F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")))
    return got.where("session is not null")


def blocked(spark: SparkSession, path: str) -> DataFrame:
    """(file) of price files that are pages of markup."""
    head = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return head.where(F.lower(F.substring(F.ltrim("value"), 1, 200)).rlike("<!doctype|<html")).select("file")


#: A tick: milliseconds in the hour, ask and bid in points, their volumes; big-endian.
_TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])


def decoded_ticks(files: DataFrame, scale: float) -> DataFrame:
    """(series_id, at, ask, bid) of files (series_id, hour, content) of packed ticks of an hour; an empty file has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                raw = lzma.decompress(row.content) if row.content else b""
                if len(raw) % _TICK.itemsize:
                    raise ValueError("a tick file ends within a tick")
                t = np.frombuffer(raw, _TICK)
                at = np.datetime64(pd.Timestamp(row.hour).to_datetime64(), "ms") + t["ms"].astype("timedelta64[ms]")
                if len(t):
                    yield pd.DataFrame({"series_id": row.series_id, "at": at.astype("datetime64[ns]"), "ask": t["ask"].astype(float) / scale, "bid": t["bid"].astype(float) / scale})

    return files.select("series_id", "hour", "content").mapInPandas(run, "series_id string, at timestamp, ask double, bid double")


def last_tick(ticks: DataFrame, at: Column) -> DataFrame:
    """(series_id, at, ask, bid) of the last tick of each series up to the instant."""
    return ticks.where(F.col("at") <= at).groupBy("series_id").agg(F.max_by(F.struct("at", "ask", "bid"), "at").alias("x")).select("series_id", "x.*")


def premarket_gap(ticks: DataFrame, closes: DataFrame, clock: str = "08:45:00", zone: str = NEW_YORK, order: tuple[str | Column, ...] = ("at",)) -> DataFrame:
    """(series_id, session, at, last, close, gap_pct): the last price up to a local time before the open against the close before.

    ticks: (series_id, at, price); closes: (series_id, session, previous_close). A session without a tick has nulls. A fraction of a
    second after the time is after it. order: columns of ticks, the last in which counts; beyond `at` they tell ticks of one instant apart.
    """
    local = F.from_utc_timestamp(F.col("at").cast("timestamp"), zone)
    until = time.fromisoformat(clock).isoformat("microseconds")
    before = ticks.where(F.date_format(local, "HH:mm:ss.SSSSSS") <= until).where("price > 0")
    early = before.groupBy("series_id", F.to_date(local).alias("session")).agg(F.max_by(F.struct("at", "price"), F.struct(*order)).alias("x"))
    got = closes.join(early, ["series_id", "session"], "left")
    return got.select("series_id", "session", "x.at", F.col("x.price").alias("last"), F.col("previous_close").alias("close"), ((F.try_divide(F.col("x.price"), F.col("previous_close")) - 1) * 100).alias("gap_pct"))
