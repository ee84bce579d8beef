"""The driver tables in the shapes the operators take: session bars, observations, revisions, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, series: Column, day: Column, price: str, order: str) -> DataFrame:
    """(series_id, session, open, high, low, close, volume) of ticks. One aggregation, combined before the shuffle."""
    return ticks.groupBy(series.alias("series_id"), day.cast("date").alias("session")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume")
    )


def order_bars(spark: SparkSession, sf_dir: str, anchor: bool = False) -> DataFrame:
    """Bars by order priority, or of all orders as the series `anchor`."""
    series = F.lit("anchor") if anchor else F.col("o_orderpriority")
    return bars(table(spark, sf_dir, "orders"), series, F.col("o_orderdate"), "o_totalprice", "o_orderkey")


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return bars(joined, F.col("c_mktsegment"), F.col("o_orderdate"), "o_totalprice", "o_orderkey")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, reference, published, value), one observation a reference date: the latest published, then the largest."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("reference"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber")).alias("published"), F.col("l_extendedprice").alias("value")
    )
    best = raw.groupBy("series_id", "reference").agg(F.max(F.struct("published", "value")).alias("x"))
    return best.select("series_id", "reference", "x.published", "x.value")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a bitemporal table: source, series_id, as_of, fetched_at, published_at, version, value."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    version = F.row_number().over(Window.partitionBy("event_type", "user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return e.select(
        F.col("event_type").alias("source"), F.col("user_id").alias("series_id"), F.to_date("ts").alias("as_of"), F.col("ts").alias("fetched_at"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("published_at"), version.alias("version"), "value"
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p, y): a made probability and the outcome."""
    d, y = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(y, "doc_id").select("doc_id", ((F.col("n_chars") % 100) / 100.0 + 0.005).alias("p"), F.col("quality").alias("y"))


#: Names of the series that orders are dealt to: by priority, by region of the customer, by status.
BY_PRIORITY = ("DAX", "FTSE", "STOXX", "NIKKEI", "HSI")
BY_REGION = ("DXY", "VIX", "VIX9D", "VIX3M", "OIL")
BY_STATUS = {"O": "GOLD", "F": "EURUSD"}


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an anchor (SPX, all orders), of markets, terms and goods on calendars of their own, and of sectors, in one table.

    An order counts for each of its series; bars are one aggregation, combined before the shuffle.
    """
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    names = lambda xs: F.array(*map(F.lit, xs))
    status = F.when(F.col("o_orderstatus") == "O", BY_STATUS["O"]).when(F.col("o_orderstatus") == "F", BY_STATUS["F"])
    series = F.array(F.lit("SPX"), F.get(names(BY_PRIORITY), F.substring("o_orderpriority", 1, 1).cast("int") - 1), F.get(names(BY_REGION), F.col("n_regionkey")), status, F.concat(F.lit("SECTOR:"), F.col("c_mktsegment")))
    rows = rows.select("o_orderdate", "o_orderkey", "o_totalprice", F.explode(series).alias("s")).where("s is not null")
    return bars(rows, F.col("s"), F.col("o_orderdate"), "o_totalprice", "o_orderkey")


BY_LINE = ("DFF", "DGS10", "DGS2", "T10Y2Y", "CPIAUCSL", "PCEPI", "UNRATE")


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, reference, published, value) by line number: published as many days after the reference, the largest value of a day."""
    day = F.col("l_shipdate").cast("date")
    raw = table(spark, sf_dir, "lineitem")
    return raw.groupBy(F.get(F.array(*map(F.lit, BY_LINE)), F.col("l_linenumber") - 1).alias("series_id"), day.alias("reference"), F.date_add(day, F.col("l_linenumber")).alias("published")).agg(F.max("l_extendedprice").alias("value"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a source might send them, by customer and day, with repeats, gaps and faults."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    close = p * (1 + (k % 7 - 3) / 100)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderdate").cast("date").alias("session"), F.when(k % 11 != 0, p).alias("open"), (F.greatest(p, close) * (1 + (k % 5 - 1) / 100)).alias("high"), (F.least(p, close) * 0.99).alias("low"), close.alias("close"), F.when(k % 17 != 0, k % 13 - 1).alias("volume")
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, feed, title, url, published_at): the first line of each document, cut to 80 characters, published as many minutes after a day as its id says."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    at = F.expr("timestampadd(MINUTE, CAST(doc_id % 4000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    return d.select("doc_id", F.col("source").alias("feed"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"), at.alias("published_at"))


def positions(bars_: DataFrame) -> DataFrame:
    """(position, session, horizon) of one series' sessions in order: the horizon is 0, 1 or 2."""
    from pyspark.sql import Window

    p = (F.row_number().over(Window.partitionBy("series_id").orderBy("session")) - 1).cast("long")
    return bars_.select(p.alias("position"), "session").withColumn("horizon", (F.col("position") % 3).cast("int"))
