"""Data quality: first-hit rejection, runs of stale closes, missing weekdays, comparison of sources, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import lag, series
from tidemark.functions.order_statistics import quantiles


def rejected(bars: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """bars with reject_code: the first rule that holds, null where none does."""
    code = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        code = F.when(rule, F.lit(name)).otherwise(code)
    return bars.withColumn("reject_code", code)


def bar_rules(volume_expected: bool = False, session_hours: Column | None = None) -> list[tuple[str, Column]]:
    """The rules in order, (code, condition); the first that holds names the rejection.

    All copies of a repeated (series_id, session) are rejected. Null volume counts where it is expected; session_hours,
    the local time of an intraday bar, has to lie within the session.
    """
    copies = F.count("*").over(Window.partitionBy("series_id", "session"))
    rules = [
        ("duplicate", copies > 1),
        ("null_ohlc", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()),
        ("ohlc_incoherent", (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))),
        ("negative_volume", F.col("volume") < 0),
    ]
    if volume_expected:
        rules.append(("null_volume", F.col("volume").isNull()))
    if session_hours is not None:
        rules.append(("out_of_window", ~F.date_format(session_hours, "HH:mm:ss").between("09:30:00", "16:00:00")))
    return rules


def stale_runs(bars: DataFrame, least: int = 5, days: int = 4, value: str = "close") -> DataFrame:
    """(series_id, run_from, run_to, n): runs of `least` sessions or more of one value, at most `days` days apart."""
    new = F.coalesce((F.col(value) != lag(value)) | (F.datediff("session", lag("session")) > days), F.lit(True))
    df = bars.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(series()))
    runs = df.groupBy("series_id", "run").agg(F.min("session").alias("run_from"), F.max("session").alias("run_to"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("run")


def weekday_gaps(bars: DataFrame) -> DataFrame:
    """(series_id, session) of the weekdays without a bar between the first and the last one."""
    span = bars.groupBy("series_id").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    days = span.select("series_id", F.explode(F.sequence("a", "b")).alias("session")).where(F.weekday("session") < 5)
    return days.join(bars.select("series_id", "session"), ["series_id", "session"], "left_anti")


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance_bp: float = 10.0) -> DataFrame:
    """Rows of both sides whose values differ by more than the tolerance, in basis points of the right one."""
    r = right.select(*keys, F.col(value).alias("right_value"))
    both = left.select(*keys, F.col(value).alias("left_value")).join(r, keys)
    return both.withColumn("diff_bp", F.try_divide(F.abs(F.col("left_value") - F.col("right_value")), F.abs("right_value")) * 1e4).where(F.col("diff_bp") > tolerance_bp)


def stale_open_share(bars: DataFrame) -> DataFrame:
    """By series and year: sessions, share whose open is the close before, and the worst share of this and later years."""
    df = bars.withColumns({"year": F.year("session"), "stale": F.coalesce(F.col("open") == lag("close"), F.lit(False))})
    by = df.groupBy("series_id", "year").agg(F.count("*").alias("n"), F.avg(F.col("stale").cast("int")).alias("share"))
    later = Window.partitionBy("series_id").orderBy("year").rowsBetween(0, Window.unboundedFollowing)
    return by.withColumn("worst_from_here", F.max("share").over(later))


def drift_segments(bars: DataFrame, key: Column, name: str) -> DataFrame:
    """By key, in basis points: mean and median of close over open, share above 0, t value, and the compounded return."""
    r = F.col("r")
    df = bars.select(key.alias(name), (F.col("close") / F.col("open") - 1).alias("r"))
    got = df.groupBy(name).agg(F.count("r").alias("n"), (F.avg(r) * 1e4).alias("mean_bp"), F.avg((r > 0).cast("int")).alias("hit_rate"), (F.avg(r) / (F.stddev_samp(r) / F.sqrt(F.count(r)))).alias("t_value"), F.sum(F.log1p(r)).alias("log_total"))
    middle = quantiles(df, [name], r, {"median": 0.5})
    return got.join(middle, name, "left").withColumn("median_bp", F.col("median") * 1e4).drop("median")


def spreads(quotes: DataFrame, tranches: int, declared_pct: float) -> DataFrame:
    """(tranche, n, mean_usd, mean_pct, over_declared_pct) of quotes (tranche, bid, ask); tranches without any stay, with nulls."""
    pct = (F.col("ask") - F.col("bid")) / F.col("bid") * 100
    got = quotes.groupBy("tranche").agg(F.count("*").alias("n"), F.avg(F.col("ask") - F.col("bid")).alias("mean_usd"), F.avg(pct).alias("mean_pct"), (F.avg(pct) - declared_pct).alias("over_declared_pct"))
    every = quotes.sparkSession.range(tranches).select(F.col("id").cast("int").alias("tranche"))
    return every.join(got, "tranche", "left").withColumn("n", F.coalesce("n", F.lit(0)))
