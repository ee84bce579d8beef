"""Feature families over session bars (series_id, session, open, high, low, close, volume)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import START, full, lag, log_return, ratio, rows, series
from tidemark.functions.order_statistics import scored


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def volatility(bars: DataFrame) -> DataFrame:
    """true_range, atr_norm, parkinson_rv, ret_log, ret_sq and the HAR regressors, which are null until the longest is full."""
    df = bars.withColumns({"true_range": true_range(), "parkinson_rv": F.pow(F.log(F.col("high") / F.col("low")), 2) / (4 * math.log(2)), "ret_log": F.log(F.col("close") / F.col("open"))})
    tr, rv = F.col("true_range"), F.col("parkinson_rv")
    month = full(F.avg(rv), rv, -22, -6)
    return df.withColumns(
        {
            "ret_sq": F.col("ret_log") * F.col("ret_log"),
            "atr_norm": ratio(full(F.avg(tr), tr, -14, -1), lag("close")),
            "har_lag1": F.when(month.isNotNull(), lag("parkinson_rv")),
            "har_lag4": F.when(month.isNotNull(), full(F.avg(rv), rv, -5, -2)),
            "har_lag17": month,
        }
    )


def level_scores(bars: DataFrame, least: int = 250) -> DataFrame:
    """Yesterday's close as level, its z-score and percentile among the levels before it, given `least` of them."""
    df = bars.withColumn("level", lag("close"))
    past, x = rows(START, -1), F.col("level")
    n = F.count(x).over(past)
    mean = F.avg(x).over(past)
    var = (F.avg(x * x).over(past) - mean * mean) * n / (n - 1)
    df = df.withColumn("level_zscore", F.when((n >= least) & (var > 0), (x - mean) / F.sqrt(var)))
    return scored(df, [("percentile", "level", "level_percentile", least)])


def robust_z(df: DataFrame, *columns: str, least: int = 250) -> DataFrame:
    """Adds column_z: (x - median) / (1.4826 MAD) over the values up to and with the current, null where the MAD is 0."""
    return scored(df, [("robust", c, f"{c}_z", least) for c in columns])


def technical(bars: DataFrame) -> DataFrame:
    """Log returns over 1, 5 and 21 sessions, distance to the 20-session mean, range position and volatility break."""
    df = bars.withColumn("tr", true_range())
    low, high = full(F.min(F.col("low")), F.col("low"), -19, 0), full(F.max(F.col("high")), F.col("high"), -19, 0)
    tr = F.col("tr")
    return df.withColumns(
        {
            "ret_1": log_return(F.col("close"), 1),
            "ret_5": log_return(F.col("close"), 5),
            "ret_21": log_return(F.col("close"), 21),
            "dist_sma_20": ratio(F.col("close"), full(F.avg(F.col("close")), F.col("close"), -19, 0)) - 1,
            "range_pos_20": ratio(F.col("close") - low, high - low),
            "vol_break_20": ratio(tr, full(F.avg(tr), tr, -20, -1)),
        }
    ).drop("tr")


def wilder_rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    """Adds rsi_14: Wilder's recursion along a series; a null close starts it anew. One step a session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        out, last, n, gain, loss = [], math.nan, 0, 0.0, 0.0
        for close in pdf["close"].to_numpy(float).tolist():
            move, last = close - last, close
            if move != move:
                n, gain, loss = 0, 0.0, 0.0
                out.append(math.nan)
                continue
            n += 1
            up, down = max(move, 0.0), max(-move, 0.0)
            if n <= window:
                gain, loss = gain + up / window, loss + down / window
            else:
                gain, loss = (gain * (window - 1) + up) / window, (loss * (window - 1) + down) / window
            out.append(math.nan if n < window else 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100.0 - 100.0 / (1 + gain / loss))
        return pd.DataFrame({"series_id": pdf["series_id"], "session": pdf["session"], "rsi_14": out})

    got = bars.select("series_id", "session", F.col("close").cast("double")).groupBy("series_id").applyInPandas(run, "series_id string, session date, rsi_14 double")
    return bars.join(got.withColumn("rsi_14", F.when(~F.isnan("rsi_14"), F.col("rsi_14"))), ["series_id", "session"], "left")


def regime(bars: DataFrame) -> DataFrame:
    """Efficiency ratio over 20 sessions, ISO weekday, sessions to the next third-Friday expiry, and the quarterly roll."""
    df = bars.withColumn("step", F.abs(F.col("close") - lag("close")))
    path = full(F.sum("step"), F.col("step"), -19, 0)
    month = F.trunc("session", "month")
    third = F.date_add(F.next_day(F.date_sub(month, 1), "FRI"), 14)
    # The expiry is the last session of the series not after the third Friday of its month.
    last = F.max(F.when(F.col("session") <= third, F.col("session"))).over(Window.partitionBy("series_id", month))
    df = df.withColumns({"i": F.row_number().over(series()), "opex": F.col("session") == last})
    ahead = F.min(F.when(F.col("opex"), F.col("i"))).over(rows(0, Window.unboundedFollowing))
    return df.withColumns(
        {
            "efficiency_ratio_20": ratio(F.abs(F.col("close") - lag("close", 20)), path),
            "day_of_week": F.weekday("session") + 1,
            "sessions_to_opex": ahead - F.col("i"),
            "is_es_roll_session": (F.coalesce(F.col("opex"), F.lit(False)) & F.month("session").isin(3, 6, 9, 12)).cast("int"),
        }
    ).drop("step", "i", "opex")


def reversion(bars: DataFrame, least: int = 250) -> DataFrame:
    """streak_up (consecutive higher closes through yesterday) and the percentile of ret_5 among the earlier ones."""
    df = bars.withColumns({"i": F.row_number().over(series()), "up": F.coalesce(F.col("close") > lag("close"), F.lit(False)), "ret_5": log_return(F.col("close"), 5)})
    broke = F.max(F.when(~F.col("up"), F.col("i"))).over(rows(START, 0))
    df = df.withColumn("run", F.col("i") - broke)
    return scored(df.withColumn("streak_up", lag("run")).drop("i", "up", "run"), [("percentile", "ret_5", "ret_5_pct", least)])


def breadth(bars: DataFrame) -> DataFrame:
    """By session, over all series: their number with a return, the share that rose and the spread of returns."""
    r = bars.select("session", log_return(F.col("close")).alias("r"))
    return r.groupBy("session").agg(F.count("r").alias("n"), F.avg((F.col("r") > 0).cast("int")).alias("breadth"), F.when(F.count("r") >= 2, F.stddev_samp("r")).alias("dispersion"))
