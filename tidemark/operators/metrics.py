"""Performance, calibration and forecast statistics as aggregations; seeded resampling in pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import ratio
from tidemark.operators import resampling


def performance(returns: DataFrame, by: str = "series_id", r: str = "net", year: int = 252) -> DataFrame:
    """By series: n, mean, Sharpe (0 if constant), Sortino, profit factor (null without losses), hit rate, moments."""
    x = F.col(r)
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    return returns.where(x.isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean_ret"),
        F.when(F.max(x) == F.min(x), 0.0).otherwise(F.avg(x) / F.stddev_samp(x) * math.sqrt(year)).alias("sharpe"),
        (ratio(F.avg(x), down) * math.sqrt(year)).alias("sortino"),
        ratio(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))).alias("profit_factor"),
        F.avg((x > 0).cast("int")).alias("hit_rate"),
        F.skewness(x).alias("skew"),
        (F.kurtosis(x) + 3).alias("kurt"),
    )


def against_benchmark(returns: DataFrame, r: str, benchmark: str, by: str = "series_id", year: int = 252) -> DataFrame:
    """By series: beta and alpha over a benchmark aligned session by session, mean excess, and the benchmark's own return and Sharpe.

    Without variance of the benchmark beta and alpha are null."""
    x, b = F.col(r), F.col(benchmark)
    df = returns.where(x.isNotNull() & b.isNotNull())
    got = df.groupBy(by).agg(
        F.count("*").alias("n"), F.when(F.max(b) > F.min(b), F.regr_slope(x, b)).alias("beta"), F.avg(x).alias("_s"), F.avg(b).alias("_b"), (F.exp(F.sum(F.log1p(b))) - 1).alias("_t"),
        F.when(F.max(b) == F.min(b), 0.0).otherwise(F.avg(b) / F.stddev_samp(b) * math.sqrt(year)).alias("benchmark_sharpe"),
    )
    return got.select(by, "n", "beta", ((F.col("_s") - F.col("beta") * F.col("_b")) * 100).alias("alpha_pct"), ((F.col("_s") - F.col("_b")) * 100).alias("mean_excess_pct"), (F.col("_t") * 100).alias("benchmark_return_pct"), "benchmark_sharpe")


def trade_statistics(returns: DataFrame, by: str = "series_id", r: str = "net", least_span: int = 30) -> DataFrame:
    """By series of (session, net, traded): sessions and trades, total return, mean trade, mean gain and loss and their ratio, trades a year.

    What has no trades, gains or losses is null; a span under least_span days has no yearly rate."""
    x, t = F.col(r), F.col("traded")
    win, loss = F.avg(F.when(t & (x > 0), x)), F.avg(F.when(t & (x < 0), x))
    span = F.datediff(F.max("session"), F.min("session"))
    trades = F.count_if(t)
    return returns.where(x.isNotNull()).groupBy(by).agg(
        F.count("*").alias("n_sessions"), trades.alias("n_trades"), F.count_if(~t).alias("n_no_trade"), ((F.exp(F.sum(F.log1p(x))) - 1) * 100).alias("total_return_pct"), (F.avg(F.when(t, x)) * 100).alias("ev_per_trade_pct"),
        (win * 100).alias("average_win_pct"), (loss * 100).alias("average_loss_pct"), F.try_divide(win, F.abs(loss)).alias("payoff_ratio"), span.alias("session_span_days"), F.when(span >= least_span, trades * 365.25 / span).alias("trades_per_year"),
    )


def drawdowns(returns: DataFrame, r: str = "net") -> DataFrame:
    """(series_id, session, equity, drawdown, under): equity from 1 (to nine digits, so that flat sessions tie), its distance to the peak, sessions since the peak."""
    w = Window.partitionBy("series_id").orderBy("session")
    df = returns.where(F.col(r).isNotNull()).withColumns({"equity": F.round(F.exp(F.sum(F.log1p(r)).over(w)), 9), "i": F.row_number().over(w)})
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    at = F.coalesce(F.max(F.when(F.col("equity") >= F.col("peak"), F.col("i"))).over(w), F.lit(0))
    return df.select("series_id", "session", "equity", (F.col("equity") / F.col("peak") - 1).alias("drawdown"), (F.col("i") - at).alias("under"))


def calibration(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y) of equal-width bins; empty ones stay, with null means."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    got = forecasts.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    every = forecasts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def probability_scores(forecasts: DataFrame, epsilon: float = 1e-15) -> DataFrame:
    """Brier score and log loss, p clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col("p"), F.lit(epsilon)), F.lit(1 - epsilon))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    return forecasts.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(loss).alias("log_loss"))


def variance_losses(df: DataFrame, forecast: Column, target: Column, by: str = "series_id") -> DataFrame:
    """QLIKE and mean squared log error over rows where both are above 0."""
    rows = df.select(by, forecast.alias("f"), target.alias("y")).where("f > 0 and y > 0")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.log("f") + F.col("y") / F.col("f")).alias("qlike"), F.avg(F.pow(F.log("f") - F.log("y"), 2)).alias("mse_log"))


def rank_correlation(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Spearman's correlation with average ranks."""
    rows = df.select(by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0
    return rows.withColumns({"rx": rank(x), "ry": rank(y)}).groupBy(by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def bootstrap(returns: DataFrame, by: str = "series_id", r: str = "net", draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(series, lo, hi): percentile interval of the mean from seeded draws."""
    return resampling.interval(returns, "mean", (by,), r, draws=draws, seed=seed, level=level).select(by, "lo", "hi")


def har_forecasts(features: DataFrame, least: int = 22) -> DataFrame:
    """(series_id, session, har_forecast): exp of the log variance by least squares on the lagged variances of the rows before, refit each row.

    The normal equations are running sums along the series, solved for all its rows at once; a row without full rank or
    with fewer than `least` rows before it has no forecast.
    """
    lags = ["har_lag1", "har_lag4", "har_lag17"]

    def logs(x: np.ndarray) -> np.ndarray:
        return np.log(x, where=x > 0, out=np.full(x.shape, np.nan))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        x, y = pdf[lags].to_numpy(float), logs(pdf["parkinson_rv"].to_numpy(float))
        scale = np.nanmax(np.abs(np.where(np.isfinite(x), x, np.nan)), axis=0, initial=0.0)  # near 1; a fit does not depend on it
        x = x / np.where(scale > 0, scale, 1.0)
        row = np.column_stack([np.ones(len(x)), x])
        ready = np.isfinite(row).all(axis=1)
        known = ready & np.isfinite(y)
        used = np.where(known[:, None], row, 0.0)
        before = lambda sums: np.concatenate([np.zeros_like(sums[:1]), sums[:-1]])
        n = before(np.cumsum(known))
        a = before(np.cumsum(used[:, :, None] * used[:, None, :], axis=0))
        b = before(np.cumsum(used * np.where(known, y, 0.0)[:, None], axis=0))
        at = np.flatnonzero(ready & (n >= least))
        at = at[np.linalg.matrix_rank(a[at]) == 4] if len(at) else at
        out = np.full(len(x), np.nan)
        if len(at):
            out[at] = np.exp((row[at] * np.linalg.solve(a[at], b[at][:, :, None])[:, :, 0]).sum(axis=1))
        return pd.DataFrame({"series_id": pdf["series_id"], "session": pdf["session"], "har_forecast": out})

    got = features.select("series_id", "session", "parkinson_rv", *lags).groupBy("series_id").applyInPandas(run, "series_id string, session date, har_forecast double")
    return got.withColumn("har_forecast", F.when(~F.isnan("har_forecast"), F.col("har_forecast")))
