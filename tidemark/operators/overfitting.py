"""How much of a best result is luck: deflated Sharpe ratio, overfitting probability, dominance, paired verdicts."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import resampling

GAMMA = 0.5772156649015329
#: Most block choices that are all taken; more are refused.
MOST_CHOICES = 20_000


def expected_best(n_trials: int, variance: float) -> float:
    """The Sharpe ratio expected of the best of n_trials without skill; 0 without variance."""
    if variance == 0:
        return 0.0
    normal = NormalDist()
    return math.sqrt(variance) * ((1 - GAMMA) * normal.inv_cdf(1 - 1 / n_trials) + GAMMA * normal.inv_cdf(1 - 1 / (n_trials * math.e)))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function."""

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(-x / math.sqrt(2)))

    return cdf(z)


def session_sharpe(x: Column) -> Column:
    return F.when(F.max(x) == F.min(x), 0.0).otherwise(F.avg(x) / F.stddev_samp(x))


def variant_sharpes(returns: DataFrame, by: str = "variant", r: str = "r") -> DataFrame:
    """(variant, n, sharpe) a session, not a year."""
    return returns.groupBy(by).agg(F.count(r).alias("n"), session_sharpe(F.col(r)).alias("sharpe"))


def deflated_sharpe(returns: DataFrame, by: str = "variant", r: str = "r", level: float = 0.95) -> DataFrame:
    """One row for the variant of the highest Sharpe ratio (the least name among equals): its ratio, the best expected of as
    many trials without skill, the deflated ratio and whether it reaches `level`. Null where the moments have no value."""
    x = F.col(r)
    each = returns.groupBy(by).agg(F.count(x).alias("n"), session_sharpe(x).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    best = each.groupBy().agg(F.min_by(F.struct(by, "n", "sharpe", "skew", "kurt"), F.struct(-F.col("sharpe"), F.col(by))).alias("x"), F.count("*").alias("n_trials"), F.when(F.max("sharpe") == F.min("sharpe"), 0.0).otherwise(F.var_samp("sharpe")).alias("sr_variance"))
    best = best.select("x.*", "n_trials", "sr_variance").where("n_trials > 1")

    @F.pandas_udf("double")
    def expected(n: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([expected_best(int(a), float(b)) for a, b in zip(n, v, strict=True)])

    best = best.withColumn("sr0", expected("n_trials", "sr_variance"))
    width = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = F.when(width > 0, (F.col("sharpe") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / F.sqrt(width))
    return best.withColumn("dsr", normal_cdf(z)).withColumn("significant", F.col("dsr") >= level)


def block_moments(returns: DataFrame, blocks: int, by: str = "variant", r: str = "r") -> DataFrame:
    """(block, variant, n, s, q, hi, lo) of contiguous blocks of equal size: returns has (position from 0, variant, r).

    The positions have to be a multiple of blocks."""
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks is even and at least 2")
    total = returns.agg(F.max("position")).first()[0] + 1
    if total % blocks:
        raise ValueError(f"{blocks} blocks don't divide {total} positions")
    x = F.col(r)
    block = F.floor(F.col("position") / (total // blocks)).cast("int")
    return returns.groupBy(block.alias("block"), by).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.max(x).alias("hi"), F.min(x).alias("lo"))


def overfitting_splits(returns: DataFrame, blocks: int = 16, by: str = "variant", r: str = "r") -> DataFrame:
    """(choice, chosen, omega, best_oos): every choice of half the blocks as in-sample, the variant it picks (the least name
    among equals) and its rank out of sample over variants + 1, ties averaged. Ratios come from block moments alone."""
    if math.comb(blocks, blocks // 2) > MOST_CHOICES:
        raise ValueError("more choices of blocks than are taken at all")
    moments = block_moments(returns, blocks, by, r)
    halves = [(k, list(c)) for k, c in enumerate(itertools.combinations(range(blocks), blocks // 2))]
    table = returns.sparkSession.createDataFrame(halves, "choice int, inside array<int>")
    each = table.crossJoin(F.broadcast(moments)).withColumn("side", F.array_contains("inside", F.col("block")))
    parts = each.groupBy("choice", by, "side").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    parts = parts.withColumn("sharpe", F.when((F.col("hi") == F.col("lo")) | (deviation == 0), 0.0).otherwise(mean / deviation))
    both = parts.groupBy("choice", by).agg(F.max(F.when(F.col("side"), F.col("sharpe"))).alias("within"), F.max(F.when(~F.col("side"), F.col("sharpe"))).alias("beyond"))
    choice = Window.partitionBy("choice")
    rank = F.rank().over(choice.orderBy("beyond")) + (F.count("*").over(Window.partitionBy("choice", "beyond")) - 1) / 2.0
    both = both.withColumns({"rank": rank, "n": F.count("*").over(choice)})
    picked = both.groupBy("choice").agg(F.min_by(F.struct(F.col(by).alias("chosen"), (F.col("rank") / (F.col("n") + 1)).alias("omega"), F.col("beyond").alias("best_oos")), F.struct(-F.col("within"), F.col(by))).alias("x"))
    return picked.select("choice", "x.*")


def overfitting_probability(splits: DataFrame, most: float = 0.5) -> DataFrame:
    """(n_choices, pbo, omega_median, logit_median, best_oos_median, detected): the share of choices whose pick is no better than
    the median out of sample. The choices are at most MOST_CHOICES rows."""
    logit = F.log(F.col("omega") / (1 - F.col("omega")))
    return splits.agg(F.count("*").alias("n_choices"), F.avg((logit <= 0).cast("int")).alias("pbo"), F.median("omega").alias("omega_median"), F.median(logit).alias("logit_median"), F.median("best_oos").alias("best_oos_median")).withColumn("detected", F.col("pbo") >= most)


def dominance(differences: DataFrame, levels: list[float], by: str = "series_id", d: str = "d") -> DataFrame:
    """(series, level, n, mean, t_value, monotone): results less a cost level each; the mean has to fall as the level rises."""
    grid = differences.sparkSession.createDataFrame([(x,) for x in levels], "level double")
    got = differences.crossJoin(F.broadcast(grid)).withColumn("net", F.col(d) - F.col("level")).groupBy(by, "level").agg(F.count("net").alias("n"), F.avg("net").alias("mean"), (F.avg("net") / (F.stddev_samp("net") / F.sqrt(F.count("net")))).alias("t_value"))
    line = Window.partitionBy(by).orderBy("level")
    return got.withColumn("monotone", F.coalesce(F.col("mean") < F.lag("mean").over(line), F.lit(True)))


def paired_verdict(pairs: DataFrame, by: str, control: str, candidate: str, tolerance: float = 1.0) -> DataFrame:
    """(group, n, mean_d, se_d, verdict): improves, worsens or no_difference of candidate over control by the mean difference against
    tolerance standard errors. Pairs with a null don't count."""
    d = F.col(candidate) - F.col(control)
    got = pairs.groupBy(by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_d"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se_d"))
    verdict = F.when(F.col("mean_d") > tolerance * F.col("se_d"), "improves").when(F.col("mean_d") < -tolerance * F.col("se_d"), "worsens").otherwise("no_difference")
    return got.withColumn("verdict", verdict)


def redundant_feature(matrix: DataFrame, candidate: str, control: list[str]) -> DataFrame:
    """(feature, r): of the control columns the one most correlated with the candidate, by absolute value; constant ones count as 0."""
    r = lambda c: F.coalesce(F.corr(candidate, c), F.lit(0.0))
    got = matrix.agg(*(r(c).alias(c) for c in control))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"), F.lit(k).alias("k")) for k, c in enumerate(control)))).alias("x")).groupBy().agg(F.max_by("x", F.struct(F.abs("x.r"), -F.col("x.k"))).alias("x")).select("x.feature", "x.r")


def intervals(returns: DataFrame, statistic: str, by: str = "series_id", r: str = "net", order: str = "session", draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(series, lo, hi): percentile interval of a statistic (mean, sharpe, sortino) from seeded draws."""
    return resampling.interval(returns, statistic, (by,), r, order, draws, seed, level).select(by, "lo", "hi")
