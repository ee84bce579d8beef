"""Session simulation: exits inside the bar, walk-forward runs over a split plan, the random control."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import positive
from tidemark.operators import costs


def geometry_faults(decided: DataFrame) -> DataFrame:
    """Rows whose barriers are not both or neither, or do not enclose the open on the right sides."""
    one = F.col("stop_px").isNull() != F.col("target_px").isNull()
    long = (F.col("stop_px") < F.col("open")) & (F.col("open") < F.col("target_px"))
    short = (F.col("target_px") < F.col("open")) & (F.col("open") < F.col("stop_px"))
    wrong = ((F.col("side") > 0) & ~long) | ((F.col("side") < 0) & ~short)
    return decided.where((F.col("side") != 0) & (one | F.coalesce(wrong, F.lit(False))))


def exits(decided: DataFrame, path: DataFrame) -> DataFrame:
    """decided (series_id, session, open, close, side, stop_px, target_px) with exit_px, exit_reason and exit_bar.

    path: (series_id, session, k, high, low), the bars of a session in the order of k from 0; the first bar whose range holds
    a barrier ends the trade there, the stop before the target. Without barriers, or without a touch, it ends at the
    close; without a usable close it has no exit. Bars meet the barriers row by row; the first touch is one aggregation.
    """
    key = ["series_id", "session"]
    bars = path.join(decided.where("side <> 0").select(*key, "stop_px", "target_px"), key)
    holds = lambda level: F.coalesce((F.col("low") <= F.col(level)) & (F.col(level) <= F.col("high")), F.lit(False))
    what = F.when(holds("stop_px"), F.lit("stop")).when(holds("target_px"), F.lit("target"))
    first = bars.withColumn("what", what).where("what is not null").groupBy(*key).agg(F.min(F.struct("k", "what")).alias("hit"))
    df = decided.join(first, key, "left")
    close = positive(F.col("close"))
    px = F.when(F.col("hit.what") == "stop", F.col("stop_px")).when(F.col("hit.what") == "target", F.col("target_px")).otherwise(close)
    reason = F.when(F.col("hit").isNotNull(), F.col("hit.what")).when(close.isNotNull(), F.lit("session_close"))
    return df.withColumns({"exit_px": px, "exit_reason": reason, "exit_bar": F.col("hit.k")}).drop("hit")


def day_path(bars: DataFrame) -> DataFrame:
    """The path of sessions known by their range alone: one bar."""
    return bars.where((positive(F.col("low")).isNotNull()) & (F.col("low") <= F.col("high"))).select("series_id", "session", F.lit(0).cast("long").alias("k"), "high", "low")


def outcomes(decided: DataFrame, path: DataFrame, slippage=None) -> DataFrame:
    """decided (with notional) with status, exit, gross, pnl_declared and pnl_net, as shares of the notional.

    No side is `no_trade`, with no result; an unusable open, or no exit, is `skipped`. The declared costs of a round trip
    without a night are taken off; net is null where the slippage is not known.
    """
    got = costs.charged(exits(decided, path).withColumn("nights", F.lit(0)), slippage=slippage)
    start = positive(F.col("open"))
    status = F.when(F.col("side") == 0, "no_trade").when(start.isNull() | F.col("exit_px").isNull(), "skipped").otherwise("traded")
    got = got.withColumn("status", status)
    traded = lambda x: F.when(F.col("status") == "traded", x)
    gross = traded((F.col("exit_px") / start - 1) * F.col("side"))
    share = lambda pct: F.col(pct).cast("double") / 100
    got = got.withColumn("gross", gross)
    return got.withColumns({"pnl_declared": F.col("gross") - share("declared_pct"), "pnl_net": F.col("gross") - share("total_pct"), "exit_px": traded(F.col("exit_px")), "exit_reason": traded(F.col("exit_reason")), "exit_bar": traded(F.col("exit_bar"))})


def run(plan: DataFrame, decided: DataFrame, path: DataFrame, slippage=None) -> DataFrame:
    """(fold, ...outcomes) of the test rows of a plan (fold, session, role): every fold decides for its own test sessions.

    decided may hold a column fold, one decision a fold; else all folds share the decisions.
    """
    tests = plan.where("role = 'test'").select("fold", "session")
    on = ["fold", "session"] if "fold" in decided.columns else ["session"]
    chosen = decided.join(tests, on)
    return outcomes(chosen, path, slippage)


BASELINES = ("no_trade", "always_long", "always_short", "momentum_5d", "gap_reversal")


def baselines(biased: DataFrame) -> DataFrame:
    """A row for each of the deterministic baselines: (baseline, ..., side), from the columns of labels.bias."""
    side = {"no_trade": F.lit(0), "always_long": F.lit(1), "always_short": F.lit(-1), "momentum_5d": F.col("momentum_5d"), "gap_reversal": F.col("gap_reversal")}
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("baseline"), side[b].cast("int").alias("side")) for b in BASELINES)))
    return biased.withColumn("_b", rows).select("_b.baseline", *biased.columns, "_b.side")


def random_sides(total: int, frequency: Fraction, seed: int) -> list[tuple[int, int]]:
    """(position, side) of floor(frequency * total) positions drawn without replacement, then a side each in ascending order."""
    share = frequency * total
    draw = random.Random(seed)
    chosen = sorted(draw.sample(range(total), share.numerator // share.denominator))
    return [(p, 1 if draw.random() < 0.5 else -1) for p in chosen]


def random_control(sessions: DataFrame, frequency: Fraction, seed: int, most: int = 1_000_000) -> DataFrame:
    """sessions (position, ...) with side: the seeded control trades as often as asked, elsewhere 0.

    The draw is one stream for the whole sample, made where the plan is made; a sample of more than `most` is refused.
    """
    total = sessions.count()
    if total > most:
        raise ValueError(f"more than {most} sessions in one draw")
    drawn = sessions.sparkSession.createDataFrame(random_sides(total, frequency, seed), "position long, side int")
    return sessions.join(F.broadcast(drawn), "position", "left").withColumn("side", F.coalesce("side", F.lit(0)))


def exit_counts(got: DataFrame, *by: str) -> DataFrame:
    """Trades by reason of exit, with the mean, median and sum of their declared result."""
    return got.where("status = 'traded'").groupBy(*by, "exit_reason").agg(F.count("*").alias("n"), F.avg("pnl_declared").alias("mean_pnl"), F.median("pnl_declared").alias("median_pnl"), F.sum("pnl_declared").alias("sum_pnl"))


def conserved(got: DataFrame, *by: str) -> DataFrame:
    """Sessions by status, and whether they add up and only trades have an exit."""
    n = F.count("*")
    count = lambda s: F.count_if(F.col("status") == s)
    return got.groupBy(*by).agg(
        n.alias("n_sessions"), count("traded").alias("n_traded"), count("no_trade").alias("n_no_trade"), count("skipped").alias("n_skipped"),
        ((count("traded") + count("no_trade") + count("skipped") == n) & (F.count("exit_reason") == count("traded"))).alias("sound"),
    )


def mutated(bars: DataFrame, session: str, factor: float) -> DataFrame:
    """bars with the prices of one session multiplied: what depends on it alone may change, nothing before it."""
    hit = F.col("session") == F.lit(session).cast("date")
    price = lambda c: F.when(hit, F.col(c) * factor).otherwise(F.col(c))
    return bars.withColumns({c: price(c) for c in ("open", "high", "low", "close")})


def first_touch_asymmetric(upper: Column, lower: Column) -> Column:
    """Which barrier a bar (high, low) touches: the lower one if it touches both."""
    return F.when(F.col("low") <= lower, F.lit("lower")).when(F.col("high") >= upper, F.lit("upper"))
