"""Labels, splits, simulation and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import lag
from tidemark.operators.costs import SPREAD_HALF_PCT

#: The declared spread of a round trip, as a share of the notional.
ROUND_TRIP = 2 * float(SPREAD_HALF_PCT) / 100


def triple_barrier(days: DataFrame, ticks: DataFrame, k: float = 1.0, coverage: float = 0.95) -> DataFrame:
    """Labels of days (session, entry, high, low, close, sigma, expected) by their ticks (session, k, high, low) in the order of k.

    Ticks decide if they cover enough of what is expected, else the day's range does. The first tick that touches a
    barrier decides; one that touches both counts as a stop for either side. Without a touch the exit is the close.
    Ticks meet the barriers of their day row by row, and only the first that touches is kept.
    """
    df = days.withColumns({"upper": F.col("entry") * (1 + F.col("sigma") * k), "lower": F.col("entry") * (1 - F.col("sigma") * k)})
    level = ticks.join(df.select("session", "upper", "lower"), "session")
    touches = (F.col("high") >= F.col("upper")) | (F.col("low") <= F.col("lower"))
    seen = level.groupBy("session").agg(F.count("*").alias("observed"), F.min_by(F.when(touches, F.struct("high", "low")), F.when(touches, F.col("k"))).alias("first"))
    df = df.join(seen, "session", "left")
    enough = F.coalesce((F.col("observed") > 0) & (F.col("observed") >= F.col("expected") * coverage), F.lit(False))
    day = F.when((F.col("high") >= F.col("upper")) | (F.col("low") <= F.col("lower")), F.struct("high", "low"))
    df = df.withColumns({"order_source": F.when(enough, "intraday").otherwise("daily"), "hit": F.when(enough, F.col("first")).otherwise(day)})
    up, down = F.col("hit.high") >= F.col("upper"), F.col("hit.low") <= F.col("lower")
    side = lambda win, lose: F.when(F.col("hit").isNull(), "time").when(lose, "stop").when(win, "target")
    df = df.withColumns({"label_long": side(up, down), "label_short": side(down, up)})
    leave = lambda label, win, lose: F.when(F.col(label) == "target", F.col(win)).when(F.col(label) == "stop", F.col(lose)).otherwise(F.col("close"))
    df = df.withColumns({"exit_long": leave("label_long", "upper", "lower"), "exit_short": leave("label_short", "lower", "upper")})
    return df.withColumns({"ret_long": F.col("exit_long") / F.col("entry") - 1, "ret_short": 1 - F.col("exit_short") / F.col("entry"), "tie": F.coalesce(up & down, F.lit(False))}).drop("hit", "first", "observed")


def label_summary(labels: DataFrame, label: str, ret: str, spread: float = ROUND_TRIP) -> DataFrame:
    """Counts by label, chances of target, stop and gain, mean gain and loss, the expected value, its identity
    p_win * e_gain - (1 - p_win) * e_loss, and the value net of the spread. e_loss is the mean loss as a positive number."""
    r = F.col(ret)
    share = lambda what: F.avg((F.col(label) == what).cast("int"))
    got = labels.groupBy().agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col(label) == what).alias(f"n_{what}") for what in ("target", "stop", "time")),
        *(share(what).alias(f"p_{what}") for what in ("target", "stop", "time")),
        F.avg((r > 0).cast("int")).alias("p_win"),
        F.avg(F.when(r > 0, r)).alias("e_gain"),
        F.avg(F.when(r <= 0, -r)).alias("e_loss"),
        F.avg(r).alias("ev"),
    )
    return got.withColumns({"ev_identity": F.col("p_win") * F.col("e_gain") - (1 - F.col("p_win")) * F.col("e_loss"), "ev_net": F.col("ev") - spread})


def walk_forward(sessions: DataFrame, n_splits: int, test_size: int, horizon: int = 0, embargo: int = 0, most_train: int | None = None) -> DataFrame:
    """(fold, position, session, role) of contiguous tests at the tail; train lies before, its labels end before the test.

    Train rows inside the embargo after an earlier test, and purged ones, are in no role. sessions: (position, session).
    """
    spark = sessions.sparkSession
    total = sessions.agg(F.max("position")).first()[0] + 1
    folds = spark.range(n_splits).select(F.col("id").cast("int").alias("fold"), (F.lit(total - n_splits * test_size) + F.col("id") * test_size).alias("t0"))
    grid = sessions.crossJoin(F.broadcast(folds))
    p, t0 = F.col("position"), F.col("t0")
    test = (p >= t0) & (p < t0 + test_size)
    first = total - n_splits * test_size
    after = (p >= first) & ((p - first) % test_size < embargo) & (p >= first + test_size)
    train = (p + horizon < t0) & ~after & (p >= (t0 - most_train if most_train else F.lit(0)))
    return grid.withColumn("role", F.when(test, "test").when(train, "train")).where("role is not null").select("fold", "position", "session", "role")


def bias(bars: DataFrame) -> DataFrame:
    """Deterministic deciders known before the open: momentum over five sessions and the reversal of the gap (-1, 0, 1)."""
    gap = F.col("open") / lag("close") - 1
    momentum = F.signum(lag("close", 1) / lag("close", 6) - 1)
    return bars.withColumns({"gap": gap, "momentum_5d": F.coalesce(momentum, F.lit(0.0)).cast("int"), "gap_reversal": F.coalesce(-F.signum(gap), F.lit(0.0)).cast("int"), "always_long": F.lit(1)})


def simulated(decided: DataFrame, side: str, cost: float = 0.0005) -> DataFrame:
    """Adds status and net: open to close on the side decided, less the cost; no side, no trade and no return."""
    usable = (F.col("open") > 0) & (F.col("close") > 0)
    s = F.col(side)
    status = F.when(~usable, "skipped").when(s == 0, "no_trade").otherwise("traded")
    return decided.withColumns({"status": status, "net": F.when(~usable, None).when(s == 0, 0.0).otherwise((F.col("close") / F.col("open") - 1) * s - cost)})


def window_pnl(trades: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Adds day, week and month totals of pnl over the trades of earlier sessions in the same bucket (session, pnl by series).

    Only trades closed before the session count, so the day's total is always 0. With limits (by day, week or month, in
    units of pnl) a flag says whether the total has reached minus the limit.
    """
    over = lambda bucket: Window.partitionBy("series_id", bucket).orderBy(F.unix_date("session")).rangeBetween(Window.unboundedPreceding, -1)
    buckets = {"day": F.col("session"), "week": F.trunc("session", "week"), "month": F.trunc("session", "month")}
    out = trades.withColumns({f"{name}_pnl": F.coalesce(F.sum("pnl").over(over(b)), F.lit(0.0)) for name, b in buckets.items()})
    return out.withColumns({f"{name}_stop": F.col(f"{name}_pnl") <= -limit for name, limit in (limits or {}).items()})
