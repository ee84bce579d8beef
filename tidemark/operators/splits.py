"""Train and test positions: combinatorial splits, their invariants, held-back samples, the split for calibration."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The share of a train that calibrates.
CALIBRATION = 0.2


def block_of(n: int, blocks: int) -> list[tuple[int, int]]:
    """(start, stop) of contiguous blocks of n positions; the first n % blocks are one longer."""
    size, more = divmod(n, blocks)
    starts = [k * size + min(k, more) for k in range(blocks + 1)]
    return list(zip(starts[:-1], starts[1:], strict=True))


def combinatorial(sessions: DataFrame, blocks: int, test_blocks: int, embargo: int = 0) -> DataFrame:
    """(fold, position, session, role) of every choice of test_blocks among contiguous blocks, in lexical order.

    sessions: (position, session, horizon). Test is the union of the chosen blocks; of the rest, a row whose label ends
    in a test block is purged, one of the embargo after a test block embargoed, both are named so, the others train.
    The choices are C(blocks, test_blocks) rows of small arrays, broadcast to the positions.
    """
    if not 1 <= test_blocks < blocks:
        raise ValueError("test_blocks lies between 1 and blocks - 1")
    n = sessions.count()
    if blocks > n:
        raise ValueError("more blocks than sessions")
    edges = block_of(n, blocks)
    folds = [(k, [edges[b][0] for b in chosen], [edges[b][1] for b in chosen]) for k, chosen in enumerate(itertools.combinations(range(blocks), test_blocks))]
    table = sessions.sparkSession.createDataFrame(folds, "fold int, starts array<int>, stops array<int>")
    grid = sessions.crossJoin(F.broadcast(table))
    p = F.col("position")
    inside = F.exists(F.arrays_zip("starts", "stops"), lambda b: (p >= b["starts"]) & (p < b["stops"]))
    purged = F.exists("starts", lambda s: (s >= p) & (s <= p + F.col("horizon")))
    banned = F.exists("stops", lambda s: (p >= s) & (p < s + embargo))
    role = F.when(inside, "test").when(purged, "purged").when(banned, "embargoed").otherwise("train")
    return grid.select("fold", "position", "session", "horizon", role.alias("role"))


def broken(plan: DataFrame) -> DataFrame:
    """(fold, position, fault) of the train rows that break an invariant: none, if the plan is sound.

    A position has one role a fold; no train row's label reaches a test row at or after it.
    """
    later = Window.partitionBy("fold").orderBy("position").rowsBetween(0, Window.unboundedFollowing)
    next_test = F.min(F.when(F.col("role") == "test", F.col("position"))).over(later)
    touching = plan.withColumn("next_test", next_test).where((F.col("role") == "train") & (F.col("next_test") <= F.col("position") + F.col("horizon")))
    twice = plan.groupBy("fold", "position").agg(F.count("*").alias("n")).where("n > 1")
    return touching.select("fold", "position", F.lit("label reaches test").alias("fault")).union(twice.select("fold", "position", F.lit("several roles").alias("fault")))


def reserved(sessions: DataFrame, first: str, last: str, expected: int) -> DataFrame:
    """sessions with held_out for the final block; an error unless it is final and has exactly the expected rows."""
    day = F.col("session")
    inside = day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    found, after = sessions.agg(F.count_if(inside), F.count_if(day > F.lit(last).cast("date"))).first()
    if found != expected or after:
        raise ValueError(f"the held-back sample has {found} sessions, {after} after it; {expected} and 0 are declared")
    return sessions.withColumn("held_out", inside)


def usable(sessions: DataFrame, first: str, last: str) -> DataFrame:
    """sessions as they are; an error if one lies in the held-back sample."""
    inside = sessions.where(F.col("session").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if not inside.isEmpty():
        raise ValueError("a session of the held-back sample is in use")
    return sessions


def for_calibration(train: DataFrame, share: float = CALIBRATION) -> DataFrame:
    """train (fold, position, horizon) with part: calibration for the last share of a fold's rows, fit before them,
    purged where a fit row's label reaches the first calibration row."""
    fold = Window.partitionBy("fold")
    n = F.count("*").over(fold)
    rank = F.row_number().over(fold.orderBy("position"))
    df = train.withColumn("tail", rank > n - F.floor(n * share))
    start = F.min(F.when(F.col("tail"), F.col("position"))).over(fold)
    part = F.when(F.col("tail"), "calibration").when(F.col("position") + F.col("horizon") >= start, "purged").otherwise("fit")
    return df.withColumn("part", part).drop("tail")
