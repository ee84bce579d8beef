"""An immutable journal of decisions, what came of them, and reconciling two states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("recommendation", "no_recommendation_stale_data", "no_recommendation_data_quality", "no_recommendation_undecided", "error")


def digest(columns: list[str]) -> Column:
    """SHA-256 over the named columns in order, as JSON: nulls are written, so that a missing value differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def sealed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_sha256", digest(rows.columns))


def intact(journal: DataFrame) -> DataFrame:
    """journal with sound: whether a row's digest is that of its other columns."""
    return journal.withColumn("sound", F.col("doc_sha256") == digest([c for c in journal.columns if c != "doc_sha256"]))


def admitted(journal: DataFrame, rows: DataFrame, identity: list[str]) -> DataFrame:
    """The sealed rows to append: those whose identity is new. An equal row again is nothing; a different one under a known
    identity is an error, raised before anything is written."""
    fresh = sealed(rows)
    both = fresh.join(journal.select(*identity, F.col("doc_sha256").alias("_old")), identity, "left")
    clash = both.where(F.col("_old").isNotNull() & (F.col("_old") != F.col("doc_sha256"))).count()
    if clash:
        raise ValueError(f"{clash} rows differ from the journal's under the same identity")
    return both.where("_old is null").drop("_old").dropDuplicates(["doc_sha256"])


def by_status(journal: DataFrame) -> DataFrame:
    """(status, n) of every status, those without rows too."""
    every = journal.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(journal.groupBy("status").agg(F.count("*").alias("n")), "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def attributed(sides: DataFrame, bars: DataFrame) -> DataFrame:
    """sides (session, agent, side) with won: whether the side was that of open to close. Neutral has no answer, a flat day wins for none."""
    move = F.signum(F.col("close") - F.col("open"))
    side = F.when(F.col("side") == "long", 1).when(F.col("side") == "short", -1)
    got = sides.join(bars.select("session", "open", "close"), "session", "left")
    return got.select("session", "agent", "side", F.when(side.isNotNull() & move.isNotNull(), (move == side)).alias("won"))


def unattributed(sides: DataFrame, done: DataFrame) -> DataFrame:
    return sides.join(done.select("session", "agent"), ["session", "agent"], "left_anti")


def deltas(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, change, and before, after and delta of each value) of all rows of either side: added, removed, changed or same."""
    b = before.select(*key, *(F.col(v).alias(f"{v}_before") for v in values), F.lit(True).alias("_b"))
    a = after.select(*key, *(F.col(v).alias(f"{v}_after") for v in values), F.lit(True).alias("_a"))
    both = b.join(a, key, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select(*key, change.alias("change"), *(c for v in values for c in (F.col(f"{v}_before"), F.col(f"{v}_after"), (F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_delta"))))


def first_reason(rows: DataFrame, reasons: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """rows with the first reason that holds, null where none does."""
    out = F.lit(None).cast("string")
    for code, rule in reversed(reasons):
        out = F.when(rule, F.lit(code)).otherwise(out)
    return rows.withColumn(name, out)


def paper_verdict(results: DataFrame, by: str = "series_id", least: int = 30) -> DataFrame:
    """(series, n, mean_paper, mean_reference, verdict) of (paper, reference): diverges if the means lie more than two standard errors
    apart, consistent, or not_evaluable under `least` rows."""
    got = results.groupBy(by).agg(F.count("paper").alias("n"), F.avg("paper").alias("mean_paper"), F.avg("reference").alias("mean_reference"), (F.stddev_samp("paper") / F.sqrt(F.count("paper"))).alias("_se"))
    far = F.abs(F.col("mean_paper") - F.col("mean_reference")) > 2 * F.col("_se")
    return got.withColumn("verdict", F.when(F.col("n") < least, "not_evaluable").when(far, "diverges").otherwise("consistent")).drop("_se")


def month_report(calls: DataFrame) -> DataFrame:
    """(month, n_calls, cost, tokens, cached_share, total_to_date) of calls (at, cost, tokens, cached)."""
    got = calls.groupBy(F.trunc("at", "month").alias("month")).agg(F.count("*").alias("n_calls"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.avg(F.col("cached").cast("int")).alias("cached_share"))
    return got.withColumn("total_to_date", F.sum("cost").over(Window.orderBy("month")))
