"""The history of labels: which sessions can be labelled and why others cannot, their sigma, their ticks, and an audit of entry prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import positive
from tidemark.operators import intervals, labels
from tidemark.operators.volatility_study import for_duration

#: Why a session has no label, in the order in which the first that holds is given.
REASONS = ("no_session", "stale_open", "incomplete", "no_forecast", "not_closed")
#: Ticks that an hour of a session should have, and the share of them with which they decide.
TICKS_PER_HOUR, COVERAGE = 12, 0.95


def sample(bars: DataFrame, days: DataFrame, sigmas: DataFrame, now: str, clean_from: str | None = None) -> DataFrame:
    """bars (series_id, session, open, high, low, close) that have a close before them, from the clean region on, with is_half_day,
    hours, open_utc, close_utc, sigma, carrier and reason.

    days: a calendar (day, is_session, is_half_day, hours, open_utc, close_utc); sigmas: (series_id, session, sigma). reason is the
    first of REASONS that holds, null for a session that can be labelled; others have no sigma. A half day takes the
    last sigma of a full session labelled before it for its hours (carrier `previous`), a full one its own (`forecast`). An
    open equal to the close before is stale.
    """
    line = Window.partitionBy("series_id").orderBy("session")
    df = bars.withColumn("close_before", F.lag("close").over(line)).where("close_before is not null")
    if clean_from is not None:
        df = df.where(F.col("session") >= F.lit(clean_from).cast("date"))
    given = days.select(F.col("day").alias("session"), "is_session", "is_half_day", "hours", "open_utc", "close_utc")
    df = df.join(F.broadcast(given), "session", "left").join(sigmas.select("series_id", "session", F.col("sigma").alias("own")), ["series_id", "session"], "left")
    half, late = F.coalesce("is_half_day", F.lit(False)), F.col("close_utc") > F.lit(now).cast("timestamp")
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    first = F.when(~F.coalesce("is_session", F.lit(False)) | F.col("close_utc").isNull(), "no_session").when(F.coalesce(F.col("open") == F.col("close_before"), F.lit(False)), "stale_open").when(~whole, "incomplete")
    # Of full sessions that are labelled, the last sigma before each; later ones are not closed, so the order of reasons is kept.
    full = F.when(first.isNull() & ~half & F.col("own").isNotNull() & ~F.coalesce(late, F.lit(False)), F.col("own"))
    df = df.withColumns({"first": first, "full": full})
    before = F.last("full", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("sigma", F.when(half, for_duration(before, F.col("hours"))).otherwise(F.col("own")))
    reason = F.coalesce(F.col("first"), F.when(F.col("sigma").isNull(), F.lit("no_forecast")), F.when(late, F.lit("not_closed")))
    df = df.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    out = {"sigma": F.when(fine, F.col("sigma")), "carrier": F.when(fine & half, "previous").when(fine, "forecast")}
    return df.withColumns(out).select(*bars.columns, "is_half_day", "hours", "open_utc", "close_utc", "sigma", "carrier", "reason")


def reason_counts(sampled: DataFrame, by: str = "series_id") -> DataFrame:
    """(series, reason, n, first, last): sessions by reason, `labelled` for those without."""
    return sampled.groupBy(by, F.coalesce("reason", F.lit("labelled")).alias("reason")).agg(F.count("*").alias("n"), F.min("session").alias("first"), F.max("session").alias("last"))


def session_ticks(sampled: DataFrame, ticks: DataFrame, width: int = 6 * 3600) -> DataFrame:
    """(session, at, open, high, low, k) of ticks (at, open, high, low) within the hours of one series' sessions, both ends included; k orders them."""
    hours = sampled.where("reason is null").select("session", "open_utc", "close_utc")
    got = intervals.held_by(ticks.select("at", "open", "high", "low"), hours, "at", "open_utc", "close_utc", width=width)
    return got.select("session", "at", "open", "high", "low", F.unix_micros(F.col("at").cast("timestamp")).alias("k"))


def label_history(sampled: DataFrame, ticks: DataFrame, k: float = 1.0) -> DataFrame:
    """Labels of all sessions that can be labelled, from one series' sample and its ticks (see labels.triple_barrier)."""
    days = sampled.where("reason is null").select("session", F.col("open").alias("entry"), "high", "low", "close", "sigma", F.round(F.col("hours") * TICKS_PER_HOUR).alias("expected"))
    return labels.triple_barrier(days.where(positive(F.col("entry")).isNotNull()), session_ticks(sampled, ticks), k, COVERAGE)


def entry_audit(sampled: DataFrame, ticks: DataFrame, tolerance_bp: float = 1.0) -> DataFrame:
    """(session, entry, opening, diff_bp, identical): the open of each labelled session against that of the tick at its opening instant.

    Only sessions whose ticks cover them are compared. The audit changes no label.
    """
    inside = session_ticks(sampled, ticks)
    days = sampled.where("reason is null").select("session", F.col("open").alias("entry"), "open_utc", F.round(F.col("hours") * TICKS_PER_HOUR).alias("expected"))
    seen = inside.join(days.select("session", "open_utc"), "session").groupBy("session").agg(F.count("*").alias("n"), F.max(F.when(F.col("at") == F.col("open_utc"), F.col("open"))).alias("opening"))
    got = days.join(seen, "session").where((F.col("n") >= F.col("expected") * COVERAGE) & F.col("opening").isNotNull() & F.col("entry").isNotNull())
    diff = F.abs(F.col("entry") - F.col("opening")) / F.col("opening") * 10_000
    return got.select("session", "entry", "opening", diff.alias("diff_bp")).withColumn("identical", F.col("diff_bp") <= tolerance_bp)


def audit_summary(audit: DataFrame) -> DataFrame:
    """(compared, identical, max_abs_diff_bp, status): not_evaluable, mismatch or ok."""
    got = audit.agg(F.count("*").alias("compared"), F.count_if("identical").alias("identical"), F.max("diff_bp").alias("max_abs_diff_bp"))
    return got.withColumn("status", F.when(F.col("compared") == 0, "not_evaluable").when(F.col("identical") < F.col("compared"), "mismatch").otherwise("ok"))
