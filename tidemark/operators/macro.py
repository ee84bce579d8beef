"""Macro observations known at a session: level by publication time, change, and year over year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import lag, ratio
from tidemark.operators.asof import as_of, on_every


def levels(sessions: DataFrame, observations: DataFrame, change: int = 5) -> DataFrame:
    """(series_id, session, reference, level, level_chg): the observation last by (published, reference) among the published."""
    at = on_every(sessions.select("session").distinct(), observations)
    got = as_of(at, observations.withColumn("session", F.col("published")), ["series_id"], "session", ["reference", "value"], then=["reference"])
    got = got.select("series_id", "session", "reference", F.col("value").alias("level"))
    return got.withColumn("level_chg", F.col("level") - lag("level", change))


def year_over_year(known: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds yoy to levels: against the observation of the same day a year before, if published by then.

    The 29th of February has none, and neither has a base of 0.
    """
    base = observations.select(F.col("series_id"), F.col("reference").alias("b"), F.col("published").alias("bp"), F.col("value").alias("bv"))
    year = F.add_months("reference", -12)
    same = F.when(F.dayofmonth(year) == F.dayofmonth("reference"), year)
    df = known.withColumn("b", same).join(base, ["series_id", "b"], "left")
    return df.withColumn("yoy", F.when(F.col("bp") <= F.col("session"), (ratio(F.col("level"), F.col("bv")) - 1) * 100)).drop("b", "bp", "bv")
