"""Joins of points to the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def held_by(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int = 3600, keys: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """points with the columns of each interval that holds them: start <= at <= end, both ends included.

    Time is cut into buckets of `width` seconds: an interval stands in every bucket that it touches, a point in one, and those of a
    bucket (and of equal keys) meet in an equi-join, where the bounds are compared. No date is needed, clock changes are
    no matter, and intervals may overlap, cross midnight or be of unlike lengths; width should be near the usual length.
    Points outside every interval are dropped, or kept with nulls (how="left"). Null bounds or instants hold nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    clash = set(points.columns) & set(intervals.columns) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    bucket = lambda x: F.floor(F.unix_seconds(x.cast("timestamp")) / width).cast("long")
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    left = points.withColumn("__bucket", bucket(F.col(at)))
    inside: Column = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    l, r = left.alias("l"), spread.alias("r")  # noqa: E741
    on = F.col("l.__bucket") == F.col("r.__bucket")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    met = l.join(r, on & inside, how)
    return met.select(*(F.col(f"l.{c}") for c in points.columns), *(F.col(f"r.{c}") for c in intervals.columns if c not in keys))
