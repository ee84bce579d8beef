"""As-of joins by union and carried structs: linear, one shuffle by key, no range blow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Series ids that are sent along with the targets; more are spread as a table of their own.
MANY = 10_000


def as_of(targets: DataFrame, values: DataFrame, by: list[str], at: str, carry: list[str], strict: bool = False, then: list[str] | None = None) -> DataFrame:
    """targets with the columns `carry` of the last row of values at or before (strict: before) `at`, within `by`.

    then breaks ties among values. What is carried is one struct, so a null in the last row is carried as null. The
    column `at` has the same type on both sides; targets without a value get nulls and rows stay as they are.
    """
    then = then or []
    side = F.struct(*[F.col(c) for c in carry])
    kind = values.select(side.alias("s")).schema["s"].dataType
    extra = [c for c in targets.columns if c not in (*by, at)]
    keep = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(1).alias("_one"))
    left = targets.select(*by, at, F.lit(0 if strict else 1).alias("_k"), *[F.lit(None).cast(values.schema[c].dataType).alias(f"_t{i}") for i, c in enumerate(then)], F.lit(None).cast(kind).alias("_v"), keep.alias("_row"))
    right = values.select(*by, at, F.lit(1 if strict else 0).alias("_k"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(then)], side.alias("_v"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*by).orderBy(at, "_k", *[f"_t{i}" for i in range(len(then))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    rows = both.where(F.col("_row").isNotNull())
    return rows.select(*by, at, *[F.col(f"_row.{c}").alias(c) for c in extra], *[F.col(f"_last.{c}").alias(c) for c in carry])


def on_every(targets: DataFrame, series: DataFrame) -> DataFrame:
    """Each target once for each series id: a grid, which is the result asked for. The ids are broadcast if they are few."""
    ids = series.select("series_id").distinct()
    few = ids.limit(MANY + 1).count() <= MANY
    return targets.crossJoin(F.broadcast(ids) if few else ids)


def rolling_link(df: DataFrame, x: Column, y: Column, n: int = 60) -> dict[str, Column]:
    """corr and beta (slope of y on x) over the n rows before the current; null if a pair is missing or x or y is constant."""
    frame = Window.partitionBy("series_id").orderBy("session").rowsBetween(-n, -1)
    whole = (F.count(x * y).over(frame) == n) & (F.max(x).over(frame) > F.min(x).over(frame)) & (F.max(y).over(frame) > F.min(y).over(frame))
    both = F.covar_pop(x, y).over(frame)
    spread = lambda v: F.var_pop(v).over(frame)
    return {"corr": F.when(whole, F.try_divide(both, F.sqrt(spread(x) * spread(y)))), "beta": F.when(whole, F.try_divide(both, spread(x)))}
