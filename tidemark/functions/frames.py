"""Row frames over one series in session order, and the guards the feature kernels share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def series() -> WindowSpec:
    """One series in session order. Series are the unit of distribution: many spread, one stays in one task."""
    return Window.partitionBy("series_id").orderBy("session")


def rows(first: int, last: int) -> WindowSpec:
    return series().rowsBetween(first, last)


def full(agg: Column, value: Column, first: int, last: int) -> Column:
    """agg over a frame that holds a value in each of its rows; null where one is missing."""
    frame = rows(first, last)
    return F.when(F.count(value).over(frame) == last - first + 1, agg.over(frame))


def lag(value: Column | str, n: int = 1) -> Column:
    return F.lag(value, n).over(series())


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0."""
    return F.try_divide(top, bottom)


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def positive(value: Column) -> Column:
    """Only finite prices above 0 stay."""
    return F.when((finite(value)) > 0, value)


def log_return(price: Column, n: int = 1) -> Column:
    """ln of the price over that of n sessions ago; null where either is null or not above 0."""
    return F.log(positive(price) / positive(lag(price, n)))


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})
