"""The market calendar as a table: sessions, half days, hours, expiries, clock changes. One row a day, from rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
OPEN, CLOSE, HALF_CLOSE = "09:30:00", "16:00:00", "13:00:00"
FULL_HOURS, HALF_HOURS = 6.5, 3.5
#: Months whose expiry rolls the quarterly future.
ROLLS = (3, 6, 9, 12)


def nth_weekday(day: Column, month: int, name: str, n: int) -> Column:
    """The n-th weekday (MON to SUN) of a month in the year of day."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(F.year(day), F.lit(month), F.lit(1)), 1), name), 7 * (n - 1))


def last_weekday(day: Column, month: int, name: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(F.year(day), F.lit(month), F.lit(1))), 7), name)


def easter(day: Column) -> Column:
    """Easter Sunday of the year of day, by the Gregorian computus."""
    y = F.year(day)
    a, b, c = y % 19, F.floor(y / 100), y % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    p = h + m - 7 * n + 114
    return F.make_date(y, F.floor(p / 31).cast("int"), (p % 31 + 1).cast("int"))


def _fixed(day: Column, month: int, date: int) -> Column:
    return F.make_date(F.year(day), F.lit(month), F.lit(date))


def _observed(day: Column, holiday: Column, saturday: bool = True) -> Column:
    """Whether day is the holiday, or the weekday that stands for it: Monday for a Sunday, Friday for a Saturday."""
    weekday = F.weekday(holiday)
    kept = F.when(weekday == 6, F.date_add(holiday, 1)).when((weekday == 5) & F.lit(saturday), F.date_sub(holiday, 1)).otherwise(holiday)
    return day == kept


def holiday_rules(day: Column) -> list[tuple[str, Column]]:
    """(name, whether day is it) of the exchange's regular holidays, as observed since 1998."""
    year = F.year(day)
    return [
        ("new_year", _observed(day, _fixed(day, 1, 1), saturday=False)),
        ("martin_luther_king", (year >= 1998) & (day == nth_weekday(day, 1, "MON", 3))),
        ("washington", day == nth_weekday(day, 2, "MON", 3)),
        ("good_friday", day == F.date_sub(easter(day), 2)),
        ("memorial", day == last_weekday(day, 5, "MON")),
        ("juneteenth", (year >= 2022) & _observed(day, _fixed(day, 6, 19))),
        ("independence", _observed(day, _fixed(day, 7, 4))),
        ("labor", day == nth_weekday(day, 9, "MON", 1)),
        ("thanksgiving", day == nth_weekday(day, 11, "THU", 4)),
        ("christmas", _observed(day, _fixed(day, 12, 25))),
    ]


def utc(day: Column, clock: str, zone: str = NEW_YORK) -> Column:
    """The instant of a wall clock time on a day in a zone; clock changes are the zone's own."""
    return F.to_utc_timestamp(F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), F.lit(clock))).cast("timestamp"), zone)


def calendar(days: DataFrame, extra_holidays: Iterable[str] = (), extra_half_days: Iterable[str] = (), meetings: Iterable[str] = ()) -> DataFrame:
    """days (day) with reason, is_session, is_half_day, open_utc, close_utc, hours, previous_session, next_session,
    is_opex, is_roll, is_meeting and dst_mismatch.

    reason is the holiday, `weekend`, or null on sessions. Closures and half days that no rule knows are given as dates.
    The expiry is the third Friday of a month or the last session before it. The neighbours and expiries come from the
    days given, so give full months; hours are wall clock times of New York, whatever the season.
    """
    day = F.col("day")
    dates = lambda xs: day.cast("string").isin(*xs) if list(xs) else F.lit(False)
    reason = F.when(dates(tuple(extra_holidays)), F.lit("declared"))
    for name, rule in holiday_rules(day):
        reason = reason.when(rule, F.lit(name))
    df = days.withColumn("reason", reason.when(F.weekday(day) >= 5, F.lit("weekend")))
    df = df.withColumn("is_session", F.col("reason").isNull())
    eve = (F.date_format(day, "MM-dd").isin("12-24", "07-03")) | (day == F.date_add(nth_weekday(day, 11, "THU", 4), 1))
    df = df.withColumn("is_half_day", F.col("is_session") & (dates(tuple(extra_half_days)) | eve))
    hours = F.when(~F.col("is_session"), 0.0).when(F.col("is_half_day"), HALF_HOURS).otherwise(FULL_HOURS)
    close = F.when(F.col("is_half_day"), utc(day, HALF_CLOSE)).otherwise(utc(day, CLOSE))
    df = df.withColumns({"hours": hours, "open_utc": F.when(F.col("is_session"), utc(day, OPEN)), "close_utc": F.when(F.col("is_session"), close)})
    # A calendar is some ten thousand rows, whatever the data: one ordered partition.
    line = Window.orderBy("day")
    session = F.when(F.col("is_session"), day)
    df = df.withColumns({"previous_session": F.last(session, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), "next_session": F.first(session, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))})
    third = F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "FRI"), 14)
    month = Window.partitionBy(F.trunc(day, "month"))
    df = df.withColumn("is_opex", F.col("is_session") & (day == F.max(F.when(F.col("is_session") & (day <= third), day)).over(month)))
    spring, autumn = (nth_weekday(day, 3, "SUN", 2), last_weekday(day, 3, "SUN")), (last_weekday(day, 10, "SUN"), nth_weekday(day, 11, "SUN", 1))
    apart = ((day >= spring[0]) & (day < spring[1])) | ((day >= autumn[0]) & (day < autumn[1]))
    return df.withColumns({"is_roll": F.col("is_opex") & F.month(day).isin(*ROLLS), "is_meeting": dates(tuple(meetings)), "dst_mismatch": apart})


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")


def days_of(rows: DataFrame, day: str) -> DataFrame:
    """(day) of all the months from the first to the last day of rows."""
    ends = rows.agg(F.trunc(F.min(F.col(day).cast("date")), "month").alias("a"), F.last_day(F.max(F.col(day).cast("date"))).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))


def signals(days: DataFrame) -> DataFrame:
    """(day, event) of a calendar: closed, half_day, opex, witching, roll, meeting, dst_mismatch."""
    flags = [
        ("closed", ~F.col("is_session")), ("half_day", F.col("is_half_day")), ("opex", F.col("is_opex")), ("witching", F.col("is_roll")), ("roll", F.col("is_roll")), ("meeting", F.col("is_meeting")), ("dst_mismatch", F.col("dst_mismatch")),
    ]
    events = F.filter(F.array(*(F.when(on, F.lit(name)) for name, on in flags)), lambda e: e.isNotNull())
    return days.select("day", F.explode(events).alias("event"))
