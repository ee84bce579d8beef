"""State across sessions: loss totals by day, week and month, and the observation counter after an absence."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: An absence of more than this many days starts this many sessions of observation.
ABSENCE_DAYS, OBSERVATION = 7, 5
_OUT = "session date, trades long, pnl double, day_pnl double, week_pnl double, month_pnl double, observation_left int"


def numbered(days: DataFrame) -> DataFrame:
    """A calendar (day, is_session) with n, the sessions up to and with each day. A calendar is some ten thousand rows: one partition."""
    n = F.sum(F.col("is_session").cast("int")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("day", F.col("is_session").alias("is_open"), n.cast("int").alias("n"))


def session_state(trades: DataFrame, days: DataFrame, absence_days: int = ABSENCE_DAYS, observation: int = OBSERVATION) -> DataFrame:
    """One row per series and session of a table of trades (series_id, session, pnl): trades, pnl, and as the session begins
    day_pnl, week_pnl, month_pnl and observation_left.

    Totals are of earlier sessions in the same bucket (ISO weeks), so a day's own is 0. The last gap of more than
    absence_days between neighbouring sessions, this one included, starts a window of `observation` sessions of the
    calendar days (day, is_session); days without a session do not use it up.
    """
    per = trades.where("series_id is not null and session is not null").groupBy("series_id", "session").agg(F.count("*").alias("trades"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))
    df = per.join(F.broadcast(numbered(days)), F.col("session") == F.col("day"), "left").drop("day")
    line = Window.partitionBy("series_id").orderBy("session")
    total = lambda b: F.coalesce(F.sum("pnl").over(Window.partitionBy("series_id", b).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    back = F.datediff("session", F.lag("session").over(line)) > absence_days
    df = df.withColumn("_begun", F.when(back, F.col("n") - F.col("is_open").cast("int")))
    begun = F.last("_begun", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    left = F.greatest(F.lit(0), F.lit(observation + 1) - (F.col("n") - begun))
    return df.select(
        "series_id", "session", "trades", "pnl", F.lit(0.0).alias("day_pnl"), total(F.trunc("session", "week")).alias("week_pnl"), total(F.trunc("session", "month")).alias("month_pnl"), F.coalesce(left, F.lit(0)).cast("int").alias("observation_left")
    )


class SessionState(StatefulProcessor):
    """Keeps a series' sessions until the watermark has passed them, then takes them in order, whatever order they came in."""

    def __init__(self, absence_days: int, observation: int) -> None:
        self.absence_days, self.observation = absence_days, observation

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "session date", "trades long, pnl double, n int, is_open boolean")
        self.totals = handle.getValueState("totals", "last date, week date, week_pnl double, month date, month_pnl double, begun int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for session, part in pdf.groupby("session"):
                day, pnl = (session,), float(part["pnl"].fillna(0.0).sum())
                n, is_open = part["n"].iloc[0], part["is_open"].iloc[0]
                if self.waiting.containsKey(day):
                    had = self.waiting.getValue(day)
                    self.waiting.updateValue(day, (had[0] + len(part), had[1] + pnl, had[2], had[3]))
                else:
                    self.waiting.updateValue(day, (len(part), pnl, None if pd.isna(n) else int(n), None if pd.isna(is_open) else bool(is_open)))
                    self.handle.registerTimer(_millis(session))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted(day[0] for day in self.waiting.keys() if _millis(day[0]) <= due)  # noqa: SIM118
        out = []
        for session in ready:
            trades, pnl, n, is_open = self.waiting.getValue((session,))
            self.waiting.removeKey((session,))
            out.append((key[0], *self._taken(session, trades, pnl, n, is_open)))
        yield pd.DataFrame(out, columns=["series_id", "session", "trades", "pnl", "day_pnl", "week_pnl", "month_pnl", "observation_left"]) if out else pd.DataFrame()

    def _taken(self, session: dt.date, trades: int, pnl: float, n: int | None, is_open: bool | None) -> tuple:
        last, week, week_pnl, month, month_pnl, begun = self.totals.get() if self.totals.exists() else (None, None, 0.0, None, 0.0, None)
        monday, first = session - dt.timedelta(days=session.weekday()), session.replace(day=1)
        week_pnl, month_pnl = week_pnl if week == monday else 0.0, month_pnl if month == first else 0.0
        if last is not None and (session - last).days > self.absence_days and n is not None:
            begun = n - int(bool(is_open))
        left = 0 if begun is None or n is None else max(0, self.observation + 1 - (n - begun))
        self.totals.update((session, monday, week_pnl + pnl, first, month_pnl + pnl, begun))
        return session, trades, pnl, 0.0, week_pnl, month_pnl, left

    def close(self) -> None:
        pass


def _millis(day: dt.date) -> int:
    """The end of a day in UTC."""
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.UTC).timestamp() * 1000) + 86_399_999


def session_state_stream(trades: DataFrame, days: DataFrame, late: str = "10 days", absence_days: int = ABSENCE_DAYS, observation: int = OBSERVATION) -> DataFrame:
    """The rows of session_state from a stream of trades (series_id, session, pnl), each once the watermark has passed its session.

    Trades may come in any order within `late`; later ones are dropped by the watermark. State is the sessions that wait
    and one row a series. Needs the RocksDB state store (`keyed_state`).
    """
    at = F.to_timestamp(F.col("session").cast("string"))
    rows = trades.where("series_id is not null and session is not null").withColumn("at", at).withWatermark("at", late)
    rows = rows.join(F.broadcast(numbered(days)), F.col("session") == F.col("day"), "left").select("series_id", "session", "at", "pnl", "n", "is_open")
    return rows.groupBy("series_id").transformWithStateInPandas(SessionState(absence_days, observation), f"series_id string, {_OUT}", "Append", "EventTime")


def keyed_state(spark) -> None:
    """Let streams of the session keep their state in RocksDB, which keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
