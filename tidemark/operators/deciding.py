"""Decisions by callables: one function a fold, called for each test session with what was known before it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECIDED = "fold int, series_id string, session date, open double, close double, side int, stop_px double, target_px double"


@dataclass(frozen=True)
class SessionView:
    """What a decision may know: the session, its open, and the rows of earlier sessions, oldest first."""

    series_id: str
    session: Any
    open: float
    history: Mapping[str, np.ndarray]

    def last(self, column: str, back: int = 1) -> float:
        """The value `back` sessions before this one; NaN where there is none."""
        values = self.history[column]
        return float(values[-back]) if 1 <= back <= len(values) else float("nan")


@dataclass(frozen=True)
class Decision:
    """side 1, -1 or 0; barriers around the open, or none."""

    side: int
    stop_px: float | None = None
    target_px: float | None = None

    def __post_init__(self) -> None:
        if self.side not in (-1, 0, 1):
            raise ValueError(f"side {self.side}")


DecisionFn = Callable[[SessionView], Decision]


class _Past(Mapping):
    """Columns of the rows before one, as copies: neither later rows nor the frame can be reached through them."""

    def __init__(self, columns: dict[str, np.ndarray], n: int) -> None:
        self._held = {k: v[:n].copy() for k, v in columns.items()}

    def __getitem__(self, key: str) -> np.ndarray:
        return self._held[key]

    def __iter__(self):
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)


def decided(plan: DataFrame, bars: DataFrame, functions: Mapping[int, DecisionFn] | DecisionFn, window: int | None = None, columns: tuple[str, ...] = ("session", "open", "high", "low", "close", "volume")) -> DataFrame:
    """(fold, series_id, session, open, close, side, stop_px, target_px): the decision of each test session of a plan, as engine.run takes it.

    plan: (fold, session, role); bars: (series_id, session, open, close, ...). Each fold has its own function, or all share
    one; a fold without one is an error. A function sees the session's open and the rows before it, at most `window` of
    them. Series and folds are the tasks. A window bounds what a call copies; without one a series of n sessions costs n * n.
    """
    tests = plan.where("role = 'test'").select(F.col("fold").cast("int").alias("fold"), "session")
    shared = callable(functions)
    if not shared:
        lacking = {r.fold for r in tests.select("fold").distinct().collect()} - set(functions)
        if lacking:
            raise ValueError(f"no function for the folds {sorted(lacking)}")
    names = [c for c in columns if c in bars.columns]
    # Folds of a series meet its bars in one group each: fold and series, bars up to the fold's last test session.
    span = tests.groupBy("fold").agg(F.max("session").alias("until"))
    rows = bars.select("series_id", *names).join(F.broadcast(span), F.col("session") <= F.col("until")).drop("until")
    rows = rows.join(F.broadcast(tests.withColumn("test", F.lit(True))), ["fold", "session"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session")
        fold, series = int(pdf["fold"].iloc[0]), pdf["series_id"].iloc[0]
        decide = functions if shared else functions[fold]
        held = {c: pdf[c].to_numpy() for c in names}
        out = []
        for i in np.flatnonzero(pdf["test"].eq(True).to_numpy(bool)):
            from_ = max(0, i - window) if window else 0
            view = SessionView(series, held["session"][i], float(held["open"][i]) if pd.notna(held["open"][i]) else float("nan"), _Past({k: v[from_:] for k, v in held.items()}, i - from_))
            d = decide(view)
            out.append((fold, series, held["session"][i], held["open"][i], held["close"][i], d.side, d.stop_px, d.target_px))
        return pd.DataFrame(out, columns=["fold", "series_id", "session", "open", "close", "side", "stop_px", "target_px"])

    return rows.groupBy("fold", "series_id").applyInPandas(run, _DECIDED)


def looks_ahead(plan: DataFrame, bars: DataFrame, functions: Mapping[int, DecisionFn] | DecisionFn, session: str, factor: float = 1.5, **kw) -> DataFrame:
    """(fold, series_id, session) of decisions up to and with a session that change when that session's range, close and all later prices change.

    A function that keeps to its view has none; one that reaches for data beyond it shows.
    """
    at = F.lit(session).cast("date")
    prices = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
    later = bars.withColumns({c: F.when((F.col("session") > at) | ((F.col("session") == at) & (F.lit(c) != "open")), F.col(c) * factor).otherwise(F.col(c)) for c in prices})
    key = ["fold", "series_id", "session"]
    was = decided(plan, bars, functions, **kw).where(F.col("session") <= at).select(*key, F.struct("side", "stop_px", "target_px").alias("was"))
    now = decided(plan, later, functions, **kw).where(F.col("session") <= at).select(*key, F.struct("side", "stop_px", "target_px").alias("now"))
    return was.join(now, key).where(~F.col("was").eqNullSafe(F.col("now"))).select(*key)


def _sign(x: float) -> int:
    return int(np.sign(x)) if np.isfinite(x) else 0


def _momentum(view: SessionView) -> Decision:
    before = view.last("close", 6)
    return Decision(_sign(view.last("close") / before - 1) if before else 0)


def _gap_reversal(view: SessionView) -> Decision:
    before = view.last("close")
    return Decision(-_sign(view.open / before - 1) if before else 0)


#: The deterministic baselines as callables; engine.baselines has them as expressions.
CALLABLES: dict[str, DecisionFn] = {
    "no_trade": lambda view: Decision(0),
    "always_long": lambda view: Decision(1),
    "always_short": lambda view: Decision(-1),
    "momentum_5d": _momentum,
    "gap_reversal": _gap_reversal,
}


@dataclass
class Walk:
    """A decision that follows a series session by session: it is told of each earlier one once, in order."""

    step: Callable[[dict, Mapping[str, Any]], None]
    decide: Callable[[dict, SessionView], Decision]
    state: dict = field(default_factory=dict)
    seen: int = 0
    of: tuple | None = None

    def __call__(self, view: SessionView) -> Decision:
        n = len(next(iter(view.history.values()), ()))
        if self.of != view.series_id or n < self.seen:
            self.of, self.state, self.seen = view.series_id, {}, 0
        for k in range(self.seen, n):
            self.step(self.state, {c: v[k] for c, v in view.history.items()})
        self.seen = n
        return self.decide(self.state, view)
