"""Seeded bootstrap intervals of any statistic, one stream of draws cut over tasks.

The draws of a series are one stream of the legacy Mersenne Twister, AT_ONCE rows at a time. Where a chunk starts in it
depends on the seed and the length of the series alone, so the generator's states at the chunks are made once a length,
and every chunk of every series is a task's row: a long series is as many tasks as it has chunks, and the numbers are those
of one loop over the whole stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of draws taken from the stream at a time: a fixed value, as it decides which draws are made.
AT_ONCE = 512
#: A statistic takes resamples as rows of a matrix and gives a number a row.
Statistic = Callable[[np.ndarray], np.ndarray]


def mean(s: np.ndarray) -> np.ndarray:
    return s.mean(axis=1)


def _yearly(s: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Mean over spread, by year; 0 where a resample is constant."""
    flat = (s.max(axis=1) == s.min(axis=1)) | (spread == 0)
    return np.where(flat, 0.0, s.mean(axis=1) / np.where(flat, 1.0, spread) * math.sqrt(252))


def sharpe(s: np.ndarray) -> np.ndarray:
    return _yearly(s, s.std(axis=1, ddof=1))


def sortino(s: np.ndarray) -> np.ndarray:
    return _yearly(s, np.sqrt(np.square(np.minimum(s, 0)).mean(axis=1)))


STATISTICS: dict[str, Statistic] = {"mean": mean, "sharpe": sharpe, "sortino": sortino}


def each(one: Callable[[np.ndarray], float]) -> Statistic:
    """A statistic of one sample as one of many rows; a value that is not finite is an error."""

    def rows(s: np.ndarray) -> np.ndarray:
        out = np.array([float(one(x)) for x in s])
        if not np.isfinite(out).all():
            raise ValueError("the statistic of a resample is not finite")
        return out

    return rows


def states(n: int, draws: int, seed: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(chunk, rows, key, position) of the generator as each chunk of a series of n values begins."""
    rng = np.random.RandomState(seed)
    for chunk, at in enumerate(range(0, draws, AT_ONCE)):
        _, key, place, _, _ = rng.get_state(legacy=True)
        rows = min(AT_ONCE, draws - at)
        yield chunk, rows, key.astype(np.uint32).tobytes(), int(place)
        rng.randint(0, n, size=(rows, n))


def chunk_of(x: np.ndarray, statistic: Statistic, rows: int, key: bytes, place: int) -> np.ndarray:
    """The statistic of the resamples of one chunk, whose draws begin at a state."""
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.frombuffer(key, np.uint32), place))
    return statistic(x[rng.randint(0, len(x), size=(rows, len(x)))])


def interval(values: DataFrame, statistic: str | Statistic = "mean", by: tuple[str, ...] = ("series_id",), r: str = "net", order: str = "session", draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(by..., n, estimate, lo, hi): percentile interval of a statistic of each series' values in their order.

    Nulls are left out and a series without values has no row; rows that tie in the order stand by value. A series is an
    array in each of its tasks, and its statistics, one a draw, in one.
    """
    fn = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    by = list(by)
    series = values.where(F.col(r).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(r).cast("double").alias("v")))).alias("x"))
    series = series.select(*by, F.transform("x", lambda e: e["v"]).alias("x"), F.size("x").alias("n"))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in pdf["n"]:
                for row in states(int(n), draws, seed):
                    yield pd.DataFrame([(int(n), *row)], columns=["n", "chunk", "rows", "key", "place"])

    # Series of a length share their states; a length's chunks are found together, then dealt out.
    begun = series.select("n").distinct().repartition("n").mapInPandas(starts, "n int, chunk int, rows int, key binary, place int")
    parts = series.join(begun, "n").repartition(*by, "chunk")
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    ids = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.x, float)
                out = {c: [getattr(row, c)] for c in by}
                yield pd.DataFrame(out | {"n": [row.n], "chunk": [row.chunk], "drawn": [chunk_of(x, fn, row.rows, row.key, row.place)], "estimate": [float(fn(x[None, :])[0])]})

    drawn = parts.mapInPandas(run, f"{ids}, n int, chunk int, drawn array<double>, estimate double")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.quantile(np.concatenate(list(pdf.sort_values("chunk")["drawn"])), [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in by} | {"n": [pdf["n"].iloc[0]], "estimate": [pdf["estimate"].iloc[0]], "lo": [lo], "hi": [hi]})

    return drawn.groupBy(*by).applyInPandas(ends, f"{ids}, n int, estimate double, lo double, hi double")


def paired_interval(pairs: DataFrame, left: str, right: str, by: tuple[str, ...] = ("series_id",), order: str = "session", **kw) -> DataFrame:
    """(by..., n, estimate, lo, hi, verdict) of the mean of left less right over the rows that have both.

    verdict: above or below where the interval excludes 0, else open. Pairs with a null don't count.
    """
    got = interval(pairs.select(*by, order, (F.col(left) - F.col(right)).alias("d")), "mean", by, "d", order, **kw)
    return got.withColumn("verdict", F.when(F.col("lo") > 0, "above").when(F.col("hi") < 0, "below").otherwise("open"))


def dominance_intervals(differences: DataFrame, levels: Mapping[str, float] | list[float], by: tuple[str, ...] = ("series_id",), d: str = "d", order: str = "session", **kw) -> DataFrame:
    """(by..., level, n, estimate, lo, hi, sign, monotone, dominated_from) of differences less a cost level each, every level resampled anew.

    sign: positive, negative or open by the interval; monotone: the estimate falls as the level rises; dominated_from:
    the least level of a series from which every interval lies below 0, null if there is none.
    """
    named = sorted(levels.values() if isinstance(levels, Mapping) else levels)
    rows = differences.select(*by, order, d, F.explode(F.array(*map(F.lit, map(float, named)))).alias("level"))
    got = interval(rows.withColumn("net", F.col(d) - F.col("level")), "mean", (*by, "level"), "net", order, **kw)
    up, down = Window.partitionBy(*by).orderBy("level"), Window.partitionBy(*by).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumns({"sign": F.when(F.col("lo") > 0, "positive").when(F.col("hi") < 0, "negative").otherwise("open"), "monotone": F.coalesce(F.col("estimate") < F.lag("estimate").over(up), F.lit(True))})
    below = F.min((F.col("hi") < 0).cast("int")).over(down)  # this level and every higher one
    return got.withColumn("dominated_from", F.min(F.when(below == 1, F.col("level"))).over(Window.partitionBy(*by)))
