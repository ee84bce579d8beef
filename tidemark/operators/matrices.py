"""The named feature matrices: one row an anchor session, from the bars of all series in one long table.

bars holds (series_id, session, open, high, low, close, volume) of every series; an anchor is one of them. Returns are
taken on a series' own calendar before they are brought to the anchor's sessions as of (`_le`) or before (`_lt`) them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import lag, log_return, positive, ratio
from tidemark.functions.order_statistics import scored
from tidemark.operators import features, garch, macro, metrics
from tidemark.operators.asof import as_of, on_every, rolling_link

ANCHOR, SECTOR = "SPX", "SECTOR:"
#: Sessions back at which a column may be read when a session is decided; columns that are not named here: 1.
SAME_DAY = (
    "atr_norm", "har_lag1", "har_lag4", "har_lag17", "har_forecast", "vix_level", "vix_zscore", "vix_percentile", "atr_norm_z", "asia_overnight_1", "europe_prev_1",
    "dxy_ret_1", "sector_dispersion_1", "rv_percentile", "garch_forecast", "garch_forecast_z", "day_of_week", "is_es_roll_session",
)
#: The ten columns of the plainest model.
BASELINE = ("har_forecast", "vix_zscore", "dist_sma_20_z", "asia_overnight_1", "europe_prev_1", "dxy_ret_1", "sector_dispersion_1", "ust_10y_chg_5", "garch_forecast_z", "is_es_roll_session")


def anchored(bars: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    return bars.where(F.col("series_id") == anchor)


def brought(bars: DataFrame, carry: Mapping[str, Column], anchor: str = ANCHOR) -> DataFrame:
    """(series_id, session, r0, and for each name in carry its value _le and _lt): other series at the anchor's sessions."""
    own = anchored(bars, anchor).select("series_id", "session", log_return(F.col("close")).alias("r0")).drop("series_id")
    other = bars.where(F.col("series_id") != anchor).select("series_id", "session", *(c.alias(n) for n, c in carry.items()))
    grid = on_every(own, other)
    named = lambda df, tail: df.withColumnsRenamed({n: n + tail for n in carry})
    upto = named(as_of(grid, other, ["series_id"], "session", list(carry)), "_le")
    return named(as_of(upto, other, ["series_id"], "session", list(carry), strict=True), "_lt")


def _of(series: str, column: str) -> Column:
    return F.max(F.when(F.col("series_id") == series, F.col(column)))


def _mean(*parts: Column) -> Column:
    """The mean, null if a part is."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def context(bars: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the eleven context columns)."""
    at = brought(bars, {"r": log_return(F.col("close"))}, anchor)
    at = at.withColumns(rolling_link(at, F.col("r0"), F.col("r_le")))
    sector = F.when(F.col("series_id").startswith(SECTOR), F.col("r_lt"))
    got = at.groupBy("session").agg(
        *(_of(s, "corr").alias(f"corr_{n}_60") for n, s in (("dax", "DAX"), ("ftse", "FTSE"), ("stoxx", "STOXX"), ("nikkei", "NIKKEI"))),
        _mean(_of("NIKKEI", "r_le"), _of("HSI", "r_le")).alias("asia_overnight_1"),
        _mean(_of("DAX", "r_lt"), _of("FTSE", "r_lt"), _of("STOXX", "r_lt")).alias("europe_prev_1"),
        _of("VIX", "beta").alias("beta_vix_60"),
        _of("DXY", "r_lt").alias("dxy_ret_1"),
        F.when(F.count(sector) >= 2, F.stddev_samp(sector)).alias("sector_dispersion_1"),
        F.count(sector).cast("int").alias("sector_count"),
    )
    return _z(got, anchor, "sector_dispersion_1", least=least)


def _z(df: DataFrame, anchor: str, *columns: str, least: int = 250) -> DataFrame:
    return scored(df.withColumn("series_id", F.lit(anchor)), [("robust", c, f"{c}_z", least) for c in columns]).drop("series_id")


MACRO = {"fed_funds": "DFF", "ust_10y": "DGS10", "ust_2y": "DGS2", "pendiente_2s10s": "T10Y2Y"}
YEARLY = {"cpi_yoy": "CPIAUCSL", "pce_yoy": "PCEPI"}


def macro_matrix(bars: DataFrame, observations: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the thirteen macro columns) from observations (series_id, reference, published, value)."""
    sessions = anchored(bars, anchor).select("session")
    known = macro.year_over_year(macro.levels(sessions, observations), observations)
    got = known.groupBy("session").agg(*(x for n, s in MACRO.items() for x in (_of(s, "level").alias(n), _of(s, "level_chg").alias(f"{n}_chg_5"))), *(_of(s, "yoy").alias(n) for n, s in YEARLY.items()))
    dollar = as_of(sessions.withColumn("series_id", F.lit("DXY")), bars.where("series_id = 'DXY'"), ["series_id"], "session", ["close"])
    got = sessions.join(got, "session", "left").join(dollar.select("session", F.col("close").alias("dxy")), "session", "left")
    return _z(got, anchor, "ust_10y", "dxy", least=least)


def commodities(bars: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the five commodity columns)."""
    at = brought(bars.where(F.col("series_id").isin(anchor, "OIL", "GOLD", "EURUSD")), {"r": log_return(F.col("close")), "r5": log_return(F.col("close"), 5)}, anchor)
    got = at.groupBy("session").agg(_of("OIL", "r_lt").alias("oil_ret_1"), _of("OIL", "r5_lt").alias("oil_ret_5"), _of("GOLD", "r_lt").alias("gold_ret_1"), _of("EURUSD", "r_lt").alias("eurusd_ret_1"))
    return _z(got, anchor, "oil_ret_1", least=least)


def reversion(bars: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the six reversion columns): ratios of volatility terms, breadth of sectors, streak and percentile."""
    at = brought(bars, {"c": positive(F.col("close")), "r": log_return(F.col("close"))}, anchor)
    sector = F.when(F.col("series_id").startswith(SECTOR), F.col("r_lt"))
    close = lambda s: _of(s, "c_lt")
    got = at.groupBy("session").agg(
        (ratio(close("VIX3M"), close("VIX9D")) - 1).alias("vix_ts_slope"),
        (ratio(close("VIX"), close("VIX3M")) - 1).alias("vix_contango"),
        (ratio(close("VIX9D"), close("VIX")) - 1).alias("vix9d_vix"),
        F.avg((sector > 0).cast("int")).alias("breadth"),
    )
    own = features.reversion(anchored(bars, anchor), least).select("session", "streak_up", "ret_5_pct")
    return own.join(got, "session", "left")


def regime(bars: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the seven regime columns)."""
    own = anchored(bars, anchor)
    df = features.volatility(features.regime(own)).withColumn("rv_1", lag("parkinson_rv"))
    df = df.join(garch.forecasts(own), ["series_id", "session"], "left")
    df = scored(df, [("percentile", "rv_1", "rv_percentile", least), ("robust", "garch_forecast", "garch_forecast_z", least)])
    return df.select("session", "rv_percentile", "garch_forecast", "garch_forecast_z", "efficiency_ratio_20", "day_of_week", "sessions_to_opex", "is_es_roll_session")


def volatility(bars: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the twelve volatility columns); the level is the close of VIX on the anchor's session before."""
    own = anchored(bars, anchor)
    df = features.volatility(own)
    fear = bars.where("series_id = 'VIX'").select("session", F.col("close").alias("vix"))
    level = own.select("series_id", "session").join(fear, "session", "left").withColumn("close", F.col("vix")).drop("vix")
    scores = features.level_scores(level, least).select("session", F.col("level").alias("vix_level"), F.col("level_zscore").alias("vix_zscore"), F.col("level_percentile").alias("vix_percentile"))
    har = metrics.har_forecasts(df).select("session", "har_forecast")
    return df.select("session", "true_range", "atr_norm", "parkinson_rv", "ret_log", "ret_sq", "har_lag1", "har_lag4", "har_lag17").join(har, "session", "left").join(scores, "session", "left")


def technical(bars: DataFrame, anchor: str = ANCHOR, least: int = 250) -> DataFrame:
    """(session and the ten technical columns)."""
    own = anchored(bars, anchor)
    df = features.wilder_rsi(features.technical(own)).join(features.volatility(own).select("session", "atr_norm"), "session", "left")
    df = features.robust_z(df, "atr_norm", "dist_sma_20", least=least)
    return df.select("session", "ret_1", "ret_5", "ret_21", "atr_norm", "dist_sma_20", "rsi_14", "range_pos_20", "vol_break_20", "atr_norm_z", "dist_sma_20_z")


def joined(families: list[DataFrame], key: str = "session") -> DataFrame:
    """Families side by side on the sessions of the first, each key once a family: an error if one repeats.

    A column that two families hold is taken from the first, if they agree in every row, else it is an error.
    """
    out = families[0]
    for f in families:
        if not f.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError("a session repeats in a family")
    for f in families[1:]:
        twice = [c for c in f.columns if c != key and c in out.columns]
        both = out.join(f.withColumnsRenamed({c: f"_{c}" for c in twice}), key, "left")
        for c in twice:
            if not both.where(~F.col(c).eqNullSafe(F.col(f"_{c}"))).isEmpty():
                raise ValueError(f"families differ in {c}")
        out = both.drop(*(f"_{c}" for c in twice))
    return out


def with_pending(bars: DataFrame, session: str, anchor: str = ANCHOR) -> DataFrame:
    """bars with a row of nulls for the anchor on a session that has not closed, so that every kernel reaches it."""
    empty = anchored(bars, anchor).limit(0)
    row = bars.sparkSession.range(1).select(F.lit(anchor).alias("series_id"), F.lit(session).cast("date").alias("session"))
    return bars.unionByName(empty).unionByName(row, allowMissingColumns=True)


def available(matrix: DataFrame, columns: list[str], lags: Mapping[str, int] | None = None) -> DataFrame:
    """(session, columns): each column as it may be read at the session, by its lag in rows (SAME_DAY: 0, others 1)."""
    line = Window.orderBy("session")
    back = lambda c: (lags or {}).get(c, 0 if c in SAME_DAY else 1)
    return matrix.select("session", *((F.lag(c, back(c)).over(line) if back(c) else F.col(c)).alias(c) for c in columns))


def design(matrix: DataFrame, labels: DataFrame, columns: list[str], target: str = "ret_long", lags: Mapping[str, int] | None = None) -> DataFrame:
    """(session, columns, target, y): the readable columns of the sessions that have a label; y is whether target is above 0."""
    got = available(matrix, columns, lags).join(labels.select("session", target), "session")
    return got.withColumn("y", (F.col(target) > 0).cast("int"))


def completeness(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """(session, missing): the names of the null columns of the last row."""
    last = matrix.groupBy().agg(F.max_by(F.struct("session", *columns), "session").alias("x")).select("x.*")
    return last.select("session", F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda n: n.isNotNull()).alias("missing"))


def spread_candidates(bars: DataFrame, future: str, anchor: str = ANCHOR) -> DataFrame:
    """(session, basis, overnight): the future over the anchor at the session before, and its log move from close to open."""
    own = anchored(bars, anchor).select("session", F.col("close").alias("c0"), F.lit(anchor).alias("series_id"))
    other = bars.where(F.col("series_id") == future).select("session", F.col("open").alias("o1"), F.col("close").alias("c1"))
    df = own.join(other, "session", "left")
    back = lambda c, n: positive(lag(c, n))
    return df.select("session", (ratio(back("c1", 1), back("c0", 1)) - 1).alias("basis"), F.log(back("o1", 1) / back("c1", 2)).alias("overnight"))


def har_extras(bars: DataFrame) -> DataFrame:
    """(series_id, session, log_rv2_1, jump_1): the log of 4/3 of the squared variance and the jump part, of the session before."""
    df = features.volatility(bars)
    rq = F.log(4.0 / 3.0 * F.col("parkinson_rv") * F.col("parkinson_rv"))
    return df.select("series_id", "session", lag(F.when(F.col("parkinson_rv") > 0, rq)).alias("log_rv2_1"), lag(F.greatest(F.lit(0.0), F.col("ret_sq") - F.col("parkinson_rv"))).alias("jump_1"))


def term_structure(bars: DataFrame, anchor: str = ANCHOR, series: tuple[str, ...] = ("VIX9D", "VIX", "VIX3M")) -> DataFrame:
    """(session, level of each series on the session before, slope of the last over the first)."""
    own = anchored(bars, anchor).select("session", F.lit(anchor).alias("series_id"))
    df = own
    for s in series:
        df = df.join(bars.where(F.col("series_id") == s).select("session", F.col("close").alias(s.lower())), "session", "left")
    levels = {f"{s.lower()}_1": lag(s.lower()) for s in series}
    df = df.withColumns(levels)
    return df.select("session", *levels, (ratio(F.col(f"{series[-1].lower()}_1"), F.col(f"{series[0].lower()}_1")) - 1).alias("slope_1"))
