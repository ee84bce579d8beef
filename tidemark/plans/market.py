"""Queries of the named feature matrices and of the market calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.functions.order_statistics import quantiles
from tidemark.operators import calendar, features, matrices
from tidemark.plans.registry import BROUGHT, MARKET, W, full, of, over, percentile, query, robust, rounds
from tidemark.sources import adapters

_CONTEXT = ("corr_dax_60", "corr_ftse_60", "corr_stoxx_60", "corr_nikkei_60", "asia_overnight_1", "europe_prev_1", "beta_vix_60", "dxy_ret_1", "sector_dispersion_1")
_LINK = f"""g AS (SELECT *, count(r0 * r_le) {over(-60, -1)} = 60 AND max(r0) {over(-60, -1)} > min(r0) {over(-60, -1)} AND max(r_le) {over(-60, -1)} > min(r_le) {over(-60, -1)} AS ok FROM j),
    l AS (SELECT *, CASE WHEN ok THEN corr(r0, r_le) {over(-60, -1)} END AS corr, CASE WHEN ok THEN regr_slope(r_le, r0) {over(-60, -1)} END AS beta, CASE WHEN series_id LIKE 'SECTOR:%' THEN r_lt END AS sec FROM g)"""


@query(
    "context_matrix",
    f"""WITH {BROUGHT}, {_LINK}, p AS (SELECT session, {of('DAX', 'corr')} AS corr_dax_60, {of('FTSE', 'corr')} AS corr_ftse_60, {of('STOXX', 'corr')} AS corr_stoxx_60, {of('NIKKEI', 'corr')} AS corr_nikkei_60,
        ({of('NIKKEI', 'r_le')} + {of('HSI', 'r_le')}) / 2 AS asia_overnight_1, ({of('DAX', 'r_lt')} + {of('FTSE', 'r_lt')} + {of('STOXX', 'r_lt')}) / 3 AS europe_prev_1, {of('VIX', 'beta')} AS beta_vix_60, {of('DXY', 'r_lt')} AS dxy_ret_1,
        CASE WHEN count(sec) >= 2 THEN stddev_samp(sec) END AS sector_dispersion_1, CAST(count(sec) AS INTEGER) AS sector_count FROM l GROUP BY session), {robust('p', 'sector_dispersion_1', 'z')}
    SELECT p.session, {rounds(6, *_CONTEXT)}, sector_count, round(z.z, 5) AS sector_dispersion_1_z FROM p LEFT JOIN z ON p.session = z.session""",
)
def context_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(matrices.context(adapters.market_bars(spark, sf)), 6, *_CONTEXT), 5, "sector_dispersion_1_z")


@query(
    "context_pending_row",
    f"""WITH {MARKET}, last AS (SELECT max(session) + 1 AS session FROM spx), o AS (SELECT series_id, session, ln(close / lag(close) OVER w) AS r FROM market WHERE series_id <> 'SPX' {W}),
    e AS (SELECT series_id, max_by(r, o.session) AS r FROM (SELECT o.*, coalesce(r, 'nan'::DOUBLE) AS q FROM o) o, last WHERE o.session < last.session GROUP BY series_id)
    SELECT last.session, round(({of('NIKKEI', 'r')} + {of('HSI', 'r')}) / 2, 6) AS asia_overnight_1, round(({of('DAX', 'r')} + {of('FTSE', 'r')} + {of('STOXX', 'r')}) / 3, 6) AS europe_prev_1, round({of('DXY', 'r')}, 6) AS dxy_ret_1 FROM e, last GROUP BY last.session""",
)
def context_pending_row(spark: SparkSession, sf: str) -> DataFrame:
    """The row of a session that has not closed: the day after the anchor's last, read from the same plan."""
    bars = adapters.market_bars(spark, sf)
    day = bars.where("series_id = 'SPX'").agg(F.date_add(F.max("session"), 1).cast("string")).first()[0]
    got = matrices.context(matrices.with_pending(bars, day)).where(F.col("session") == F.lit(day).cast("date"))
    return rounded(got.select("session", "asia_overnight_1", "europe_prev_1", "dxy_ret_1"), 6, "asia_overnight_1", "europe_prev_1", "dxy_ret_1")


_OBS = """obs AS (SELECT ['DFF', 'DGS10', 'DGS2', 'T10Y2Y', 'CPIAUCSL', 'PCEPI', 'UNRATE'][l_linenumber] AS series_id, CAST(l_shipdate AS DATE) AS reference, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS published, max(l_extendedprice) AS value FROM lineitem  GROUP BY 1, 2, 3)"""
_MACRO = tuple(c for n in matrices.MACRO for c in (n, f"{n}_chg_5"))
_MACRO_SQL = ", ".join(f"{of(s, 'level')} AS {n}, {of(s, 'chg')} AS {n}_chg_5" for n, s in matrices.MACRO.items())


@query(
    "macro_matrix",
    f"""WITH {MARKET}, {_OBS}, t AS (SELECT session, series_id FROM spx s CROSS JOIN (SELECT DISTINCT series_id FROM obs) i) SELECT 1""".replace(
        "t AS (SELECT session, series_id FROM spx s CROSS JOIN (SELECT DISTINCT series_id FROM obs) i) SELECT 1",
        f"""days AS (SELECT session FROM spx), latest AS (SELECT series_id, published, max(reference) AS reference FROM obs GROUP BY 1, 2), t AS (SELECT * FROM days CROSS JOIN (SELECT DISTINCT series_id FROM obs)),
    k AS (SELECT t.series_id, t.session, l.reference FROM t ASOF LEFT JOIN latest l ON t.series_id = l.series_id AND t.session >= l.published),
    lv AS (SELECT k.*, x.value AS level, CASE WHEN day(reference - INTERVAL 1 YEAR) = day(reference) THEN CAST(reference - INTERVAL 1 YEAR AS DATE) END AS b FROM k LEFT JOIN obs x USING (series_id, reference)),
    y AS (SELECT lv.*, level - lag(level, 5) OVER (PARTITION BY lv.series_id ORDER BY session) AS chg, CASE WHEN q.published <= session THEN 100 * (level / nullif(q.value, 0) - 1) END AS yoy FROM lv LEFT JOIN obs q ON q.series_id = lv.series_id AND q.reference = lv.b),
    m AS (SELECT session, {_MACRO_SQL}, {of('CPIAUCSL', 'yoy')} AS cpi_yoy, {of('PCEPI', 'yoy')} AS pce_yoy FROM y GROUP BY session), d AS (SELECT days.session, x.close AS dxy FROM days ASOF LEFT JOIN (SELECT * FROM market WHERE series_id = 'DXY') x ON days.session >= x.session),
    f AS (SELECT m.*, d.dxy FROM m JOIN d USING (session)), {robust('f', 'ust_10y', 'z1')}, {robust('f', 'dxy', 'z2')}
    SELECT f.session, {rounds(4, *_MACRO, 'cpi_yoy', 'pce_yoy', 'dxy')}, round(z1.z, 5) AS ust_10y_z, round(z2.z, 5) AS dxy_z FROM f LEFT JOIN z1 ON f.session = z1.session LEFT JOIN z2 ON f.session = z2.session""",
    ),
)
def macro_matrix(spark: SparkSession, sf: str) -> DataFrame:
    got = matrices.macro_matrix(adapters.market_bars(spark, sf), adapters.macro_observations(spark, sf))
    return rounded(rounded(got, 4, *_MACRO, "cpi_yoy", "pce_yoy", "dxy"), 5, "ust_10y_z", "dxy_z")


_GOODS = ("oil_ret_1", "oil_ret_5", "gold_ret_1", "eurusd_ret_1")


@query(
    "commodities_matrix",
    f"""WITH {BROUGHT}, p AS (SELECT session, {of('OIL', 'r_lt')} AS oil_ret_1, {of('OIL', 'r5_lt')} AS oil_ret_5, {of('GOLD', 'r_lt')} AS gold_ret_1, {of('EURUSD', 'r_lt')} AS eurusd_ret_1 FROM j GROUP BY session), {robust('p', 'oil_ret_1', 'z')}
    SELECT p.session, {rounds(6, *_GOODS)}, round(z.z, 5) AS oil_ret_1_z FROM p LEFT JOIN z ON p.session = z.session""",
)
def commodities_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(matrices.commodities(adapters.market_bars(spark, sf)), 6, *_GOODS), 5, "oil_ret_1_z")


_REVERSION = ("vix_ts_slope", "vix_contango", "vix9d_vix", "breadth", "ret_5_pct")


@query(
    "reversion_matrix",
    f"""WITH {BROUGHT}, p AS (SELECT session, {of('VIX3M', 'c_lt')} / nullif({of('VIX9D', 'c_lt')}, 0) - 1 AS vix_ts_slope, {of('VIX', 'c_lt')} / nullif({of('VIX3M', 'c_lt')}, 0) - 1 AS vix_contango, {of('VIX9D', 'c_lt')} / nullif({of('VIX', 'c_lt')}, 0) - 1 AS vix9d_vix,
        avg(CASE WHEN series_id LIKE 'SECTOR:%' THEN CAST(r_lt > 0 AS INTEGER) END) AS breadth FROM j GROUP BY session),
    u AS (SELECT *, row_number() OVER w AS i, coalesce(close > lag(close) OVER w, false) AS up, ln(close / lag(close, 5) OVER w) AS r5 FROM spx {W}), b AS (SELECT *, i - max(CASE WHEN NOT up THEN i END) OVER w AS run FROM u {W}), s AS (SELECT session, lag(run) OVER w AS streak FROM b {W}), {percentile('u', 'r5', 'q')}
    SELECT s.session, CAST(streak AS INTEGER) AS streak_up, round(q.q, 6) AS ret_5_pct, {rounds(6, 'vix_ts_slope', 'vix_contango', 'vix9d_vix', 'breadth')} FROM s LEFT JOIN p ON s.session = p.session LEFT JOIN q ON s.session = q.session""",
)
def reversion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    got = matrices.reversion(adapters.market_bars(spark, sf))
    return rounded(got, 6, *_REVERSION).select("session", F.col("streak_up").cast("int").alias("streak_up"), *_REVERSION)


@query(
    "regime_percentile",
    f"""WITH {MARKET}, v AS (SELECT session, lag(pow(ln(high / low), 2) / (4 * ln(2))) OVER (ORDER BY session) AS rv FROM spx), {percentile('v', 'rv', 'q')} SELECT v.session, round(q.q, 6) AS rv_percentile FROM v LEFT JOIN q ON v.session = q.session""",
)
def regime_percentile(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.frames import lag
    from tidemark.functions.order_statistics import scored

    own = features.volatility(matrices.anchored(adapters.market_bars(spark, sf))).withColumn("rv_1", lag("parkinson_rv"))
    return rounded(scored(own, [("percentile", "rv_1", "rv_percentile", 250)]), 6, "rv_percentile").select("session", "rv_percentile")


@query("regime_matrix")
def regime_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matrices.regime(adapters.market_bars(spark, sf)), 6, "rv_percentile", "garch_forecast_z", "efficiency_ratio_20")


@query("volatility_matrix")
def volatility_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrices.volatility(adapters.market_bars(spark, sf))


_TR = f"greatest(high - low, abs(high - lag(close) {over('u', 0)}), abs(low - lag(close) {over('u', 0)}))"


@query(
    "technical_scores",
    f"""WITH {MARKET}, v AS (SELECT *, {_TR} AS tr, lag(close) {over('u', 0)} AS c1 FROM spx), w AS (SELECT session, {full('avg', 'tr', -14, -1)} / nullif(c1, 0) AS atr_norm, close / {full('avg', 'close', -19, 0)} - 1 AS dist_sma_20 FROM v), {robust('w', 'atr_norm', 'z1')}, {robust('w', 'dist_sma_20', 'z2')}
    SELECT w.session, {rounds(6, 'atr_norm', 'dist_sma_20')}, round(z1.z, 5) AS atr_norm_z, round(z2.z, 5) AS dist_sma_20_z FROM w LEFT JOIN z1 ON w.session = z1.session LEFT JOIN z2 ON w.session = z2.session""",
)
def technical_scores(spark: SparkSession, sf: str) -> DataFrame:
    got = matrices.technical(adapters.market_bars(spark, sf)).select("session", "atr_norm", "dist_sma_20", "atr_norm_z", "dist_sma_20_z")
    return rounded(rounded(got, 6, "atr_norm", "dist_sma_20"), 5, "atr_norm_z", "dist_sma_20_z")


@query("feature_frame")
def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    """All families side by side: the 63 columns of a session."""
    bars = adapters.market_bars(spark, sf)
    return matrices.joined([matrices.volatility(bars), matrices.technical(bars), matrices.context(bars), matrices.macro_matrix(bars, adapters.macro_observations(spark, sf)), matrices.regime(bars), matrices.commodities(bars), matrices.reversion(bars)])


@query(
    "design_frame",
    f"""WITH {BROUGHT}, p AS (SELECT session, ({of('NIKKEI', 'r_le')} + {of('HSI', 'r_le')}) / 2 AS asia_overnight_1, {of('OIL', 'r_lt')} AS oil_ret_1, {of('DXY', 'r_lt')} AS dxy_ret_1 FROM j GROUP BY session), y AS (SELECT session, close / open - 1 AS ret_long FROM spx WHERE volume % 5 <> 0)
    SELECT p.session, round(asia_overnight_1, 6) AS asia_overnight_1, round(back, 6) AS oil_ret_1, round(dxy_ret_1, 6) AS dxy_ret_1, round(ret_long, 6) AS ret_long, CAST(ret_long > 0 AS INTEGER) AS y FROM (SELECT *, lag(oil_ret_1) OVER (ORDER BY session) AS back FROM p) p JOIN y USING (session)""",
)
def design_frame(spark: SparkSession, sf: str) -> DataFrame:
    bars = adapters.market_bars(spark, sf)
    matrix = matrices.context(bars).join(matrices.commodities(bars), "session")
    labels = matrices.anchored(bars).where("volume % 5 <> 0").select("session", (F.col("close") / F.col("open") - 1).alias("ret_long"))
    return rounded(matrices.design(matrix, labels, ["asia_overnight_1", "oil_ret_1", "dxy_ret_1"]), 6, "asia_overnight_1", "oil_ret_1", "dxy_ret_1", "ret_long")


@query(
    "spread_candidates",
    f"""WITH {MARKET}, x AS (SELECT s.session, s.close AS c0, g.open AS o1, g.close AS c1 FROM spx s LEFT JOIN (SELECT * FROM market WHERE series_id = 'GOLD') g USING (session)) SELECT session, round(lag(c1) OVER o / nullif(lag(c0) OVER o, 0) - 1, 6) AS basis, round(ln(lag(o1) OVER o / lag(c1, 2) OVER o), 6) AS overnight FROM x WINDOW o AS (ORDER BY session)""",
)
def spread_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matrices.spread_candidates(adapters.market_bars(spark, sf), "GOLD"), 6, "basis", "overnight")


@query(
    "har_extras",
    f"""WITH {MARKET}, v AS (SELECT series_id, session, pow(ln(high / low), 2) / (4 * ln(2)) AS rv, pow(ln(close / open), 2) AS r2 FROM market), x AS (SELECT *, CASE WHEN rv > 0 THEN ln(4.0 / 3.0 * rv * rv) END AS l FROM v)
    SELECT series_id, session, round(lag(l) OVER w, 6) AS log_rv2_1, round(lag(greatest(0, r2 - rv)) OVER w, 6) AS jump_1 FROM x {W}""",
)
def har_extras(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matrices.har_extras(adapters.market_bars(spark, sf)), 6, "log_rv2_1", "jump_1")


@query(
    "term_structure",
    f"""WITH {MARKET}, x AS (SELECT s.session, a.close AS a, b.close AS b, c.close AS c FROM spx s LEFT JOIN (SELECT * FROM market WHERE series_id = 'VIX9D') a USING (session) LEFT JOIN (SELECT * FROM market WHERE series_id = 'VIX') b USING (session) LEFT JOIN (SELECT * FROM market WHERE series_id = 'VIX3M') c USING (session))
    SELECT session, lag(a) OVER o AS vix9d_1, lag(b) OVER o AS vix_1, lag(c) OVER o AS vix3m_1, round(lag(c) OVER o / nullif(lag(a) OVER o, 0) - 1, 6) AS slope_1 FROM x WINDOW o AS (ORDER BY session)""",
)
def term_structure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matrices.term_structure(adapters.market_bars(spark, sf)), 6, "slope_1")


# The drift study: sessions in segments.
_SEGMENTED = f"""{MARKET}, x AS (SELECT *, lag(close) OVER o AS c1 FROM spx WINDOW o AS (ORDER BY session)), sess AS (SELECT session, open = c1 AS stale, close / open - 1 AS intraday, open / c1 - 1 AS overnight, close / c1 - 1 AS total FROM x WHERE c1 IS NOT NULL),
    vol AS (SELECT *, CASE WHEN count(*) OVER f = 20 THEN stddev_samp(ln(1 + total)) OVER f END AS vol20 FROM sess WINDOW f AS (ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    """(session, stale, intraday, overnight, total, vol20): the parts of a session's return and the volatility of the twenty before."""
    line = Window.partitionBy("series_id").orderBy("session")
    c1 = F.lag("close").over(line)
    s = matrices.anchored(adapters.market_bars(spark, sf)).withColumn("c1", c1).where("c1 is not null")
    s = s.withColumns({"stale": F.col("open") == F.col("c1"), "intraday": F.col("close") / F.col("open") - 1, "overnight": F.col("open") / F.col("c1") - 1, "total": F.col("close") / F.col("c1") - 1})
    back = line.rowsBetween(-20, -1)
    return s.select("session", "stale", "intraday", "overnight", "total", F.when(F.count("total").over(back) == 20, F.stddev_samp(F.log1p("total")).over(back)).alias("vol20"))


@query(
    "drift_segments",
    f"""WITH {_SEGMENTED}, u AS (UNPIVOT (SELECT intraday, overnight, total FROM sess) ON intraday, overnight, total INTO NAME segment VALUE r)
    SELECT segment, count(*) AS n, round(avg(r) * 1e4, 4) AS mean_bp, round(median(r) * 1e4, 4) AS median_bp, round(stddev_samp(r) * 1e4, 4) AS std_bp, round(avg(r) / (stddev_samp(r) / sqrt(count(*))), 6) AS t_value, round(avg(CAST(r > 0 AS INTEGER)), 6) AS hit_rate, round(sum(ln(1 + r)), 4) AS log_total FROM u GROUP BY segment""",
)
def drift_segments(spark: SparkSession, sf: str) -> DataFrame:
    names = ("intraday", "overnight", "total")
    rows = segmented(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(n).alias("segment"), F.col(n).alias("r")) for n in names))).alias("x")).select("x.*")
    r = F.col("r")
    got = rows.groupBy("segment").agg(F.count("*").alias("n"), (F.avg(r) * 1e4).alias("mean_bp"), (F.stddev_samp(r) * 1e4).alias("std_bp"), (F.avg(r) / (F.stddev_samp(r) / F.sqrt(F.count("*")))).alias("t_value"), F.avg((r > 0).cast("int")).alias("hit_rate"), F.sum(F.log1p(r)).alias("log_total"))
    got = got.join(quantiles(rows, ["segment"], r, {"m": 0.5}), "segment").withColumn("median_bp", F.col("m") * 1e4).drop("m")
    return rounded(rounded(got, 4, "mean_bp", "median_bp", "std_bp", "log_total"), 6, "t_value", "hit_rate")


@query("base_rate", f"WITH {_SEGMENTED} SELECT count(*) AS n, count_if(intraday > 0) AS n_up, round(avg(CAST(intraday > 0 AS INTEGER)), 6) AS up_share, round(quantile_cont(abs(intraday) * 1e4, 0.5), 4) AS median_bp, round(quantile_cont(abs(intraday) * 1e4, 0.9), 4) AS p90_bp, round(quantile_cont(abs(intraday) * 1e4, 0.99), 4) AS p99_bp FROM sess")
def base_rate(spark: SparkSession, sf: str) -> DataFrame:
    s = segmented(spark, sf)
    got = s.agg(F.count("*").alias("n"), F.count_if(F.col("intraday") > 0).alias("n_up"), F.avg((F.col("intraday") > 0).cast("int")).alias("up_share"))
    q = quantiles(s, [], F.abs("intraday") * 1e4, {"median_bp": 0.5, "p90_bp": 0.9, "p99_bp": 0.99})
    return rounded(rounded(got.crossJoin(q), 6, "up_share"), 4, "median_bp", "p90_bp", "p99_bp")


@query("paired_difference", f"WITH {_SEGMENTED} SELECT count(*) AS n, round(avg(intraday - overnight) * 1e4, 4) AS mean_bp, round(avg(intraday - overnight) / (stddev_samp(intraday - overnight) / sqrt(count(*))), 6) AS t_value FROM sess")
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("intraday") - F.col("overnight")
    got = segmented(spark, sf).agg(F.count("*").alias("n"), (F.avg(d) * 1e4).alias("mean_bp"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t_value"))
    return rounded(rounded(got, 4, "mean_bp"), 6, "t_value")


def _grouped(df: DataFrame, key: str) -> DataFrame:
    got = df.groupBy(key).agg(
        F.count("*").alias("n"), *((F.avg(c) * 1e4).alias(f"{c}_mean_bp") for c in ("intraday", "overnight", "total")), F.avg((F.col("intraday") > 0).cast("int")).alias("hit_rate"), F.avg(F.col("stale").cast("int")).alias("stale_share")
    )
    return rounded(rounded(got, 4, "intraday_mean_bp", "overnight_mean_bp", "total_mean_bp"), 6, "hit_rate", "stale_share")


_GROUP = "count(*) AS n, round(avg(intraday) * 1e4, 4) AS intraday_mean_bp, round(avg(overnight) * 1e4, 4) AS overnight_mean_bp, round(avg(total) * 1e4, 4) AS total_mean_bp, round(avg(CAST(intraday > 0 AS INTEGER)), 6) AS hit_rate, round(avg(CAST(stale AS INTEGER)), 6) AS stale_share"


@query("drift_by_year", f"WITH {_SEGMENTED} SELECT CAST(year(session) AS INTEGER) AS year, {_GROUP} FROM sess GROUP BY 1")
def drift_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(segmented(spark, sf).withColumn("year", F.year("session")), "year")


@query(
    "drift_by_volatility",
    f"""WITH {_SEGMENTED}, k AS (SELECT *, row_number() OVER (ORDER BY vol20) - 1 AS i, count(*) OVER () AS n0 FROM vol WHERE vol20 IS NOT NULL), t AS (SELECT max(CASE WHEN i = round((n0 - 1) / 3.0) THEN vol20 END) AS lo, max(CASE WHEN i = round(2 * (n0 - 1) / 3.0) THEN vol20 END) AS hi FROM k)
    SELECT CASE WHEN vol20 <= lo THEN 'low' WHEN vol20 <= hi THEN 'medium' ELSE 'high' END AS regime, {_GROUP} FROM vol, t WHERE vol20 IS NOT NULL GROUP BY 1""",
)
def drift_by_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Terciles by the nearest ranks of the volatility before a session."""
    df = segmented(spark, sf).where("vol20 is not null")
    n = df.count()
    ranks = df.select("vol20", (F.row_number().over(Window.orderBy("vol20")) - 1).alias("i"))
    at = lambda k: F.max(F.when(F.col("i") == int(k + 0.5), F.col("vol20")))
    cut = ranks.agg(at((n - 1) / 3).alias("lo"), at(2 * (n - 1) / 3).alias("hi"))
    regime = F.when(F.col("vol20") <= F.col("lo"), "low").when(F.col("vol20") <= F.col("hi"), "medium").otherwise("high")
    return _grouped(df.crossJoin(F.broadcast(cut)).withColumn("regime", regime), "regime")


@query(
    "clean_sample",
    f"""WITH {MARKET}, x AS (SELECT series_id, session, open = lag(close) OVER w AS stale FROM market {W}), y AS (SELECT series_id, year(session) AS y, avg(CAST(stale AS INTEGER)) AS share FROM x GROUP BY 1, 2), z AS (SELECT *, max(share) OVER (PARTITION BY series_id ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM y),
    c AS (SELECT series_id, min(y) AS y FROM z WHERE worst <= 0.05 GROUP BY series_id) SELECT x.series_id, count(*) AS n, min(session) AS first, max(session) AS last FROM x JOIN c USING (series_id) WHERE year(session) >= c.y AND NOT stale GROUP BY x.series_id HAVING count(*) >= 250""",
)
def clean_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions from the first year on after which no year has too many stale opens, without the stale ones, if there are enough."""
    line = Window.partitionBy("series_id").orderBy("session")
    x = adapters.market_bars(spark, sf).select("series_id", "session", (F.col("open") == F.lag("close").over(line)).alias("stale"), F.year("session").alias("y"))
    share = x.groupBy("series_id", "y").agg(F.avg(F.col("stale").cast("int")).alias("share"))
    worst = share.withColumn("worst", F.max("share").over(Window.partitionBy("series_id").orderBy("y").rowsBetween(0, Window.unboundedFollowing)))
    cut = worst.where("worst <= 0.05").groupBy("series_id").agg(F.min("y").alias("from_y"))
    got = x.join(cut, "series_id").where("y >= from_y and not stale").groupBy("series_id").agg(F.count("*").alias("n"), F.min("session").alias("first"), F.max("session").alias("last"))
    return got.where("n >= 250")


_DAYS = """d AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP), CAST(last_day(max(o_orderdate)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM orders),
    y AS (SELECT *, year(day) AS y, CAST(date_trunc('month', day) AS DATE) AS m1, make_date(year(day), 1, 1) AS j1 FROM d),
    e AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), e2 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM e), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2), e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS p FROM e3),
    f AS (SELECT *, make_date(y, p // 31, p % 31 + 1) AS easter FROM e4), nth AS (SELECT *, CAST(m1 + CAST((1 - isodow(m1) + 7) % 7 AS INTEGER) AS DATE) AS mon1, CAST(m1 + CAST((4 - isodow(m1) + 7) % 7 AS INTEGER) AS DATE) AS thu1, CAST(m1 + CAST((5 - isodow(m1) + 7) % 7 AS INTEGER) AS DATE) AS fri1 FROM f),
    obs AS (SELECT *, CASE WHEN isodow(day) = 1 THEN day - 1 WHEN isodow(day) = 5 THEN day + 1 ELSE day END AS alt FROM nth),
    r AS (SELECT *, CASE WHEN (month(day) = 1 AND day(day) = 1 AND isodow(day) < 7) OR (month(day) = 1 AND day(day) = 2 AND isodow(day) = 1) THEN 'new_year' WHEN y >= 1998 AND month(day) = 1 AND day = mon1 + 14 THEN 'martin_luther_king' WHEN month(day) = 2 AND day = mon1 + 14 THEN 'washington' WHEN day = easter - 2 THEN 'good_friday'
        WHEN month(day) = 5 AND isodow(day) = 1 AND day(day) > 24 THEN 'memorial' WHEN (month(day) = 7 AND day(day) = 4 AND isodow(day) < 6) OR (isodow(day) IN (1, 5) AND month(alt) = 7 AND day(alt) = 4) THEN 'independence' WHEN month(day) = 9 AND day = mon1 THEN 'labor' WHEN month(day) = 11 AND day = thu1 + 21 THEN 'thanksgiving'
        WHEN (month(day) = 12 AND day(day) = 25 AND isodow(day) < 6) OR (isodow(day) IN (1, 5) AND month(alt) = 12 AND day(alt) = 25) THEN 'christmas' WHEN isodow(day) > 5 THEN 'weekend' END AS reason FROM obs),
    s AS (SELECT *, reason IS NULL AS is_session, reason IS NULL AND ((month(day) = 12 AND day(day) = 24) OR (month(day) = 7 AND day(day) = 3) OR (month(day) = 11 AND day = thu1 + 22)) AS is_half_day FROM r)"""


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.days_of(adapters.table(spark, sf, "orders"), "o_orderdate")


@query(
    "market_calendar",
    f"""WITH {_DAYS} SELECT day, reason, is_session, is_half_day, CAST(CASE WHEN NOT is_session THEN 0.0 WHEN is_half_day THEN 3.5 ELSE 6.5 END AS DOUBLE) AS hours, last_value(CASE WHEN is_session THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_session,
        first_value(CASE WHEN is_session THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session, is_session AND coalesce(day = max(CASE WHEN is_session AND day <= fri1 + 14 THEN day END) OVER (PARTITION BY m1), false) AS is_opex FROM s""",
)
def market_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar of the months in which there are orders."""
    got = calendar.calendar(_order_days(spark, sf))
    return got.select("day", F.when(F.col("reason") == "weekend", F.col("reason")).otherwise(F.col("reason")).alias("reason"), "is_session", "is_half_day", "hours", "previous_session", "next_session", "is_opex")


@query(
    "session_hours_utc",
    """WITH d AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP), CAST(last_day(max(o_orderdate)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM orders), m AS (SELECT *, make_date(year(day), 3, 1) AS m3, make_date(year(day), 4, 1) AS m4, make_date(year(day), 10, 31) AS o31 FROM d),
    z AS (SELECT *, day >= m4 + CAST((7 - isodow(m4)) % 7 AS INTEGER) AND day < o31 - CAST(isodow(o31) % 7 AS INTEGER) AS summer FROM m)
    SELECT day, CAST(day AS TIMESTAMP) + INTERVAL 30 MINUTE + CASE WHEN summer THEN INTERVAL 13 HOUR ELSE INTERVAL 14 HOUR END AS open_utc FROM z WHERE isodow(day) < 6""",
)
def session_hours_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Opening instants across clock changes; before 2007 summer time ran from April to October."""
    days = _order_days(spark, sf).where(F.weekday("day") < 5)
    return days.select("day", calendar.utc(F.col("day"), calendar.OPEN).cast("timestamp_ntz").alias("open_utc"))
