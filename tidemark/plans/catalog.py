"""Registered queries over the driver tables, and their DuckDB SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import log_return, rounded
from tidemark.operators import asof, costs, features, labels, macro, metrics, quality
from tidemark.plans.registry import ANCHOR, BARS, QUERIES, SEGMENTS, SQL, W, full, over, query
from tidemark.sources import adapters, store
from tidemark.streaming.bars import windowed_bars

@query("session_bars", f"WITH {BARS} SELECT * FROM bars")
def session_bars(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.order_bars(spark, sf)


_TR = f"greatest(high - low, abs(high - lag(close) {over('u', 0)}), abs(low - lag(close) {over('u', 0)}))"
_VOL = f"vol AS (SELECT *, {_TR} AS tr, pow(ln(high / low), 2) / (4 * ln(2)) AS rv, ln(close / open) AS rl, lag(close) {over('u', 0)} AS c1 FROM bars)"


@query(
    "volatility_features",
    f"""WITH {BARS}, {_VOL}, har AS (SELECT *, {full('avg', 'tr', -14, -1)} AS atr, {full('avg', 'rv', -22, -6)} AS m, {full('avg', 'rv', -5, -2)} AS wk, lag(rv) {over('u', 0)} AS d FROM vol)
    SELECT series_id, session, round(tr, 6) AS true_range, round(atr / nullif(c1, 0), 6) AS atr_norm, round(rv, 6) AS parkinson_rv, round(rl, 6) AS ret_log, round(rl * rl, 6) AS ret_sq,
        round(CASE WHEN m IS NOT NULL THEN d END, 6) AS har_lag1, round(CASE WHEN m IS NOT NULL THEN wk END, 6) AS har_lag4, round(m, 6) AS har_lag17 FROM har""",
)
def volatility_features(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["true_range", "atr_norm", "parkinson_rv", "ret_log", "ret_sq", "har_lag1", "har_lag4", "har_lag17"]
    return rounded(features.volatility(adapters.order_bars(spark, sf)), 6, *cols).select("series_id", "session", *cols)


@query(
    "level_scores",
    f"""WITH {BARS}, lv AS (SELECT series_id, session, lag(close) {over('u', 0)} AS level FROM bars),
    st AS (SELECT *, count(level) {over('u', -1)} AS n, avg(level) {over('u', -1)} AS mu, avg(level * level) {over('u', -1)} AS m2, list(level) FILTER (level IS NOT NULL) {over('u', -1)} AS past FROM lv)
    SELECT series_id, session, level, CASE WHEN n >= 250 AND m2 - mu * mu > 0 THEN round((level - mu) / sqrt((m2 - mu * mu) * n / (n - 1)), 6) END AS level_zscore,
        CASE WHEN n >= 250 AND level IS NOT NULL THEN round(len(list_filter(past, lambda v: v <= level)) / n, 6) END AS level_percentile FROM st""",
)
def level_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.level_scores(adapters.order_bars(spark, sf)), 6, "level_zscore", "level_percentile").select("series_id", "session", "level", "level_zscore", "level_percentile")


@query(
    "technical_features",
    f"""WITH {BARS}, {_VOL} SELECT series_id, session, round(ln(close / lag(close) {over('u', 0)}), 6) AS ret_1, round(ln(close / lag(close, 5) {over('u', 0)}), 6) AS ret_5, round(ln(close / lag(close, 21) {over('u', 0)}), 6) AS ret_21,
        round(close / {full('avg', 'close', -19, 0)} - 1, 6) AS dist_sma_20, round((close - {full('min', 'low', -19, 0)}) / nullif({full('max', 'high', -19, 0)} - {full('min', 'low', -19, 0)}, 0), 6) AS range_pos_20,
        round(tr / nullif({full('avg', 'tr', -20, -1)}, 0), 6) AS vol_break_20 FROM vol""",
)
def technical_features(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["ret_1", "ret_5", "ret_21", "dist_sma_20", "range_pos_20", "vol_break_20"]
    return rounded(features.technical(adapters.order_bars(spark, sf)), 6, *cols).select("series_id", "session", *cols)


@query(
    "robust_zscore",
    f"""WITH {BARS}, d AS (SELECT series_id, session, close / {full('avg', 'close', -19, 0)} - 1 AS x FROM bars), k AS (SELECT * FROM d WHERE x IS NOT NULL),
    h AS (SELECT *, median(x) {over('u', 0)} AS med, list(x) {over('u', 0)} AS past FROM k), m AS (SELECT *, list_median(list_transform(past, lambda v: abs(v - med))) AS mad FROM h)
    SELECT series_id, session, round(d.x, 6) AS dist_sma_20, round(CASE WHEN len(past) >= 250 AND mad > 0 THEN (m.x - med) / (1.4826 * mad) END, 6) AS dist_sma_20_z FROM d LEFT JOIN m USING (series_id, session)""".replace("list_median(", "list_aggregate(").replace("abs(v - med))) AS mad", "abs(v - med)), 'median') AS mad"),
)
def robust_zscore(spark: SparkSession, sf: str) -> DataFrame:
    df = features.technical(adapters.order_bars(spark, sf)).select("series_id", "session", "dist_sma_20")
    return rounded(features.robust_z(df, "dist_sma_20"), 6, "dist_sma_20", "dist_sma_20_z")


@query(
    "wilder_rsi",
    f"""WITH RECURSIVE {BARS}, m AS (SELECT series_id, session, close, close - lag(close) {over('u', 0)} AS d, row_number() OVER w AS i FROM bars {W}), seed AS (SELECT series_id, sum(greatest(d, 0)) / 14 AS g, sum(greatest(-d, 0)) / 14 AS l FROM m WHERE i BETWEEN 2 AND 15 GROUP BY series_id HAVING count(*) = 14),
    r(series_id, i, g, l) AS (SELECT series_id, 15, g, l FROM seed UNION ALL SELECT m.series_id, CAST(m.i AS INTEGER), (r.g * 13 + greatest(m.d, 0)) / 14, (r.l * 13 + greatest(-m.d, 0)) / 14 FROM r JOIN m ON m.series_id = r.series_id AND m.i = r.i + 1)
    SELECT m.series_id, m.session, m.close, round(CASE WHEN r.g = 0 AND r.l = 0 THEN 50 WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END, 6) AS rsi_14 FROM m LEFT JOIN r ON r.series_id = m.series_id AND r.i = m.i""",
)
def wilder_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.wilder_rsi(adapters.order_bars(spark, sf)), 6, "rsi_14").select("series_id", "session", "close", "rsi_14")


@query(
    "regime_features",
    f"""WITH {BARS}, s AS (SELECT *, abs(close - lag(close) {over('u', 0)}) AS step, row_number() OVER w AS i, date_trunc('month', session) AS mo FROM bars {W}),
    t AS (SELECT *, CAST(mo AS DATE) + CAST((5 - isodow(mo) + 7) % 7 + 14 AS INTEGER) AS third FROM s), o AS (SELECT *, session = max(CASE WHEN session <= third THEN session END) OVER (PARTITION BY series_id, mo) AS opex FROM t)
    SELECT series_id, session, round(abs(close - lag(close, 20) {over('u', 0)}) / nullif({full('sum', 'step', -19, 0)}, 0), 6) AS efficiency_ratio_20, CAST(isodow(session) AS INTEGER) AS day_of_week,
        CAST(min(CASE WHEN opex THEN i END) OVER (PARTITION BY series_id ORDER BY session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i AS INTEGER) AS sessions_to_opex,
        CAST(coalesce(opex, false) AND month(session) IN (3, 6, 9, 12) AS INTEGER) AS is_es_roll_session FROM o""",
)
def regime_features(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["efficiency_ratio_20", "day_of_week", "sessions_to_opex", "is_es_roll_session"]
    return rounded(features.regime(adapters.order_bars(spark, sf)), 6, "efficiency_ratio_20").select("series_id", "session", *cols)


@query(
    "reversion_features",
    f"""WITH {BARS}, u AS (SELECT *, row_number() OVER w AS i, coalesce(close > lag(close) OVER w, false) AS up, ln(close / lag(close, 5) OVER w) AS r5 FROM bars {W}),
    b AS (SELECT *, i - max(CASE WHEN NOT up THEN i END) OVER w AS run, list(r5) FILTER (r5 IS NOT NULL) {over('u', -1)} AS past FROM u {W})
    SELECT series_id, session, CAST(lag(run) OVER w AS INTEGER) AS streak_up, round(r5, 6) AS ret_5, round(CASE WHEN len(past) >= 250 AND r5 IS NOT NULL THEN len(list_filter(past, lambda v: v <= r5)) / len(past) END, 6) AS ret_5_pct FROM b {W}""",
)
def reversion_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.reversion(adapters.order_bars(spark, sf)), 6, "ret_5", "ret_5_pct").select("series_id", "session", "streak_up", "ret_5", "ret_5_pct")


@query(
    "breadth_dispersion",
    f"""WITH {SEGMENTS}, r AS (SELECT session, ln(close / lag(close) OVER w) AS r FROM bars {W})
    SELECT session, count(r) AS n, round(avg(CAST(r > 0 AS INTEGER)), 6) AS breadth, round(CASE WHEN count(r) >= 2 THEN stddev_samp(r) END, 6) AS dispersion FROM r GROUP BY session""",
)
def breadth_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.breadth(adapters.segment_bars(spark, sf)), 6, "breadth", "dispersion")


def _context(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    anchor = adapters.order_bars(spark, sf, anchor=True).select("session", log_return(F.col("close")).alias("r0"))
    other = adapters.order_bars(spark, sf).withColumn("r", log_return(F.col("close")))
    return asof.as_of(asof.on_every(anchor, other), other, ["series_id"], "session", ["r"], strict=strict)


def _context_sql(op: str) -> str:
    return f"""{ANCHOR.replace('bars AS', 'anchor AS')}, {BARS}, a AS (SELECT session, ln(close / lag(close) OVER (ORDER BY session)) AS r0 FROM anchor), o AS (SELECT series_id, session, ln(close / lag(close) OVER w) AS r FROM bars {W}),
    t AS (SELECT * FROM a CROSS JOIN (SELECT DISTINCT series_id FROM o)), j AS (SELECT t.series_id, t.session, t.r0, o.r FROM t ASOF LEFT JOIN o ON t.series_id = o.series_id AND t.session {op} o.session)"""


@query("asof_returns_before", f"WITH {_context_sql('>')} SELECT series_id, session, round(r, 6) AS r FROM j")
def asof_returns_before(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_context(spark, sf, True), 6, "r").select("series_id", "session", "r")


@query(
    "rolling_correlation_beta",
    f"""WITH {_context_sql('>=')}, g AS (SELECT *, count(r0 * r) {over(-60, -1)} = 60 AND max(r0) {over(-60, -1)} > min(r0) {over(-60, -1)} AND max(r) {over(-60, -1)} > min(r) {over(-60, -1)} AS ok FROM j)
    SELECT series_id, session, round(CASE WHEN ok THEN corr(r0, r) {over(-60, -1)} END, 6) AS corr, round(CASE WHEN ok THEN regr_slope(r, r0) {over(-60, -1)} END, 6) AS beta FROM g""",
)
def rolling_correlation_beta(spark: SparkSession, sf: str) -> DataFrame:
    df = _context(spark, sf, False)
    return rounded(df.withColumns(asof.rolling_link(df, F.col("r0"), F.col("r"))), 6, "corr", "beta").select("series_id", "session", "corr", "beta")


@query(
    "macro_levels",
    f"""WITH obs AS (SELECT series_id, reference, published, value FROM (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS reference, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS published, l_extendedprice AS value,
        row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_linenumber DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1),
    s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders), latest AS (SELECT series_id, published, max(reference) AS reference FROM obs GROUP BY 1, 2),
    t AS (SELECT * FROM s CROSS JOIN (SELECT DISTINCT series_id FROM obs)), j AS (SELECT t.series_id, t.session, l.reference FROM t ASOF LEFT JOIN latest l ON t.series_id = l.series_id AND t.session >= l.published),
    lv AS (SELECT j.*, o.value AS level, CASE WHEN day(reference - INTERVAL 1 YEAR) = day(reference) THEN CAST(reference - INTERVAL 1 YEAR AS DATE) END AS b FROM j LEFT JOIN obs o USING (series_id, reference))
    SELECT lv.series_id, session, round(level, 6) AS level, round(level - lag(level, 5) OVER (PARTITION BY lv.series_id ORDER BY session), 6) AS level_chg, round(CASE WHEN p.published <= session THEN 100 * (level / nullif(p.value, 0) - 1) END, 6) AS yoy
    FROM lv LEFT JOIN obs p ON p.series_id = lv.series_id AND p.reference = lv.b""",
)
def macro_levels(spark: SparkSession, sf: str) -> DataFrame:
    obs = adapters.observations(spark, sf)
    sessions = adapters.order_bars(spark, sf, anchor=True).select("session")
    return rounded(macro.year_over_year(macro.levels(sessions, obs), obs), 6, "level", "level_chg", "yoy").select("series_id", "session", "level", "level_chg", "yoy")


_REV = """rev AS (SELECT event_type AS source, user_id AS series_id, CAST(ts AS DATE) AS as_of, ts AS fetched_at, CASE WHEN event_id % 5 <> 0 THEN ts END AS published_at,
    row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS version, value FROM events)"""


@query("current_revisions", f"WITH {_REV} SELECT source, series_id, as_of, CAST(version AS INTEGER) AS version, value FROM rev QUALIFY row_number() OVER (PARTITION BY source, series_id, as_of ORDER BY version DESC) = 1")
def current_revisions(spark: SparkSession, sf: str) -> DataFrame:
    return store.current(adapters.revisions(spark, sf)).select("source", "series_id", "as_of", "version", "value")


def _middle(spark: SparkSession, sf: str) -> str:
    return str(adapters.table(spark, sf, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("m")).first()["m"])


@query("point_in_time_read", f"WITH {_REV} SELECT source, series_id, as_of, CAST(version AS INTEGER) AS version, value FROM rev WHERE coalesce(published_at, fetched_at) <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) QUALIFY row_number() OVER (PARTITION BY source, series_id, as_of ORDER BY version DESC) = 1")
def point_in_time_read(spark: SparkSession, sf: str) -> DataFrame:
    return store.known_at(adapters.revisions(spark, sf), _middle(spark, sf)).select("source", "series_id", "as_of", "version", "value")


@query("series_coverage", f"WITH {_REV} SELECT source, count(*) AS n, count(DISTINCT series_id) AS n_series, min(as_of) AS first_as_of, max(as_of) AS last_as_of, max(published_at) AS last_published, CAST(max(version) AS INTEGER) AS max_version FROM rev GROUP BY source")
def series_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.revisions(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"), F.max("published_at").alias("last_published"), F.max("version").alias("max_version")
    )


_FEED = """feed AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS session, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS open, o_totalprice * (1 + (o_orderkey % 7 - 3) / 100) AS close,
    greatest(o_totalprice, o_totalprice * (1 + (o_orderkey % 7 - 3) / 100)) * (1 + (o_orderkey % 5 - 1) / 100) AS high, least(o_totalprice, o_totalprice * (1 + (o_orderkey % 7 - 3) / 100)) * 0.99 AS low, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 13 - 1 END AS volume FROM orders)"""


@query(
    "quality_rejections",
    f"""WITH {_FEED}, c AS (SELECT CASE WHEN count(*) OVER (PARTITION BY series_id, session) > 1 THEN 'duplicate' WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'null_ohlc'
        WHEN high < greatest(open, close) OR low > least(open, close) THEN 'ohlc_incoherent' WHEN volume < 0 THEN 'negative_volume' WHEN volume IS NULL THEN 'null_volume' END AS reject_code FROM feed) SELECT reject_code, count(*) AS n FROM c GROUP BY ALL""",
)
def quality_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rejected(adapters.raw_feed(spark, sf), quality.bar_rules(volume_expected=True)).groupBy("reject_code").agg(F.count("*").alias("n"))


@query(
    "stale_runs",
    f"""WITH {BARS}, v AS (SELECT series_id, session, volume, CASE WHEN volume <> lag(volume) OVER w OR session - lag(session) OVER w > 4 OR lag(session) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM bars {W}),
    g AS (SELECT *, sum(brk) OVER w AS run FROM v {W}) SELECT series_id, min(session) AS run_from, max(session) AS run_to, count(*) AS n FROM g GROUP BY series_id, run HAVING count(*) >= 5""",
)
def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.stale_runs(adapters.order_bars(spark, sf), value="volume")


@query(
    "weekday_gaps",
    f"""WITH {BARS}, d AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(session) AS TIMESTAMP), CAST(max(session) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS session FROM bars GROUP BY series_id)
    SELECT series_id, session FROM d WHERE isodow(session) < 6 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.series_id = d.series_id AND b.session = d.session)""",
)
def weekday_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.weekday_gaps(adapters.order_bars(spark, sf))


@query(
    "compare_sources",
    f"""WITH {BARS}, a AS (SELECT session, close FROM bars WHERE series_id = '1-URGENT'), b AS (SELECT session, close FROM bars WHERE series_id = '2-HIGH')
    SELECT session, a.close AS left_value, b.close AS right_value, round(abs(a.close - b.close) / abs(b.close) * 1e4, 6) AS diff_bp FROM a JOIN b USING (session) WHERE abs(a.close - b.close) / abs(b.close) * 1e4 > 10""",
)
def compare_sources(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda p: adapters.order_bars(spark, sf).where(F.col("series_id") == p)
    return rounded(quality.compared(of("1-URGENT"), of("2-HIGH"), ["session"], "close"), 6, "diff_bp")


@query(
    "stale_open_share",
    f"""WITH {BARS}, s AS (SELECT series_id, year(session) AS year, coalesce(open = lag(close) OVER w, false) AS st FROM bars {W}), y AS (SELECT series_id, year, count(*) AS n, avg(CAST(st AS INTEGER)) AS share FROM s GROUP BY 1, 2)
    SELECT series_id, CAST(year AS INTEGER) AS year, n, share, max(share) OVER (PARTITION BY series_id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst_from_here FROM y""",
)
def stale_open_share(spark: SparkSession, sf: str) -> DataFrame:
    return quality.stale_open_share(adapters.order_bars(spark, sf))


@query(
    "drift_by_weekday",
    f"""WITH {BARS}, r AS (SELECT CAST(isodow(session) AS INTEGER) AS weekday, close / open - 1 AS r FROM bars)
    SELECT weekday, count(r) AS n, round(avg(r) * 1e4, 4) AS mean_bp, round(median(r) * 1e4, 4) AS median_bp, round(avg(CAST(r > 0 AS INTEGER)), 6) AS hit_rate, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 6) AS t_value, round(sum(ln(1 + r)), 4) AS log_total FROM r GROUP BY weekday""",
)
def drift_by_weekday(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.drift_segments(adapters.order_bars(spark, sf), F.weekday("session") + 1, "weekday")
    return rounded(rounded(got, 4, "mean_bp", "median_bp", "log_total"), 6, "hit_rate", "t_value")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    ticks = adapters.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("session"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("high"), F.col("o_totalprice").alias("low"))
    b = adapters.order_bars(spark, sf, anchor=True)
    days = b.select("session", F.col("open").alias("entry"), "high", "low", "close", F.lit(0.3).cast("double").alias("sigma"), F.when(F.col("volume") % 7 == 0, F.col("volume") * 2).otherwise(F.col("volume")).alias("expected"))
    return labels.triple_barrier(days, ticks)


_LABELS = f"""{ANCHOR}, d AS (SELECT session, open AS entry, high, low, close, open * 1.3 AS upper, open * 0.7 AS lower, volume % 7 <> 0 AS fine FROM bars),
    e AS (SELECT *, entry * (1 + 0.3 * 1.0) AS u, entry * (1 - 0.3 * 1.0) AS l FROM d), t AS (SELECT CAST(o_orderdate AS DATE) AS session, o_orderkey AS k, o_totalprice AS p FROM orders),
    f AS (SELECT e.session, arg_min(p, k) AS p FROM e JOIN t ON e.session = t.session AND fine AND (p >= u OR p <= l) GROUP BY e.session),
    h AS (SELECT e.*, CASE WHEN fine THEN f.p >= u ELSE high >= u END AS up, CASE WHEN fine THEN f.p <= l ELSE low <= l END AS dn FROM e LEFT JOIN f USING (session)),
    lab AS (SELECT session, CASE WHEN fine THEN 'intraday' ELSE 'daily' END AS order_source, CASE WHEN dn THEN 'stop' WHEN up THEN 'target' ELSE 'time' END AS label_long, CASE WHEN up THEN 'stop' WHEN dn THEN 'target' ELSE 'time' END AS label_short,
        (CASE WHEN dn THEN l WHEN up THEN u ELSE close END) / entry - 1 AS ret_long, 1 - (CASE WHEN up THEN u WHEN dn THEN l ELSE close END) / entry AS ret_short FROM h)"""


@query("triple_barrier_labels", f"WITH {_LABELS} SELECT session, order_source, label_long, label_short, round(ret_long, 6) AS ret_long, round(ret_short, 6) AS ret_short FROM lab")
def triple_barrier_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_labelled(spark, sf).select("session", "order_source", "label_long", "label_short", "ret_long", "ret_short"), 6, "ret_long", "ret_short")


@query(
    "label_summary",
    f"""WITH {_LABELS}, s AS (SELECT count(*) AS n, count_if(label_long = 'target') AS n_target, count_if(label_long = 'stop') AS n_stop, count_if(label_long = 'time') AS n_time, avg(CAST(ret_long > 0 AS INTEGER)) AS p_win,
        avg(CASE WHEN ret_long > 0 THEN ret_long END) AS e_gain, avg(CASE WHEN ret_long <= 0 THEN -ret_long END) AS e_loss, avg(ret_long) AS ev FROM lab)
    SELECT n, n_target, n_stop, n_time, round(n_target / n, 6) AS p_target, round(n_stop / n, 6) AS p_stop, round(n_time / n, 6) AS p_time, round(p_win, 6) AS p_win, round(e_gain, 6) AS e_gain, round(e_loss, 6) AS e_loss, round(ev, 6) AS ev,
        round(p_win * e_gain - (1 - p_win) * e_loss, 6) AS ev_identity, round(ev - 0.000042, 6) AS ev_net FROM s""",
)
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.label_summary(_labelled(spark, sf), "label_long", "ret_long"), 6, "p_target", "p_stop", "p_time", "p_win", "e_gain", "e_loss", "ev", "ev_identity", "ev_net")


@query(
    "walk_forward_splits",
    f"""WITH {ANCHOR}, p AS (SELECT row_number() OVER (ORDER BY session) - 1 AS position, session FROM bars), n AS (SELECT count(*) AS n FROM p), f AS (SELECT unnest(range(0, 5)) AS fold),
    g AS (SELECT CAST(fold AS INTEGER) AS fold, position, session, n - 500 AS first, n - 500 + fold * 100 AS t0 FROM p CROSS JOIN n CROSS JOIN f)
    SELECT fold, CAST(position AS BIGINT) AS position, session, CASE WHEN position >= t0 AND position < t0 + 100 THEN 'test' ELSE 'train' END AS role FROM g
    WHERE (position >= t0 AND position < t0 + 100) OR (position + 2 < t0 AND NOT (position >= first + 100 AND (position - first) % 100 < 3))""",
)
def walk_forward_splits(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.order_bars(spark, sf, anchor=True)
    position = (F.row_number().over(Window.partitionBy("series_id").orderBy("session")) - 1).cast("long")
    return labels.walk_forward(s.select(position.alias("position"), "session"), n_splits=5, test_size=100, horizon=2, embargo=3)


@query(
    "cost_breakdown",
    """WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS notional, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, CAST(o_orderkey % 3 AS INTEGER) AS nights FROM orders),
    c AS (SELECT *, CASE WHEN side < 0 THEN CAST(-0.0018 AS DECIMAL(10, 8)) ELSE CAST(0.0182 AS DECIMAL(10, 8)) END * nights AS carry FROM t), d AS (SELECT *, CAST(0.0042 AS DECIMAL(12, 8)) + CAST(carry AS DECIMAL(12, 8)) AS declared FROM c)
    SELECT o_orderkey, CAST(CAST(carry AS DECIMAL(20, 10)) AS VARCHAR) AS carry_pct, CAST(CAST(declared AS DECIMAL(20, 10)) AS VARCHAR) AS declared_pct, CAST(CAST(declared + CAST(0.2 AS DECIMAL(12, 8)) AS DECIMAL(20, 10)) AS VARCHAR) AS total_pct,
        CAST(CAST(CAST(notional AS DECIMAL(20, 2)) * declared * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(28, 10)) AS VARCHAR) AS declared_usd, true AS slippage_dominates FROM d""",
)
def cost_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    trades = adapters.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("notional"), F.when(k % 2 == 0, 1).otherwise(-1).alias("side"), (k % 3).cast("int").alias("nights"))
    got = costs.charged(trades, slippage=Decimal("0.2"))
    return got.select("o_orderkey", *[F.col(c).cast("string").alias(c) for c in ("carry_pct", "declared_pct", "total_pct", "declared_usd")], "slippage_dominates")


_SIM = f"""{BARS}, bi AS (SELECT *, open / lag(close) OVER w - 1 AS gap, coalesce(sign(lag(close, 1) OVER w / lag(close, 6) OVER w - 1), 0) AS mom FROM bars {W}),
    sim AS (SELECT series_id, session, CAST(mom AS INTEGER) AS momentum_5d, CAST(coalesce(-sign(gap), 0) AS INTEGER) AS gap_reversal, CASE WHEN mom = 0 THEN 0.0 ELSE (close / open - 1) * mom - 0.0005 END AS net FROM bi)"""


def _simulated(spark: SparkSession, sf: str) -> DataFrame:
    return labels.simulated(labels.bias(adapters.order_bars(spark, sf)), "momentum_5d")


@query("baseline_simulation", f"WITH {_SIM} SELECT series_id, session, momentum_5d, gap_reversal, CASE WHEN momentum_5d = 0 THEN 'no_trade' ELSE 'traded' END AS status, round(net, 6) AS net FROM sim")
def baseline_simulation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_simulated(spark, sf), 6, "net").select("series_id", "session", "momentum_5d", "gap_reversal", "status", "net")


@query(
    "performance_metrics",
    f"""WITH {_SIM}, m AS (SELECT *, avg(net) OVER (PARTITION BY series_id) AS mu FROM sim)
    SELECT series_id, count(*) AS n, round(avg(net), 6) AS mean_ret, round(CASE WHEN max(net) = min(net) THEN 0 ELSE avg(net) / stddev_samp(net) * sqrt(252) END, 6) AS sharpe, round(avg(net) / nullif(sqrt(avg(pow(least(net, 0.0), 2))), 0) * sqrt(252), 6) AS sortino,
        round(sum(CASE WHEN net > 0 THEN net END) / nullif(-sum(CASE WHEN net < 0 THEN net END), 0), 6) AS profit_factor, round(avg(CAST(net > 0 AS INTEGER)), 6) AS hit_rate,
        round(avg(pow(net - mu, 3)) / pow(avg(pow(net - mu, 2)), 1.5), 4) AS skew, round(avg(pow(net - mu, 4)) / pow(avg(pow(net - mu, 2)), 2), 4) AS kurt FROM m GROUP BY series_id""",
)
def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.performance(_simulated(spark, sf))
    return rounded(rounded(got, 6, "mean_ret", "sharpe", "sortino", "profit_factor", "hit_rate"), 4, "skew", "kurt")


@query(
    "equity_drawdown",
    f"""WITH {BARS}, s AS (SELECT series_id, session, ln(1 + (close / open - 1) / 1000) AS lr FROM bars), e AS (SELECT *, round(exp(sum(lr) OVER w), 9) AS eq, row_number() OVER w AS i FROM s {W}), p AS (SELECT *, greatest(1.0, max(eq) OVER w) AS peak FROM e {W})
    SELECT series_id, session, round(eq, 6) AS equity, round(eq / peak - 1, 6) AS drawdown, CAST(i - coalesce(max(CASE WHEN eq >= peak THEN i END) OVER w, 0) AS INTEGER) AS under FROM p {W}""",
)
def equity_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    r = adapters.order_bars(spark, sf).select("series_id", "session", ((F.col("close") / F.col("open") - 1) / 1000).alias("net"))
    return rounded(metrics.drawdowns(r), 6, "equity", "drawdown")


_PY = "f AS (SELECT doc_id, (n_chars % 100) / 100.0 + 0.005 AS p, quality AS y FROM documents JOIN labels USING (doc_id))"


@query("calibration_curve", f"WITH {_PY}, g AS (SELECT CAST(least(9, floor(CAST(p AS DOUBLE) * 10)) AS INTEGER) AS bin, count(*) AS n, avg(CAST(p AS DOUBLE)) AS mp, avg(y) AS my FROM f GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM (SELECT unnest(range(10)) AS b) LEFT JOIN g ON b = bin")
def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration(adapters.forecasts(spark, sf)), 6, "mean_p", "mean_y")


@query("probability_scores", f"WITH {_PY} SELECT count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM f")
def probability_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.probability_scores(adapters.forecasts(spark, sf)), 6, "brier", "log_loss")


@query(
    "variance_losses",
    f"""WITH {BARS}, {_VOL}, f AS (SELECT series_id, {full('avg', 'rv', -5, -1)} AS f, rv AS y FROM vol)
    SELECT series_id, count(*) AS n, round(avg(ln(f) + y / f), 6) AS qlike, round(avg(pow(ln(f) - ln(y), 2)), 6) AS mse_log FROM f WHERE f > 0 AND y > 0 GROUP BY series_id""",
)
def variance_losses(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.frames import full as whole

    df = features.volatility(adapters.order_bars(spark, sf))
    df = df.withColumn("f", whole(F.avg("parkinson_rv"), F.col("parkinson_rv"), -5, -1))
    return rounded(metrics.variance_losses(df, F.col("f"), F.col("parkinson_rv")), 6, "qlike", "mse_log")


@query(
    "rank_correlation",
    f"""WITH {BARS}, r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY volume) + (count(*) OVER (PARTITION BY series_id, volume) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY series_id ORDER BY close) + (count(*) OVER (PARTITION BY series_id, close) - 1) / 2.0 AS ry FROM bars)
    SELECT series_id, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY series_id""",
)
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.rank_correlation(adapters.order_bars(spark, sf), "volume", "close", "series_id"), 6, "spearman")


@query(
    "window_pnl",
    f"""WITH {BARS}, t AS (SELECT series_id, session, close - open AS pnl FROM bars), x AS (SELECT *, coalesce(sum(pnl) OVER (PARTITION BY series_id, date_trunc('week', session) ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS week_pnl,
        coalesce(sum(pnl) OVER (PARTITION BY series_id, date_trunc('month', session) ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS month_pnl FROM t)
    SELECT series_id, session, round(pnl, 4) AS pnl, CAST(0 AS DOUBLE) AS day_pnl, round(week_pnl, 4) AS week_pnl, round(month_pnl, 4) AS month_pnl, week_pnl <= -100000 AS week_stop, month_pnl <= -200000 AS month_stop FROM x""",
)
def window_pnl(spark: SparkSession, sf: str) -> DataFrame:
    t = adapters.order_bars(spark, sf).select("series_id", "session", (F.col("close") - F.col("open")).alias("pnl"))
    return rounded(labels.window_pnl(t, {"week": 100_000.0, "month": 200_000.0}), 4, "pnl", "week_pnl", "month_pnl")


@query(
    "event_bars",
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""",
)
def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_bars(adapters.table(spark, sf, "events"))


@query("har_forecasts")
def har_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.har_forecasts(features.volatility(adapters.order_bars(spark, sf))), 8, "har_forecast")


@query("bootstrap_intervals")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.bootstrap(_simulated(spark, sf)), 8, "lo", "hi")


from tidemark.plans import decisions, feeds, market, research, stateful, versions  # noqa: E402, F401  they register their queries
