"""Queries of splits, metrics, overfitting statistics and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import full as whole
from tidemark.functions.frames import lag, rounded
from tidemark.operators import engine, features, labels, metrics, models, overfitting, splits, volatility_study
from tidemark.plans.registry import ANCHOR, BARS, full, over, query
from tidemark.sources import adapters

_CPCV = f"""{ANCHOR}, p AS (SELECT row_number() OVER (ORDER BY session) - 1 AS i, session FROM bars), n AS (SELECT count(*) AS n FROM p), e AS (SELECT b, b * (n // 6) + least(b, n % 6) AS s, (b + 1) * (n // 6) + least(b + 1, n % 6) AS t FROM n, (SELECT unnest(range(6)) AS b)),
    f AS (SELECT row_number() OVER (ORDER BY x.b, y.b) - 1 AS fold, x.s AS s1, x.t AS t1, y.s AS s2, y.t AS t2 FROM e x JOIN e y ON x.b < y.b),
    plan AS (SELECT CAST(fold AS INTEGER) AS fold, CAST(i AS BIGINT) AS position, session, CASE WHEN (i >= s1 AND i < t1) OR (i >= s2 AND i < t2) THEN 'test' WHEN (s1 >= i AND s1 <= i + i % 3) OR (s2 >= i AND s2 <= i + i % 3) THEN 'purged' WHEN (i >= t1 AND i < t1 + 3) OR (i >= t2 AND i < t2 + 3) THEN 'embargoed' ELSE 'train' END AS role FROM p CROSS JOIN f)"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return splits.combinatorial(adapters.positions(adapters.order_bars(spark, sf, anchor=True)), blocks=6, test_blocks=2, embargo=3)


@query("combinatorial_splits", f"WITH {_CPCV} SELECT * FROM plan")
def combinatorial_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).drop("horizon")


@query("split_faults", f"WITH {_CPCV} SELECT fold, position, 'label reaches test' AS fault FROM plan WHERE role = 'purged'")
def split_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What the invariants say of the plan if purged rows trained after all: exactly those rows."""
    return splits.broken(_plan(spark, sf).withColumn("role", F.when(F.col("role") == "purged", "train").otherwise(F.col("role"))))


@query("held_back", f"WITH {ANCHOR}, n AS (SELECT min(session) AS a FROM (SELECT session FROM bars ORDER BY session DESC LIMIT 250)) SELECT session >= a AS held_out, count(*) AS n FROM bars, n GROUP BY ALL")
def held_back(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.order_bars(spark, sf, anchor=True).select("session")
    first, last = s.orderBy(F.desc("session")).limit(250).agg(F.min("session").cast("string"), F.max("session").cast("string")).first()
    return splits.reserved(s, first, last, 250).groupBy("held_out").agg(F.count("*").alias("n"))


@query(
    "calibration_split",
    f"""WITH {_CPCV}, t AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY position) AS k, count(*) OVER (PARTITION BY fold) AS m FROM plan WHERE role = 'train'), u AS (SELECT *, k > m - floor(m * 0.2) AS tail FROM t), v AS (SELECT *, min(CASE WHEN tail THEN position END) OVER (PARTITION BY fold) AS start FROM u)
    SELECT fold, CASE WHEN tail THEN 'calibration' WHEN position + position % 3 >= start THEN 'purged' ELSE 'fit' END AS part, count(*) AS n FROM v GROUP BY ALL""",
)
def calibration_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.for_calibration(_plan(spark, sf).where("role = 'train'")).groupBy("fold", "part").agg(F.count("*").alias("n"))


_NET = f"""{BARS}, bi AS (SELECT series_id, session, close, open, coalesce(sign(lag(close, 1) OVER w / lag(close, 6) OVER w - 1), 0) AS mom FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY session)), sim AS (SELECT series_id, session, CASE WHEN mom = 0 THEN 0.0 ELSE ((close / open - 1) * mom - 0.0005) / 10000 END AS net, (close / open - 1) / 10000 AS held, mom <> 0 AS traded FROM bi)"""


def _net(spark: SparkSession, sf: str) -> DataFrame:
    s = labels.simulated(labels.bias(adapters.order_bars(spark, sf)), "momentum_5d")
    return s.select("series_id", "session", (F.col("net") / 10_000).alias("net"), ((F.col("close") / F.col("open") - 1) / 10_000).alias("held"), (F.col("momentum_5d") != 0).alias("traded"))


@query(
    "benchmark_alpha_beta",
    f"""WITH {_NET} SELECT series_id, count(*) AS n, round(regr_slope(net, held), 6) AS beta, round((avg(net) - regr_slope(net, held) * avg(held)) * 100, 6) AS alpha_pct, round((avg(net) - avg(held)) * 100, 6) AS mean_excess_pct, round((exp(sum(ln(1 + held))) - 1) * 100, 4) AS benchmark_return_pct,
        round(avg(held) / stddev_samp(held) * sqrt(252), 6) AS benchmark_sharpe FROM sim GROUP BY series_id""",
)
def benchmark_alpha_beta(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.against_benchmark(_net(spark, sf), "net", "held")
    return rounded(rounded(got, 6, "beta", "alpha_pct", "mean_excess_pct", "benchmark_sharpe"), 4, "benchmark_return_pct")


@query(
    "trade_statistics",
    f"""WITH {_NET}, t AS (SELECT series_id, count(*) AS n_sessions, count_if(traded) AS n_trades, count_if(NOT traded) AS n_no_trade, avg(net) FILTER (traded) * 100 AS ev_per_trade_pct, avg(net) FILTER (traded AND net > 0) AS w, avg(net) FILTER (traded AND net < 0) AS l, max(session) - min(session) AS span, (exp(sum(ln(1 + net))) - 1) * 100 AS total FROM sim GROUP BY series_id)
    SELECT series_id, n_sessions, n_trades, n_no_trade, round(total, 4) AS total_return_pct, round(ev_per_trade_pct, 6) AS ev_per_trade_pct, round(w * 100, 6) AS average_win_pct, round(l * 100, 6) AS average_loss_pct, round(w / abs(l), 6) AS payoff_ratio, CAST(span AS INTEGER) AS session_span_days, round(CASE WHEN span >= 30 THEN n_trades * 365.25 / span END, 4) AS trades_per_year FROM t""",
)
def trade_statistics(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.trade_statistics(_net(spark, sf))
    return rounded(rounded(got, 4, "total_return_pct", "trades_per_year"), 6, "ev_per_trade_pct", "average_win_pct", "average_loss_pct", "payoff_ratio")


@query("qlike_by_session", f"""WITH {BARS}, v AS (SELECT series_id, session, pow(ln(high / low), 2) / (4 * ln(2)) AS rv FROM bars), f AS (SELECT *, {full('avg', 'rv', -5, -1)} AS f, lag(rv) {over('u', 0)} AS g FROM v)
    SELECT series_id, session, round(ln(f) + rv / f, 6) AS qlike, round((ln(g) + rv / g) - (ln(f) + rv / f), 6) AS differential FROM f WHERE f > 0 AND g > 0 AND rv > 0""")
def qlike_by_session(spark: SparkSession, sf: str) -> DataFrame:
    df = features.volatility(adapters.order_bars(spark, sf))
    rv = F.col("parkinson_rv")
    df = df.withColumns({"f": whole(F.avg(rv), rv, -5, -1), "g": lag("parkinson_rv")}).where("f > 0 and g > 0 and parkinson_rv > 0")
    loss = lambda c: F.log(c) + rv / F.col(c)
    return rounded(df.select("series_id", "session", loss("f").alias("qlike"), (loss("g") - loss("f")).alias("differential")), 6, "qlike", "differential")


_VARIANTS = f"""{ANCHOR}, p AS (SELECT row_number() OVER (ORDER BY session) - 1 AS i, close / open - 1 AS r FROM bars), n AS (SELECT count(*) // 8 * 8 AS n FROM p), m AS (SELECT i, v, r / 100 * CASE WHEN (i + v) % (v + 2) = 0 THEN -1 ELSE 1 END AS r FROM p, n, (SELECT unnest(range(6)) AS v) WHERE i < n.n)"""


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.positions(adapters.order_bars(spark, sf, anchor=True)).join(adapters.order_bars(spark, sf, anchor=True).select("session", (F.col("close") / F.col("open") - 1).alias("r0")), "session")
    n = p.count() // 8 * 8
    v = F.col("variant")
    rows = p.where(F.col("position") < n).withColumn("variant", F.explode(F.array(*map(F.lit, range(6)))))
    return rows.select("position", "variant", (F.col("r0") / 100 * F.when((F.col("position") + v) % (v + 2) == 0, -1).otherwise(1)).alias("r"))


@query("variant_sharpes", f"WITH {_VARIANTS} SELECT CAST(v AS INTEGER) AS variant, count(*) AS n, round(avg(r) / stddev_samp(r), 8) AS sharpe FROM m GROUP BY v")
def variant_sharpes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(overfitting.variant_sharpes(_variants(spark, sf)), 8, "sharpe")


@query("deflated_sharpe")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return overfitting.deflated_sharpe(_variants(spark, sf))


@query(
    "overfitting_probability",
    f"""WITH {_VARIANTS}, b AS (SELECT v, CAST(i // (n.n // 8) AS INTEGER) AS b, r FROM m, n), k AS (SELECT CAST(x AS INTEGER) AS x FROM (SELECT unnest(range(256)) AS x) WHERE bit_count(CAST(x AS INTEGER)) = 4),
    s AS (SELECT x, v, (x >> b) & 1 AS side, avg(r) / stddev_samp(r) AS sr FROM b, k GROUP BY 1, 2, 3), w AS (SELECT x, v, max(sr) FILTER (side = 1) AS a, max(sr) FILTER (side = 0) AS o FROM s GROUP BY 1, 2), g AS (SELECT *, rank() OVER (PARTITION BY x ORDER BY o) / 7.0 AS om, row_number() OVER (PARTITION BY x ORDER BY a DESC, v) AS best FROM w)
    SELECT count(*) AS n_choices, round(avg(CAST(ln(om / (1 - om)) <= 0 AS INTEGER)), 6) AS pbo, round(median(om), 6) AS omega_median, round(median(ln(om / (1 - om))), 6) AS logit_median, round(median(o), 6) AS best_oos_median, avg(CAST(ln(om / (1 - om)) <= 0 AS INTEGER)) >= 0.5 AS detected FROM g WHERE best = 1""",
)
def overfitting_probability(spark: SparkSession, sf: str) -> DataFrame:
    got = overfitting.overfitting_probability(overfitting.overfitting_splits(_variants(spark, sf), blocks=8))
    return rounded(got, 6, "pbo", "omega_median", "logit_median", "best_oos_median")


@query(
    "dominance_grid",
    f"""WITH {_NET}, d AS (SELECT series_id, net - held AS d FROM sim), g AS (SELECT series_id, l AS level, count(*) AS n, avg(d - l) AS mean, avg(d - l) / (stddev_samp(d - l) / sqrt(count(*))) AS t FROM d, (SELECT unnest([0.0, 0.00001, 0.00002]) AS l) GROUP BY 1, 2)
    SELECT series_id, CAST(level AS DOUBLE) AS level, n, round(mean, 8) AS mean, round(t, 6) AS t_value, true AS monotone FROM g""",
)
def dominance_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = _net(spark, sf).select("series_id", (F.col("net") - F.col("held")).alias("d"))
    return rounded(rounded(overfitting.dominance(d, [0.0, 0.00001, 0.00002]), 8, "mean"), 6, "t_value")


@query("paired_verdicts", f"""WITH {_NET}, g AS (SELECT series_id, count(*) AS n, avg(net - held) AS m, stddev_samp(net - held) / sqrt(count(*)) AS se FROM sim GROUP BY series_id) SELECT series_id, n, round(m, 8) AS mean_d, round(se, 8) AS se_d, CASE WHEN m > se THEN 'improves' WHEN m < -se THEN 'worsens' ELSE 'no_difference' END AS verdict FROM g""")
def paired_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(overfitting.paired_verdict(_net(spark, sf), "series_id", "held", "net"), 8, "mean_d", "se_d")


@query("redundant_feature", f"""WITH {BARS}, c AS (SELECT corr(close, open) AS a, corr(close, high) AS b, corr(close, low) AS d, corr(close, volume) AS e FROM bars), u AS (UNPIVOT (SELECT a AS open, b AS high, d AS low, e AS volume FROM c) ON open, high, low, volume INTO NAME feature VALUE r) SELECT feature, round(r, 6) AS r FROM u ORDER BY abs(r) DESC LIMIT 1""")
def redundant_feature(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(overfitting.redundant_feature(adapters.order_bars(spark, sf), "close", ["open", "high", "low", "volume"]), 6, "r")


@query("sharpe_intervals")
def sharpe_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(overfitting.intervals(_net(spark, sf), "sharpe"), 8, "lo", "hi")


_LOSSES = f"""{BARS}, v AS (SELECT series_id, session, pow(ln(high / low), 2) / (4 * ln(2)) AS rv FROM bars), f AS (SELECT *, lag(rv) {over('u', 0)} AS rw, {full('avg', 'rv', -5, -1)} AS week, {full('avg', 'rv', -22, -1)} AS month FROM v), u AS (SELECT series_id, rv AS y, unnest(['rw', 'week', 'month']) AS candidate, unnest([rw, week, month]) AS f FROM f WHERE rv > 0 AND rw > 0 AND week > 0 AND month > 0),
    l AS (SELECT series_id, candidate, count(*) AS n, avg(ln(f) + y / f) AS qlike, avg(pow(ln(f) - ln(y), 2)) AS mse_log FROM u GROUP BY 1, 2)"""


@query(
    "volatility_selection",
    f"""WITH {_LOSSES}, b AS (SELECT series_id, min(qlike) AS best, max(CASE WHEN candidate = 'rw' THEN qlike END) AS ref FROM l GROUP BY series_id), g AS (SELECT l.*, (qlike - best) / abs(best) AS gb, (qlike - ref) / abs(ref) AS gr FROM l JOIN b USING (series_id)), p AS (SELECT series_id, arg_min(candidate, qlike) AS pick FROM g WHERE gb <= 0.02 AND gr < -0.02 GROUP BY series_id)
    SELECT g.series_id, candidate, n, round(qlike, 6) AS qlike, round(mse_log, 6) AS mse_log, round(gb, 6) AS gap_best, round(gr, 6) AS gap_reference, coalesce(candidate = pick, false) AS chosen FROM g LEFT JOIN p ON g.series_id = p.series_id""",
)
def volatility_selection(spark: SparkSession, sf: str) -> DataFrame:
    df = features.volatility(adapters.order_bars(spark, sf))
    rv = F.col("parkinson_rv")
    df = df.withColumns({"rw": lag("parkinson_rv"), "week": whole(F.avg(rv), rv, -5, -1), "month": whole(F.avg(rv), rv, -22, -1)})
    return rounded(models.selected(models.forecast_losses(df, "parkinson_rv", ["rw", "week", "month"], "series_id"), "series_id"), 6, "qlike", "mse_log", "gap_best", "gap_reference")


@query("volatility_walk_forward")
def volatility_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates refit on common folds, their losses on both targets and the choice: a row a series (each priority, and all orders) and candidate."""
    bars = adapters.order_bars(spark, sf).unionByName(adapters.order_bars(spark, sf, anchor=True))
    level = features.level_scores(bars).select("series_id", "session", "level", "level_zscore", "level_percentile")
    rows = volatility_study.sample(bars).where("excluded is null").join(level, ["series_id", "session"], "left")
    got = volatility_study.selection(volatility_study.losses(volatility_study.walk_forward(rows)))
    return rounded(got, 6, *(f"{c}_{k}" for c in ("qlike", "gap_best", "gap_rw") for k in (1, 2)))


def _design(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    bars = adapters.order_bars(spark, sf, anchor=True)
    t = features.technical(bars)
    columns = ["ret_1", "ret_5", "dist_sma_20", "range_pos_20"]
    x = t.select("session", *(lag(c).alias(c) for c in columns), (F.col("close") > F.col("open")).cast("int").alias("y"))
    plan = labels.walk_forward(adapters.positions(bars), n_splits=4, test_size=100, horizon=1)
    return plan.join(x, "session"), columns


@query("model_probabilities")
def model_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-sample probabilities: a model a fold, calibrated on the tail of its train."""
    rows, columns = _design(spark, sf)
    train = splits.for_calibration(rows.where("role = 'train'").withColumn("horizon", F.lit(1)))
    model = models.fitted(train.where("part = 'fit'"), columns)
    held = models.scored(train.where("part = 'calibration'"), model, columns)
    got = models.calibrated(models.scored(rows.where("role = 'test'"), model, columns), models.calibrators(held))
    return rounded(got.select("fold", "session", "y", "p", "p_calibrated"), 8, "p", "p_calibrated")


@query("random_run")
def random_run(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded control, simulated: its result by year."""
    from fractions import Fraction

    bars = adapters.order_bars(spark, sf, anchor=True)
    drawn = engine.random_control(adapters.positions(bars), Fraction(1, 4), seed=7).select("session", "side")
    rows = bars.join(drawn, "session").withColumns({"stop_px": F.lit(None).cast("double"), "target_px": F.lit(None).cast("double"), "notional": F.lit(10_000).cast("decimal(18,2)")})
    got = engine.outcomes(rows, engine.day_path(bars).limit(0))
    return rounded(got.groupBy(F.year("session").alias("year")).agg(F.count_if(F.col("status") == "traded").alias("n_trades"), F.sum("pnl_declared").alias("pnl")), 6, "pnl")

