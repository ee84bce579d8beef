"""Queries of simulation, costs over nights, the decision gate, overlays, tickets and the journal."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import costs, engine, gate, journal, labels
from tidemark.plans.registry import ANCHOR, BARS, W, query
from tidemark.sources import adapters

# Anchor sessions with a side by momentum, barriers of a fifth around the open, and the priorities' bars as the path of a day.
_DECIDED = f"""{ANCHOR.replace('bars AS', 'anchor AS')}, {BARS}, path AS (SELECT session, CAST(substr(series_id, 1, 1) AS INTEGER) - 1 AS k, high, low FROM bars), x AS (SELECT *, lag(close, 1) OVER o AS c1, lag(close, 6) OVER o AS c6 FROM anchor WINDOW o AS (ORDER BY session)),
    dec AS (SELECT series_id, session, open, close, CAST(coalesce(sign(c1 / c6 - 1), 0) AS INTEGER) AS side, CASE WHEN session >= DATE '1996-01-01' THEN open * (1 - 0.2 * coalesce(sign(c1 / c6 - 1), 0)) END AS stop_px, CASE WHEN session >= DATE '1996-01-01' THEN open * (1 + 0.2 * coalesce(sign(c1 / c6 - 1), 0)) END AS target_px FROM x),
    hits AS (SELECT d.session, min_by(CASE WHEN p.low <= stop_px AND stop_px <= p.high THEN 'stop' ELSE 'target' END, k) AS what, min(k) AS k FROM dec d JOIN path p ON p.session = d.session WHERE side <> 0 AND ((p.low <= stop_px AND stop_px <= p.high) OR (p.low <= target_px AND target_px <= p.high)) GROUP BY d.session),
    got AS (SELECT d.*, CASE WHEN side = 0 THEN 'no_trade' ELSE 'traded' END AS status, CASE WHEN side <> 0 THEN coalesce(h.what, 'session_close') END AS exit_reason, CASE WHEN side <> 0 THEN CASE h.what WHEN 'stop' THEN stop_px WHEN 'target' THEN target_px ELSE close END END AS exit_px, h.k AS exit_bar FROM dec d LEFT JOIN hits h USING (session)),
    res AS (SELECT *, (exit_px / open - 1) * side AS gross FROM got)"""


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    b = labels.bias(adapters.order_bars(spark, sf, anchor=True)).withColumn("side", F.col("momentum_5d"))
    late = F.col("session") >= F.lit("1996-01-01").cast("date")
    level = lambda sign: F.when(late, F.col("open") * (1 + 0.2 * sign * F.col("side")))
    return b.select("series_id", "session", "open", "close", "side", level(-1).alias("stop_px"), level(1).alias("target_px"), F.lit(10_000).cast("decimal(18,2)").alias("notional"))


def _path(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.order_bars(spark, sf).select(F.lit("anchor").alias("series_id"), "session", (F.substring("series_id", 1, 1).cast("long") - 1).alias("k"), "high", "low")


@query("session_exits", f"WITH {_DECIDED} SELECT session, side, status, exit_reason, CAST(exit_bar AS BIGINT) AS exit_bar, round(exit_px, 4) AS exit_px, round(gross, 6) AS gross, round(gross - 0.000042, 6) AS pnl_declared, round(gross - 0.002042, 6) AS pnl_net FROM res")
def session_exits(spark: SparkSession, sf: str) -> DataFrame:
    from decimal import Decimal

    got = engine.outcomes(_decided(spark, sf), _path(spark, sf), slippage=Decimal("0.2"))
    return rounded(rounded(got, 4, "exit_px"), 6, "gross", "pnl_declared", "pnl_net").select("session", "side", "status", "exit_reason", "exit_bar", "exit_px", "gross", "pnl_declared", "pnl_net")


@query("exit_counts", f"WITH {_DECIDED} SELECT exit_reason, count(*) AS n, round(avg(gross - 0.000042), 6) AS mean_pnl, round(median(gross - 0.000042), 6) AS median_pnl, round(sum(gross - 0.000042), 4) AS sum_pnl FROM res WHERE status = 'traded' GROUP BY exit_reason")
def exit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(engine.exit_counts(engine.outcomes(_decided(spark, sf), _path(spark, sf))), 6, "mean_pnl", "median_pnl"), 4, "sum_pnl")


@query("run_conservation", f"WITH {_DECIDED} SELECT CAST(year(session) AS INTEGER) AS year, count(*) AS n_sessions, count_if(status = 'traded') AS n_traded, count_if(status = 'no_trade') AS n_no_trade, count_if(status = 'skipped') AS n_skipped, true AS sound FROM res GROUP BY 1")
def run_conservation(spark: SparkSession, sf: str) -> DataFrame:
    got = engine.outcomes(_decided(spark, sf), _path(spark, sf)).withColumn("year", F.year("session"))
    return engine.conserved(got, "year")


@query(
    "walk_forward_run",
    f"""WITH {_DECIDED}, p AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM res), t AS (SELECT *, (i - (n - 500)) // 100 AS fold FROM p WHERE i >= n - 500)
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_sessions, count_if(status = 'traded') AS n_trades, round(sum(CASE WHEN status = 'traded' THEN gross - 0.000042 END), 4) AS pnl_declared FROM t GROUP BY fold""",
)
def walk_forward_run(spark: SparkSession, sf: str) -> DataFrame:
    plan = labels.walk_forward(adapters.positions(adapters.order_bars(spark, sf, anchor=True)), n_splits=5, test_size=100)
    got = engine.run(plan, _decided(spark, sf), _path(spark, sf)).groupBy("fold")
    return rounded(got.agg(F.count("*").alias("n_sessions"), F.count_if(F.col("status") == "traded").alias("n_trades"), F.sum("pnl_declared").alias("pnl_declared")), 4, "pnl_declared")


@query(
    "baseline_runs",
    f"""WITH {ANCHOR}, b AS (SELECT session, open, close, CAST(coalesce(sign(lag(close, 1) OVER o / lag(close, 6) OVER o - 1), 0) AS INTEGER) AS mom, CAST(coalesce(-sign(open / lag(close) OVER o - 1), 0) AS INTEGER) AS gap FROM bars WINDOW o AS (ORDER BY session)),
    u AS (SELECT session, open, close, unnest(['no_trade', 'always_long', 'always_short', 'momentum_5d', 'gap_reversal']) AS baseline, unnest([0, 1, -1, mom, gap]) AS side FROM b)
    SELECT baseline, count(*) AS n, count_if(side <> 0) AS n_trades, round(coalesce(sum(CASE WHEN side <> 0 THEN (close / open - 1) * side - 0.000042 END), 0), 4) AS pnl FROM u GROUP BY baseline""",
)
def baseline_runs(spark: SparkSession, sf: str) -> DataFrame:
    bars = adapters.order_bars(spark, sf, anchor=True)
    rows = engine.baselines(labels.bias(bars)).withColumns({"stop_px": F.lit(None).cast("double"), "target_px": F.lit(None).cast("double"), "notional": F.lit(10_000).cast("decimal(18,2)")})
    got = engine.outcomes(rows, engine.day_path(bars).limit(0))
    return rounded(got.groupBy("baseline").agg(F.count("*").alias("n"), F.count_if(F.col("side") != 0).alias("n_trades"), F.coalesce(F.sum("pnl_declared"), F.lit(0.0)).alias("pnl")), 4, "pnl")


@query("random_control")
def random_control(spark: SparkSession, sf: str) -> DataFrame:
    return engine.random_control(adapters.positions(adapters.order_bars(spark, sf, anchor=True)), Fraction(1, 3), seed=42).select("position", "session", "side")


@query(
    "close_to_close",
    f"""WITH {BARS}, x AS (SELECT series_id, session, 100 * (close / lag(close) OVER w - 1) AS g FROM bars {W}) SELECT series_id, session, CAST(g IS NOT NULL AS INTEGER) AS nights, round(g, 6) AS gross_pct, CASE WHEN g IS NOT NULL THEN CAST(0.0182 AS DOUBLE) END AS financing_pct, round(g - 0.0182, 6) AS net_pct FROM x""",
)
def close_to_close(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(costs.close_to_close(adapters.order_bars(spark, sf)), 6, "gross_pct", "net_pct")


_GATE = """g AS (SELECT o_orderkey AS k, o_orderkey % 23 <> 0 AS is_session, o_orderkey % 29 = 0 AS is_half_day, o_orderkey % 31 = 0 AS is_meeting, o_orderkey % 41 <> 0 AS fresh, o_orderkey % 43 <> 0 AS snapshot_ok, o_orderkey % 47 = 0 AS veto, o_orderkey % 53 = 0 AS traded, o_orderkey % 59 = 0 AS observing,
    (o_orderkey % 100) / 100.0 + 0.005 AS p, (o_orderkey % 37) / 10.0 AS move, CASE WHEN o_orderkey % 3 <> 0 THEN 0.2042 END AS total, o_orderkey % 3 = 1 AS measured, 1 + (o_orderkey % 5) * 0.25 AS stop, CASE WHEN o_orderkey % 61 <> 0 THEN (o_orderkey % 7) * 0.5 END AS target, -(o_orderkey % 67) / 10.0 AS weekly, CASE WHEN o_orderkey % 2 = 0 THEN -(o_orderkey % 71) / 5.0 END AS monthly FROM orders),
    e AS (SELECT *, CAST(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS DOUBLE) AS fav FROM g), v AS (SELECT *, CASE WHEN measured THEN fav * move - total WHEN total IS NOT NULL THEN fav * move - 0.0042 END AS ev FROM e), t AS (SELECT *, CASE WHEN ev > 3 * 0.0042 AND fav > {minimum} THEN 'A' WHEN ev > 1.5 * 0.0042 THEN 'B' ELSE 'C' END AS tier FROM v),
    s AS (SELECT *, list_filter([CASE WHEN traded THEN '1:max_una_operacion_por_sesion' END, CASE WHEN weekly <= -5 THEN '4:perdida_semanal' END, CASE WHEN monthly <= -10 THEN '5:perdida_mensual' END, CASE WHEN observing THEN '15:modo_observacion' END, CASE WHEN is_meeting THEN '17:dia_de_fomc' END, CASE WHEN is_half_day THEN '18:media_sesion' END], lambda r: r IS NOT NULL) AS sr,
        list_filter([CASE WHEN target IS NULL THEN '16:bracket_sin_objetivo' WHEN target < 0.0084 THEN '8:objetivo_bajo_el_coste' END, CASE WHEN ev IS NULL THEN '9:ev_neto_no_calculable' WHEN ev <= 0 THEN '9:ev_bajo_el_umbral' END, CASE WHEN tier <> 'A' THEN '10:tier_no_autorizado' END], lambda r: r IS NOT NULL) AS tr FROM t),
    b AS (SELECT *, CASE WHEN NOT is_session THEN ['19:mercado_cerrado'] WHEN NOT fresh THEN ['13:as_of_no_es_de_hoy'] WHEN NOT snapshot_ok THEN ['14:snapshot_no_valido'] WHEN veto THEN ['20:overlay_veto'] WHEN len(sr) > 0 THEN sr ELSE tr END AS bl,
        CASE WHEN NOT is_session THEN 'recommendation' WHEN NOT fresh THEN 'no_recommendation_stale_data' WHEN NOT snapshot_ok THEN 'no_recommendation_data_quality' ELSE 'recommendation' END AS status FROM s),
    r AS (SELECT *, CASE WHEN len(bl) = 0 THEN CASE WHEN p >= 0.5 THEN 'LONG' ELSE 'SHORT' END WHEN status = 'recommendation' THEN 'NOTHING' END AS direction FROM b)"""


def _gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return adapters.table(spark, sf, "orders").select(
        k.alias("k"), day.alias("session"), day.alias("as_of_day"), F.date_add(day, F.when(k % 41 == 0, 1).otherwise(0)).alias("today"), (k % 23 != 0).alias("is_session"), (k % 29 == 0).alias("is_half_day"), (k % 31 == 0).alias("is_meeting"), (k % 43 != 0).alias("snapshot_ok"), (k % 47 == 0).alias("veto"),
        F.when(k % 53 == 0, 1).otherwise(0).alias("trades_today"), F.when(k % 59 == 0, 2).otherwise(0).alias("observation_left"), ((k % 100) / 100.0 + 0.005).alias("p"), ((k % 37) / 10.0).alias("move_pct"), F.lit(0.0042).alias("cost_pct"), F.when(k % 3 != 0, 0.2042).alias("cost_total_pct"), (k % 3 == 1).alias("slippage_measured"),
        (1 + (k % 5) * 0.25).alias("stop_pct"), F.when(k % 61 != 0, (k % 7) * 0.5).alias("target_pct"), F.lit(None).cast("double").alias("daily_pnl_pct"), (-(k % 67) / 10.0).alias("weekly_pnl_pct"), F.when(k % 2 == 0, -(k % 71) / 5.0).alias("monthly_pnl_pct"), F.lit(10_000).alias("capital"),
    )


def _blocks():
    return F.array_join(F.transform("blockers", lambda b: F.concat_ws(":", b["rule"], b["code"])), ",")


@query("decision_gate", f"WITH {_GATE.format(minimum='0.55')} SELECT k, status, direction, tier, array_to_string(bl, ',') AS blocked_by, CASE WHEN len(bl) = 0 THEN round(10000 * 1.0 / stop, 2) END AS notional, CASE WHEN len(bl) = 0 THEN round(round(10000 * 1.0 / stop, 2) / 10000, 4) END AS leverage FROM r")
def decision_gate(spark: SparkSession, sf: str) -> DataFrame:
    got = gate.evaluated(_gate_rows(spark, sf))
    return got.select("k", "status", "direction", "tier", _blocks().alias("blocked_by"), F.col("notional").cast("double").alias("notional"), F.col("leverage").cast("double").alias("leverage"))


@query(
    "gate_sweep",
    f"WITH a AS (WITH {_GATE.format(minimum='0.55')} SELECT 0 AS cell, direction FROM r), b AS (WITH {_GATE.format(minimum='0.75')} SELECT 1 AS cell, direction FROM r) SELECT cell, direction, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL",
)
def gate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return gate.sweep(_gate_rows(spark, sf), [{"tier_a_min_probability": "0.55"}, {"tier_a_min_probability": "0.75"}]).groupBy("cell", "direction").agg(F.count("*").alias("n"))


@query("undecided_gate", "SELECT CASE WHEN o_orderkey % 23 = 0 THEN 'recommendation' WHEN o_orderkey % 41 = 0 THEN 'no_recommendation_stale_data' WHEN o_orderkey % 43 = 0 THEN 'no_recommendation_data_quality' ELSE 'no_recommendation_undecided' END AS status, count(*) AS n FROM orders GROUP BY 1")
def undecided_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.evaluated(_gate_rows(spark, sf), gate.PARAMETERS | {"risk_per_trade_pct": None}).groupBy("status").agg(F.count("*").alias("n"))


@query("premarket_advice", f"WITH {_GATE.format(minimum='0.55')}, a AS (SELECT direction, k % 6 <> 0 AND CASE direction WHEN 'LONG' THEN (k % 9 - 4) / 4.0 <= -0.5 WHEN 'SHORT' THEN (k % 9 - 4) / 4.0 >= 0.5 ELSE false END AS advised FROM r) SELECT direction, coalesce(advised, false) AS advised, count(*) AS n FROM a GROUP BY ALL")
def premarket_advice(spark: SparkSession, sf: str) -> DataFrame:
    got = gate.evaluated(_gate_rows(spark, sf)).withColumns({"premarket_session": F.when(F.col("k") % 6 == 0, F.date_sub("session", 1)).otherwise(F.col("session")), "overnight_move_pct": (F.col("k") % 9 - 4) / 4.0})
    return gate.premarket_advice(got).groupBy("direction", "advised").agg(F.count("*").alias("n"))


_EVENTS = "ev AS (SELECT CAST(ts AS DATE) AS session, event_id AS seq, ['bullish', 'bearish', 'neutral'][event_id % 3 + 1] AS sentiment, CASE WHEN event_id % 97 = 0 THEN 'high' WHEN event_id % 5 = 0 THEN 'medium' ELSE 'low' END AS magnitude, (event_id % 11) / 10.0 AS confidence, event_id % 13 = 0 AS suspicious FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    pick = F.when(i % 97 == 0, "high").when(i % 5 == 0, "medium").otherwise("low")
    return adapters.table(spark, sf, "events").select(F.to_date("ts").alias("session"), i.alias("seq"), F.element_at(F.array(*map(F.lit, ("bullish", "bearish", "neutral"))), (i % 3 + 1).cast("int")).alias("sentiment"), pick.alias("magnitude"), ((i % 11) / 10.0).alias("confidence"), (i % 13 == 0).alias("suspicious"))


@query(
    "overlay_tilt",
    f"""WITH {_EVENTS}, c AS (SELECT session, seq, sentiment, CASE WHEN suspicious AND magnitude = 'high' THEN 'medium' ELSE magnitude END AS magnitude, CASE WHEN suspicious AND confidence > 0.5 THEN 0.5 ELSE confidence END AS confidence FROM ev), w AS (SELECT *, CASE magnitude WHEN 'high' THEN 10.0 WHEN 'medium' THEN 5.0 ELSE 2.5 END AS w FROM c),
    g AS (SELECT session, count(*) AS n_events, count_if(sentiment = 'neutral') AS n_neutral, sum(CASE sentiment WHEN 'bullish' THEN w WHEN 'bearish' THEN -w ELSE 0 END) AS net_pct, sum(w) AS gross, greatest(coalesce(sum(w) FILTER (sentiment = 'bullish'), 0), coalesce(sum(w) FILTER (sentiment = 'bearish'), 0), coalesce(sum(w) FILTER (sentiment = 'neutral'), 0)) AS largest,
        arg_min(seq, -w * 1e9 + seq) AS dominant, bool_or(magnitude = 'high' AND confidence >= 0.8) AS veto FROM w GROUP BY session)
    SELECT session, n_events, n_neutral, CAST(net_pct AS DOUBLE) AS net_pct, dominant, veto, round(net_pct / gross, 6) AS ratio, round(largest / gross, 6) AS consensus, CASE WHEN abs(net_pct) <= 2.5 THEN 'neutral' WHEN net_pct > 0 THEN 'long' ELSE 'short' END AS side, abs(net_pct) > 10 AS clamped, CASE WHEN veto THEN 'veto' ELSE 'applied' END AS state, CAST(CASE WHEN veto THEN 0 ELSE greatest(least(net_pct, 10), -10) END AS DOUBLE) AS adjustment_pct FROM g""",
)
def overlay_tilt(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gate.overlay(gate.suspicion_capped(_events(spark, sf))), 6, "ratio", "consensus")


@query("bracket_tickets", """WITH t AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18, 6)) AS e, o_orderkey % 2 = 0 AS long, CAST(1 + (o_orderkey % 5) * 0.25 AS DECIMAL(12, 8)) AS stop, CAST((o_orderkey % 7 + 1) * 0.5 AS DECIMAL(12, 8)) AS target FROM orders)
    SELECT k, CAST(round(CAST(e AS DECIMAL(19, 6)) * CAST((CASE WHEN long THEN 100 - stop ELSE 100 + stop END) / 100 AS DECIMAL(10, 8)), 2) AS DOUBLE) AS stop_px, CAST(round(CAST(e AS DECIMAL(19, 6)) * CAST((CASE WHEN long THEN 100 + target ELSE 100 - target END) / 100 AS DECIMAL(10, 8)), 2) AS DOUBLE) AS target_px FROM t""")
def bracket_tickets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = adapters.table(spark, sf, "orders").select(k.alias("k"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.col("o_totalprice").alias("entry_px"), (1 + (k % 5) * 0.25).alias("stop_pct"), ((k % 7 + 1) * 0.5).alias("target_pct"))
    return gate.bracket(rows).select("k", F.col("stop_px").cast("double").alias("stop_px"), F.col("target_px").cast("double").alias("target_px"))


@query(
    "required_evidence",
    f"""WITH {BARS}, h AS (SELECT series_id, count(*) AS n, avg(CAST(close > open AS INTEGER)) AS p FROM bars GROUP BY series_id), c AS (SELECT *, (1.0 + 0.2042) / (2 * 1.0) AS p0, 1.959963984540054 * sqrt(p * (1 - p) / n) AS half FROM h)
    SELECT series_id, n, round(p, 6) AS p, p0, round(pow(1.6448536269514722 + 0.8416212335729143, 2) * p * (1 - p) / pow(p - p0, 2), 4) AS required, sign(p - half) * floor(abs(p - half) * 1e4) / 1e4 AS lo, sign(p + half) * floor(abs(p + half) * 1e4) / 1e4 AS hi FROM c""",
)
def required_evidence(spark: SparkSession, sf: str) -> DataFrame:
    h = adapters.order_bars(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.avg((F.col("close") > F.col("open")).cast("int")).alias("p"))
    lo, hi = gate.wald(F.col("p"), F.col("n"))
    h = h.withColumns({"p0": gate.break_even(F.lit(1.0), F.lit(0.2042)), "lo": lo, "hi": hi})
    return rounded(rounded(h.withColumn("required", gate.required_trades(F.col("p"), F.col("p0"))), 4, "required"), 6, "p")


@query("staleness_guard", f"""WITH {ANCHOR}, x AS (SELECT session, lag(session) OVER o AS before, row_number() OVER o AS i FROM bars WINDOW o AS (ORDER BY session)), g AS (SELECT *, i % 10 <> 0 AS open, CASE i % 7 WHEN 0 THEN NULL WHEN 1 THEN before - 1 WHEN 2 THEN before + 1 ELSE before END AS snap FROM x)
    SELECT session, CASE WHEN NOT open THEN 'closed' WHEN snap IS NULL THEN 'missing' WHEN snap < before THEN 'stale' WHEN snap > before THEN 'ahead' ELSE 'proceed' END AS guard, CAST(CASE WHEN (i % 50) > 30 THEN greatest(0, 5 - (i % 50 - 31) + 1) ELSE 0 END AS INTEGER) AS observation_left FROM g""")
def staleness_guard(spark: SparkSession, sf: str) -> DataFrame:
    line = Window.partitionBy("series_id").orderBy("session")
    x = adapters.order_bars(spark, sf, anchor=True).select("session", F.lag("session").over(line).alias("previous_session"), F.row_number().over(line).alias("i"))
    p, i = F.col("previous_session"), F.col("i")
    snap = F.when(i % 7 == 0, None).when(i % 7 == 1, F.date_sub(p, 1)).when(i % 7 == 2, F.date_add(p, 1)).otherwise(p)
    x = x.withColumns({"day": F.col("session"), "is_session": i % 10 != 0, "snapshot_session": snap, "last_execution": F.date_sub("session", F.when(i % 50 > 30, 31).otherwise(1)), "sessions_since": i % 50 - 31})
    return gate.staleness(x).select("session", "guard", F.col("observation_left").cast("int").alias("observation_left"))


_TWO = f"""{BARS}, after AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS session, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) > 1995 GROUP BY 1, 2), prior AS (SELECT * FROM bars WHERE year(session) < 2001)"""


@query(
    "row_deltas",
    f"""WITH {_TWO}, j AS (SELECT coalesce(b.series_id, a.series_id) AS series_id, coalesce(b.session, a.session) AS session, b.close AS close_before, a.close AS close_after, b.volume AS volume_before, a.volume AS volume_after, b.series_id IS NULL AS added, a.series_id IS NULL AS removed FROM prior b FULL JOIN after a ON a.series_id = b.series_id AND a.session = b.session)
    SELECT series_id, session, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN close_before = close_after AND volume_before = volume_after THEN 'same' ELSE 'changed' END AS change, close_before, close_after, round(close_after - close_before, 4) AS close_delta, volume_before, volume_after, volume_after - volume_before AS volume_delta FROM j""",
)
def row_deltas(spark: SparkSession, sf: str) -> DataFrame:
    o = adapters.table(spark, sf, "orders").where("o_orderstatus <> 'P' and year(o_orderdate) > 1995")
    after = adapters.bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), "o_totalprice", "o_orderkey")
    return rounded(journal.deltas(adapters.order_bars(spark, sf).where("year(session) < 2001"), after, ["series_id", "session"], ["close", "volume"]), 4, "close_delta")


@query("journal_statuses", f"WITH {_GATE.format(minimum='0.55')}, c AS (SELECT status, count(*) AS n FROM r GROUP BY status) SELECT s AS status, coalesce(n, 0) AS n FROM (SELECT unnest(['recommendation', 'no_recommendation_stale_data', 'no_recommendation_data_quality', 'no_recommendation_undecided', 'error']) AS s) LEFT JOIN c ON s = status")
def journal_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return journal.by_status(gate.evaluated(_gate_rows(spark, sf)))


@query(
    "attribution",
    f"""WITH {ANCHOR}, a AS (SELECT session, unnest(['news', 'macro']) AS agent, unnest([['long', 'short', 'neutral'][volume % 3 + 1], ['short', 'neutral', 'long'][volume % 3 + 1]]) AS side, sign(close - open) AS m FROM bars)
    SELECT session, agent, side, CAST(CASE side WHEN 'long' THEN m = 1 WHEN 'short' THEN m = -1 END AS INTEGER) AS won FROM a""",
)
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    b = adapters.order_bars(spark, sf, anchor=True)
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("volume") % 3 + 1).cast("int"))
    sides = b.select("session", F.explode(F.array(F.struct(F.lit("news").alias("agent"), pick("long", "short", "neutral").alias("side")), F.struct(F.lit("macro").alias("agent"), pick("short", "neutral", "long").alias("side")))).alias("x")).select("session", "x.*")
    return journal.attributed(sides, b).withColumn("won", F.col("won").cast("int"))


@query(
    "universe_exclusions",
    f"""WITH {BARS}, x AS (SELECT series_id, session, open, open = lag(close) OVER w AS stale, lag(session) OVER w AS before, volume FROM bars {W}), y AS (SELECT CASE WHEN volume % 11 = 0 THEN 'missing_ohlc' WHEN before IS NULL THEN 'no_previous_session' WHEN session < DATE '1996-01-01' THEN 'before_clean_cutoff' WHEN stale THEN 'stale_open' END AS reason FROM x) SELECT reason, count(*) AS n FROM y GROUP BY ALL""",
)
def universe_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    line = Window.partitionBy("series_id").orderBy("session")
    x = adapters.order_bars(spark, sf).withColumns({"stale": F.col("open") == F.lag("close").over(line), "before": F.lag("session").over(line)})
    rules = [("missing_ohlc", F.col("volume") % 11 == 0), ("no_previous_session", F.col("before").isNull()), ("before_clean_cutoff", F.col("session") < F.lit("1996-01-01").cast("date")), ("stale_open", F.col("stale"))]
    return journal.first_reason(x, rules).groupBy("reason").agg(F.count("*").alias("n"))


@query("paper_verdict", f"""WITH {BARS}, x AS (SELECT series_id, close / open - 1 AS paper, high / low - 1 AS reference FROM bars), g AS (SELECT series_id, count(*) AS n, avg(paper) AS a, avg(reference) AS b, stddev_samp(paper) / sqrt(count(*)) AS se FROM x GROUP BY series_id)
    SELECT series_id, n, round(a, 6) AS mean_paper, round(b, 6) AS mean_reference, CASE WHEN n < 30 THEN 'not_evaluable' WHEN abs(a - b) > 2 * se THEN 'diverges' ELSE 'consistent' END AS verdict FROM g""")
def paper_verdict(spark: SparkSession, sf: str) -> DataFrame:
    x = adapters.order_bars(spark, sf).select("series_id", (F.col("close") / F.col("open") - 1).alias("paper"), (F.col("high") / F.col("low") - 1).alias("reference"))
    return rounded(journal.paper_verdict(x), 6, "mean_paper", "mean_reference")


@query("cost_by_month", "WITH m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n_calls, sum(value) AS cost, sum(user_id) AS tokens, avg(CAST(event_type = 'view' AS INTEGER)) AS s FROM events GROUP BY 1) SELECT month, n_calls, round(cost, 4) AS cost, CAST(tokens AS BIGINT) AS tokens, round(s, 6) AS cached_share, round(sum(cost) OVER (ORDER BY month), 4) AS total_to_date FROM m")
def cost_by_month(spark: SparkSession, sf: str) -> DataFrame:
    calls = adapters.table(spark, sf, "events").select(F.col("ts").alias("at"), F.col("value").alias("cost"), F.col("user_id").alias("tokens"), (F.col("event_type") == "view").alias("cached"))
    return rounded(rounded(journal.month_report(calls), 4, "cost", "total_to_date"), 6, "cached_share")
