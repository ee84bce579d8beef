"""Queries of landed files, stores fed by streams, state across sessions, horizons, intervals and callable decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import calendar, deciding, engine, intervals, labels
from tidemark.plans.registry import ANCHOR, query
from tidemark.sources import adapters, landed
from tidemark.streaming import horizon, sink, state


def order_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ticks: by priority, at the key's millisecond of the first hour of the month, bid a cent under the ask."""
    o = adapters.table(spark, sf, "orders")
    at = F.timestamp_millis(F.unix_millis(F.date_trunc("month", F.col("o_orderdate"))) + F.col("o_orderkey") % 3_600_000)
    return o.select(F.substring("o_orderpriority", 1, 1).alias("series_id"), at.alias("at"), F.col("o_totalprice").cast("double").alias("ask"), (F.col("o_totalprice").cast("double") - 0.01).alias("bid"))


@query(
    "landed_ticks",
    """WITH t AS (SELECT substr(o_orderpriority, 1, 1) AS series_id, date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS h, o_orderkey % 3600000 AS ms, o_totalprice AS p FROM orders)
    SELECT series_id, CAST(h AS DATE) AS month, count(*) AS n, round(min(p), 2) AS low, round(max(p), 2) AS high, round(sum(p - 0.01), 2) AS bids, max(ms) AS last_ms FROM t GROUP BY ALL""",
)
def landed_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as packed tick files by their tasks and read as a data source."""
    landed.register(spark)
    folder = landed.shared_folder(spark, "ticks")
    landed.land_ticks(order_ticks(spark, sf), folder, scale=100).agg(F.sum("n")).collect()
    ticks = landed.load(spark, "ticks", folder, scale=100, filesPerTask=32)
    got = ticks.groupBy("series_id", F.trunc("at", "month").alias("month")).agg(F.count("*").alias("n"), F.min("ask").alias("low"), F.max("ask").alias("high"), F.sum("bid").alias("bids"), (F.unix_millis(F.max("at")) - F.unix_millis(F.date_trunc("month", F.max("at")))).alias("last_ms"))
    return rounded(got, 2, "low", "high", "bids")


@query(
    "landed_vintages",
    """SELECT l_returnflag || l_linenumber AS series_id, year(l_shipdate) AS year, count(*) AS n, count(CASE WHEN l_orderkey % 10 <> 0 THEN 1 END) AS n_values, round(sum(CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END), 2) AS total,
        max(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER)) AS last_known FROM lineitem GROUP BY ALL""",
)
def landed_vintages(spark: SparkSession, sf: str) -> DataFrame:
    """Line items written as JSON answers of a series, year and part, and read as a data source."""
    landed.register(spark)
    folder = landed.shared_folder(spark, "vintages")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    line = adapters.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("series"), F.year("l_shipdate").alias("year"), (F.col("l_orderkey") % 1000).alias("part"), F.floor(F.col("l_orderkey") / 1_000_000).alias("more"),
        F.struct(day("l_shipdate").alias("date"), day(F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int"))).alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_extendedprice").cast("string")).otherwise(".").alias("value")).alias("o"),
    )
    # A file holds what some hundred orders have of a series and year, however large the table.
    part = F.floor(F.col("part") / 500).cast("string")
    files = line.groupBy("series", "year", part.alias("part"), "more").agg(F.to_json(F.struct(F.collect_list("o").alias("observations"))).alias("payload"))
    named = files.select(F.concat("series", F.lit("/"), "year", F.lit("-12-31-"), "part", F.lit("-"), F.col("more").cast("string"), F.lit(".json")).alias("name"), "payload")
    landed.land_json(named, folder).agg(F.sum("n")).collect()
    got = landed.load(spark, "vintages", folder, filesPerTask=64).groupBy("series_id", F.year("date").cast("long").alias("year"))
    return rounded(got.agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"), F.max("realtime_start").alias("last_known")), 2, "total")


@query(
    "sequenced_versions",
    """WITH e AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS series_id, CAST(date_trunc('month', ts) AS DATE) AS as_of, ts AS fetched_at, CAST(round(value / 10) AS DOUBLE) AS v, event_id FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
    c AS (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY source, series_id, as_of ORDER BY fetched_at, v))
    SELECT source, series_id, as_of, count(*) AS versions, arg_max(v, i) AS value, max(fetched_at) AS fetched_at FROM c WHERE i = 1 OR v IS DISTINCT FROM before GROUP BY ALL""",
)
def sequenced_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What a store holds after events arrived as records: repeats add nothing, changes are versions."""
    e = adapters.table(spark, sf, "events")
    rows = e.where("user_id is not null and event_type is not null").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("series_id"), F.trunc("ts", "month").alias("as_of"), F.col("ts").alias("fetched_at"), F.col("ts").alias("published_at"), F.lit(1).alias("version"), F.round(F.col("value") / 10).alias("value")
    )
    got = sink.appended(rows).groupBy("source", "series_id", "as_of")
    return got.agg(F.count("*").alias("versions"), F.max_by("value", "version").alias("value"), F.max("fetched_at").alias("fetched_at"))


_OPEN = "isodow(day) < 6"


@query(
    "session_state",
    f"""WITH t AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS session, round((o_totalprice - 150000) / 1000) AS pnl FROM orders WHERE o_custkey % 10 = (year(o_orderdate) % 10)),
    d AS (SELECT day, {_OPEN} AS is_open, count(CASE WHEN {_OPEN} THEN 1 END) OVER (ORDER BY day) AS n FROM (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS TIMESTAMP), CAST(max(o_orderdate) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM orders)),
    p AS (SELECT series_id, session, count(*) AS trades, sum(pnl) AS pnl FROM t GROUP BY ALL), x AS (SELECT p.*, n, is_open, session - lag(session) OVER (PARTITION BY series_id ORDER BY session) > 7 AS back FROM p JOIN d ON session = day),
    y AS (SELECT *, last_value(CASE WHEN back THEN n - is_open::INT END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY session) AS begun FROM x)
    SELECT series_id, session, trades, pnl, 0.0::DOUBLE AS day_pnl, coalesce(sum(pnl) OVER (PARTITION BY series_id, date_trunc('week', session) ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS week_pnl,
        coalesce(sum(pnl) OVER (PARTITION BY series_id, date_trunc('month', session) ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS month_pnl, CAST(coalesce(greatest(0, 6 - (n - begun)), 0) AS INTEGER) AS observation_left FROM y""",
)
def session_state(spark: SparkSession, sf: str) -> DataFrame:
    """Loss totals and the observation counter of orders as trades; a tenth of the customers trades each year."""
    o = adapters.table(spark, sf, "orders").withColumn("session", F.col("o_orderdate").cast("date"))
    trades = o.where(F.col("o_custkey") % 10 == F.year("session") % 10).select(F.col("o_orderpriority").alias("series_id"), "session", F.round((F.col("o_totalprice") - 150_000) / 1000).alias("pnl"))
    ends = o.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day")).withColumn("is_session", F.weekday("day") < 5)
    return state.session_state(trades, days)


@query(
    "titles_within_horizon",
    """WITH RECURSIVE h AS (SELECT substr(split_part(text, chr(10), 1), 1, 20) AS title, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id % 40000) AS t FROM documents WHERE text IS NOT NULL), g AS (SELECT title, t, count(*) AS n FROM h GROUP BY ALL),
    k AS (SELECT title, min(t) AS t FROM g GROUP BY title UNION ALL SELECT title, nxt AS t FROM (SELECT k.title, (SELECT min(g.t) FROM g WHERE g.title = k.title AND g.t > k.t + INTERVAL 24 HOUR) AS nxt FROM k) WHERE nxt IS NOT NULL)
    SELECT title, count(*) AS kept, max(t) AS last_kept FROM k GROUP BY title""",
)
def titles_within_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of documents as titles, each once in 24 hours."""
    d = adapters.table(spark, sf, "documents").where("text is not null")
    at = F.expr("timestampadd(MINUTE, CAST(doc_id % 40000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    rows = d.select(F.substring(F.substring_index("text", "\n", 1), 1, 20).alias("title"), at.alias("t"))
    return horizon.first_within(rows, "title", "t").groupBy("title").agg(F.count("*").alias("kept"), F.max("t").alias("last_kept"))


@query(
    "events_in_sessions",
    """WITH d AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE) - INTERVAL 1 DAY, CAST(max(ts) AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS session FROM events), m AS (SELECT *, make_date(year(session), 3, 1) AS m3, make_date(year(session), 11, 1) AS m11 FROM d WHERE isodow(session) < 6),
    z AS (SELECT session, CASE WHEN session >= m3 + CAST((7 - isodow(m3)) % 7 + 7 AS INTEGER) AND session < m11 + CAST((7 - isodow(m11)) % 7 AS INTEGER) THEN 4 ELSE 5 END AS off FROM m),
    s AS (SELECT session, CAST(session AS TIMESTAMP) + INTERVAL 570 MINUTE + INTERVAL 1 HOUR * off AS open_utc, CAST(session AS TIMESTAMP) + INTERVAL 16 HOUR + INTERVAL 1 HOUR * off AS close_utc FROM z)
    SELECT session, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN s ON ts >= open_utc AND ts <= close_utc GROUP BY ALL""",
)
def events_in_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the hours in which the market is open, summer and winter, found without a date key."""
    e = adapters.table(spark, sf, "events").select("event_type", "value", "ts")
    ends = e.agg(F.date_sub(F.to_date(F.min("ts")), 1).alias("a"), F.date_add(F.to_date(F.max("ts")), 1).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("session")).where(F.weekday("session") < 5)
    kind = e.schema["ts"].dataType
    hours = days.select("session", calendar.utc(F.col("session"), calendar.OPEN).cast(kind).alias("open_utc"), calendar.utc(F.col("session"), calendar.CLOSE).cast(kind).alias("close_utc"))
    got = intervals.held_by(e, hours, "ts", "open_utc", "close_utc", width=6 * 3600).groupBy("session", "event_type")
    return rounded(got.agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2, "total")


@query(
    "decisions_by_fold",
    f"""WITH {ANCHOR}, b AS (SELECT session, open, close, row_number() OVER o - 1 AS i, count(*) OVER () AS n, coalesce(sign(lag(close, 1) OVER o / lag(close, 6) OVER o - 1), 0) AS mom, coalesce(-sign(open / lag(close) OVER o - 1), 0) AS gap FROM bars WINDOW o AS (ORDER BY session)),
    t AS (SELECT *, (i - (n - 500)) // 100 AS fold FROM b WHERE i >= n - 500), s AS (SELECT fold, session, CASE fold WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN mom ELSE gap END AS side, open, close FROM t)
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, count_if(side <> 0) AS n_trades, round(coalesce(sum(CASE WHEN side <> 0 THEN (close / open - 1) * side - 0.000042 END), 0), 4) AS pnl FROM s GROUP BY fold""",
)
def decisions_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A walk-forward run in which every fold decides by a function of its own: the five baselines as callables."""
    bars = adapters.order_bars(spark, sf, anchor=True)
    plan = labels.walk_forward(adapters.positions(bars), n_splits=5, test_size=100)
    chosen = deciding.decided(plan, bars, dict(enumerate(deciding.CALLABLES.values())), window=10)
    chosen = chosen.withColumn("notional", F.lit(10_000).cast("decimal(18,2)"))
    got = engine.run(plan, chosen, engine.day_path(bars).limit(0)).groupBy("fold")
    return rounded(got.agg(F.count("*").alias("n"), F.count_if(F.col("side") != 0).alias("n_trades"), F.coalesce(F.sum("pnl_declared"), F.lit(0.0)).alias("pnl")), 4, "pnl")
