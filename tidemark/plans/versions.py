"""Queries of digests, versions of persisted rows, choices by a total order, and intervals of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.digests import table_digest
from tidemark.functions.frames import rounded
from tidemark.operators import calendar, features, label_history, persisted, resampling
from tidemark.plans.market import _DAYS
from tidemark.plans.registry import ANCHOR, query
from tidemark.sources import adapters, experiments

_LANES = ", ".join(f"sum(('0x' || substr(d, {8 * k + 1}, 8))::BIGINT)::VARCHAR" for k in range(8))


@query(
    "order_digests",
    f"""WITH r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}') AS d FROM orders)
    SELECT year, count(*) AS n, sha256(concat_ws('|', 'o_custkey:bigint,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string', count(*)::VARCHAR, {_LANES})) AS digest FROM r GROUP BY year""",
)
def order_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of the orders of each year, whatever their order and partitions."""
    o = adapters.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", "o_orderstatus")
    return table_digest(o, by=("year",))


_SPEC = {"family": "technical", "window": 20}


@query(
    "feature_records",
    f"""WITH {ANCHOR}, f AS (SELECT session, ln(close / lag(close) OVER o) AS ret_1, ln(close / lag(close, 5) OVER o) AS ret_5 FROM bars WINDOW o AS (ORDER BY session))
    SELECT 'features' AS source, session AS as_of, 'technical' AS family, sha256('{persisted.spec_digest(_SPEC)}' || '@' || strftime(session, '%Y-%m-%dT%H:%M:%S')) AS feature_version, round(ret_1, 6) AS ret_1, round(ret_5, 6) AS ret_5 FROM f""",
)
def feature_records(spark: SparkSession, sf: str) -> DataFrame:
    """Returns of the anchor as records of a store, versioned by specification and session."""
    from tidemark.functions.frames import log_return

    bars = adapters.order_bars(spark, sf, anchor=True)
    matrix = bars.select("session", log_return(F.col("close")).alias("ret_1"), log_return(F.col("close"), 5).alias("ret_5"))
    got = persisted.feature_records(matrix, "technical", ["ret_1", "ret_5"], _SPEC, "SPX", "2024-01-01 00:00:00")
    return rounded(got.select("source", "as_of", "family", "feature_version", "ret_1", "ret_5"), 6, "ret_1", "ret_5")


@query(
    "model_choice",
    """WITH s AS (SELECT lang, source, (n_chars % 100) / 100.0 + 0.005 AS p, quality AS y FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND source IS NOT NULL),
    c AS (SELECT lang, source, avg(pow(p - y, 2)) AS b, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b, l, sha256(source)) AS r FROM c)
    SELECT lang, source, round(b, 6) AS brier_score, round(l, 6) AS log_loss FROM k WHERE r = 1""",
)
def model_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The source of each language whose made forecasts score best, by the order of the registry."""
    d = adapters.table(spark, sf, "documents").where("lang is not null and source is not null").select("doc_id", "lang", "source")
    p, y = F.col("p"), F.col("y")
    scored = adapters.forecasts(spark, sf).join(d, "doc_id").groupBy("lang", "source").agg(F.avg(F.pow(p - y, 2)).alias("brier_score"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    got = experiments.chosen(scored.withColumns({"family": F.lit("elasticnet"), "run_sha256": F.sha2("source", 256)}), ("lang",))
    return rounded(got.select("lang", "source", "brier_score", "log_loss"), 6, "brier_score", "log_loss")


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    """By priority the result of following the last session's move, and of holding, in percent."""
    bars = features.volatility(adapters.order_bars(spark, sf))
    held = (F.col("close") / F.col("open") - 1) * 100
    from tidemark.functions.frames import lag

    return bars.select("series_id", "session", held.alias("held"), (held * F.coalesce(F.signum(lag("ret_log")), F.lit(0.0))).alias("followed"))


@query("paired_difference_intervals")
def paired_difference_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded intervals of the mean difference between following and holding; 10,000 draws."""
    got = resampling.paired_interval(_differences(spark, sf), "followed", "held")
    return rounded(got, 8, "estimate", "lo", "hi")


@query("dominance_by_interval")
def dominance_by_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The same differences less costs of 0 to 20 percent, each level resampled anew."""
    rows = _differences(spark, sf).withColumn("d", F.col("followed") - F.col("held"))
    return rounded(resampling.dominance_intervals(rows, [0.0, 1.0, 5.0, 20.0]), 8, "estimate", "lo", "hi")


@query(
    "label_exclusions",
    f"""WITH {ANCHOR.replace('bars AS', 'anchor AS')}, {_DAYS}, z1 AS (SELECT *, lag(close) OVER o AS cb, lag(abs(ln(close / open))) OVER o AS own, session >= DATE '1998-01-01' AS late FROM anchor WINDOW o AS (ORDER BY session)),
    z2 AS (SELECT z1.*, s.is_half_day, CASE WHEN NOT s.is_session THEN 'no_session' WHEN open = cb THEN 'stale_open' END AS why FROM z1 JOIN s ON day = session WHERE cb IS NOT NULL),
    z3 AS (SELECT *, last_value(CASE WHEN why IS NULL AND NOT is_half_day AND NOT late THEN own END IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM z2),
    z4 AS (SELECT *, CASE WHEN is_half_day THEN before * sqrt(3.5 / 6.5) ELSE own END AS sg FROM z3), z5 AS (SELECT *, coalesce(why, CASE WHEN sg IS NULL THEN 'no_forecast' END, CASE WHEN late THEN 'not_closed' END) AS reason FROM z4)
    SELECT coalesce(reason, 'labelled') AS reason, CASE WHEN reason IS NOT NULL THEN '' WHEN is_half_day THEN 'previous' ELSE 'forecast' END AS carrier, count(*) AS n, min(session) AS first, max(session) AS last, round(avg(CASE WHEN reason IS NULL THEN sg END), 6) AS mean_sigma FROM z5 GROUP BY 1, 2""",
)
def label_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Why sessions of the anchor have no label, and the sigma of those that can have one; short sessions by the root of their hours."""
    from pyspark.sql import Window

    bars = adapters.order_bars(spark, sf, anchor=True)
    own = F.lag(F.abs(F.log(F.col("close") / F.col("open")))).over(Window.partitionBy("series_id").orderBy("session"))
    sigmas = bars.select("series_id", "session", own.alias("sigma"))
    got = label_history.sample(bars, calendar.calendar(calendar.days_of(adapters.table(spark, sf, "orders"), "o_orderdate")), sigmas, "1998-01-01 00:00:00")
    by = got.groupBy(F.coalesce("reason", F.lit("labelled")).alias("reason"), F.coalesce("carrier", F.lit("")).alias("carrier"))
    return rounded(by.agg(F.count("*").alias("n"), F.min("session").alias("first"), F.max("session").alias("last"), F.avg("sigma").alias("mean_sigma")), 6, "mean_sigma")
