"""Queries of headlines, events, landed payloads and batches against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import news, quality
from tidemark.plans.registry import BARS, query
from tidemark.sources import adapters, formats, store

_AT = "2024-01-02 12:00:00"
_NEWS = r"""n AS (SELECT doc_id, source AS feed, substr(split_part(text, chr(10), 1), 1, 80) AS title, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id % 4000) AS published_at FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(replace(lower(title), 'ß', 'ss')), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM n), d AS (SELECT *, 'sha256:' || sha256(normal) AS hash FROM h)"""


@query("headline_hashes", f"WITH {_NEWS} SELECT doc_id, normal, hash AS headline_hash FROM d")
def headline_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return news.prepared(adapters.headlines(spark, sf)).select("doc_id", "normal", "headline_hash")


@query("headline_duplicates", f"WITH {_NEWS} SELECT count(*) AS n, count(*) - count(DISTINCT hash) AS n_duplicate FROM d")
def headline_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    got = news.first_of_each(news.prepared(adapters.headlines(spark, sf)))
    return got.agg(F.count("*").alias("n"), F.count_if("duplicate").alias("n_duplicate"))


@query(
    "headline_batch",
    f"""WITH {_NEWS}, w AS (SELECT * FROM d WHERE published_at BETWEEN TIMESTAMP '{_AT}' - INTERVAL 24 HOUR AND TIMESTAMP '{_AT}') SELECT hash AS headline_hash, min(published_at) AS published_at, substr(arg_min(title, (published_at, title)), 1, 40) AS title FROM w GROUP BY hash""",
)
def headline_batch(spark: SparkSession, sf: str) -> DataFrame:
    return news.batch(adapters.headlines(spark, sf), _AT, most_chars=40).select("headline_hash", "published_at", "title")


@query(
    "headline_batch_counts",
    f"""WITH {_NEWS}, f AS (SELECT *, published_at > TIMESTAMP '{_AT}' AS late, published_at < TIMESTAMP '{_AT}' - INTERVAL 24 HOUR AS old FROM d) SELECT count(*) AS n, count_if(late) AS n_future, count_if(old) AS n_old, count_if(NOT late AND NOT old) AS n_window, count_if(NOT late AND NOT old) - count(DISTINCT hash) FILTER (NOT late AND NOT old) AS n_duplicate, count(DISTINCT hash) FILTER (NOT late AND NOT old) AS n_new FROM f""",
)
def headline_batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return news.batch_counts(adapters.headlines(spark, sf), _AT)


@query("near_headlines")
def near_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines of an hour of a feed that are nearly one before them."""
    h = news.prepared(adapters.headlines(spark, sf)).withColumn("block", F.concat_ws("|", "feed", F.date_trunc("HOUR", F.col("published_at")).cast("string")))
    return news.nearly_same(h.select("block", "doc_id", "published_at", "title", "normal"), order=("published_at", "title", "doc_id")).select("doc_id", "near_duplicate")


@query(
    "first_vintages",
    """WITH v AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS realtime_start, max(CASE WHEN l_quantity <= 30 THEN l_quantity END) AS value FROM lineitem GROUP BY 1, 2, 3)
    SELECT series_id, date, min(realtime_start) FILTER (value IS NOT NULL) AS realtime_start, arg_min(value, realtime_start) FILTER (value IS NOT NULL) AS value FROM v GROUP BY 1, 2""",
)
def first_vintages(spark: SparkSession, sf: str) -> DataFrame:
    """Vintages written as payloads, a reference month each, and read back."""
    day = F.col("l_shipdate").cast("date")
    value = F.max(F.when(F.col("l_quantity") <= 30, F.col("l_quantity")))
    rows = adapters.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), day.alias("date"), F.date_add(day, F.col("l_linenumber")).alias("realtime_start")).agg(value.alias("value"))
    text = F.coalesce(F.col("value").cast("string"), F.lit("."))
    observation = F.struct(F.col("realtime_start").cast("string").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"), F.col("date").cast("string").alias("date"), text.alias("value"))
    payloads = rows.groupBy("series_id", F.trunc("date", "month").alias("m")).agg(F.to_json(F.struct(F.collect_list(observation).alias("observations"))).alias("payload"))
    return formats.first_vintages(formats.parsed_observations(payloads))


@query("article_feed", "SELECT source AS feed, 'Title ' || doc_id AS title, 'http://x/' || doc_id AS url, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id % 4000) AS published_at FROM documents WHERE doc_id % 7 <> 0")
def article_feed(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.table(spark, sf, "documents")
    at = F.expr("timestampadd(MINUTE, CAST(doc_id % 4000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    i = F.col("doc_id").cast("string")
    article = F.struct(F.concat(F.lit("http://x/"), i).alias("url"), F.concat(F.lit("Title "), i).alias("title"), F.when(F.col("doc_id") % 7 != 0, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.lit("soon")).alias("seendate"))
    payloads = d.groupBy(F.col("source").alias("feed"), F.expr("doc_id div 100").alias("page")).agg(F.to_json(F.struct(F.collect_list(article).alias("articles"))).alias("payload"))
    return formats.parsed_articles(payloads).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("rss_feed", "SELECT source AS feed, 'Title ' || doc_id AS title, 'http://x/' || doc_id AS url, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id % 4000) AS published_at FROM documents WHERE doc_id % 7 <> 0")
def rss_feed(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.table(spark, sf, "documents")
    at = F.expr("timestampadd(MINUTE, CAST(doc_id % 4000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    i = F.col("doc_id").cast("string")
    date = F.when(F.col("doc_id") % 7 != 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.lit("soon"))
    item = F.concat(F.lit("<item><title>Title "), i, F.lit("</title><link>http://x/"), i, F.lit("</link><pubDate>"), date, F.lit("</pubDate></item>"))
    payloads = d.groupBy(F.col("source").alias("feed"), F.expr("doc_id div 100").alias("page")).agg(F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("payload"))
    return formats.parsed_feed(payloads).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(
    "earnings_known",
    """WITH o AS (SELECT 'S' || o_custkey % 50 AS symbol, CAST(o_orderdate AS DATE) AS event_date, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 9 AS INTEGER) AS observed, ['before', 'after'][o_orderkey % 2 + 1] AS moment, ['estimated', 'confirmed'][o_orderkey % 3 % 2 + 1] AS certainty FROM orders), s AS (SELECT DISTINCT event_date AS session, event_date - 2 AS as_of FROM o)
    SELECT session, symbol, arg_max(moment, (observed, moment, certainty)) AS moment, arg_max(certainty, (observed, moment, certainty)) AS certainty FROM o JOIN s ON event_date = session WHERE observed <= as_of GROUP BY 1, 2""",
)
def earnings_known(spark: SparkSession, sf: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    pick = lambda i, *names: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    o = adapters.table(spark, sf, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), day.alias("event_date"), F.date_sub(day, (k % 9).cast("int")).alias("observed_at"), pick(k % 2, "before", "after").alias("moment"), pick(k % 3 % 2, "estimated", "confirmed").alias("certainty"))
    return news.earnings_known(o, o.select(F.col("event_date").alias("session"), F.date_sub("event_date", 2).alias("as_of")).distinct())


@query("event_merge", """WITH o AS (SELECT DISTINCT 'S' || o_custkey % 50 AS symbol, CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderkey % 4 <> 0), d AS (SELECT DISTINCT 'S' || o_custkey % 50 AS symbol, CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 9 = 0)
    SELECT symbol, event_date, CASE WHEN d.x THEN 'confirmed' ELSE 'estimated' END AS certainty, CASE WHEN o.x AND d.x THEN 'both' WHEN d.x THEN 'declared' ELSE 'observed' END AS origin FROM (SELECT *, true AS x FROM o) o FULL JOIN (SELECT *, true AS x FROM d) d USING (symbol, event_date)""")
def event_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = adapters.table(spark, sf, "orders").select(k, F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("event_date"))
    return news.merged_events(o.where(k % 4 != 0), o.where((k % 4 == 0) | (k % 9 == 0)))


@query("publications_by_day", "SELECT CAST(ts AS DATE) AS day, event_type AS series_id, min(ts) AS first_published FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2")
def publications_by_day(spark: SparkSession, sf: str) -> DataFrame:
    o = adapters.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("published_at"))
    return news.publications(o, zone="UTC")


@query(
    "premarket_gap",
    """WITH t AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS session, ts, value FROM events WHERE CAST(ts AS TIME) <= TIME '08:45:00' AND value > 0), c AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS session, arg_max(value, ts) AS close FROM events GROUP BY 1, 2), p AS (SELECT series_id, session, lag(close) OVER (PARTITION BY series_id ORDER BY session) AS close FROM c),
    e AS (SELECT series_id, session, arg_max(value, ts) AS last FROM t GROUP BY 1, 2) SELECT p.series_id, p.session, round(last, 6) AS last, round(p.close, 6) AS close, round((last / nullif(p.close, 0) - 1) * 100, 4) AS gap_pct FROM p LEFT JOIN e USING (series_id, session)""",
)
def premarket_gap(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = adapters.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("at"), F.col("value").alias("price"), "event_id")
    # As arg_max does: of events at one instant the first counts, and a null price or instant never.
    order = ("at", -F.col("event_id"))
    known = F.when(F.col("price").isNotNull() & F.col("at").isNotNull(), F.struct(*order))
    c = e.groupBy("series_id", F.to_date("at").alias("session")).agg(F.max_by("price", known).alias("c"))
    c = c.select("series_id", "session", F.lag("c").over(Window.partitionBy("series_id").orderBy(F.asc_nulls_last("session"))).alias("previous_close"))
    got = formats.premarket_gap(e, c, zone="UTC", order=order).select("series_id", "session", "last", "close", "gap_pct")
    return rounded(rounded(got, 6, "last", "close"), 4, "gap_pct")


@query(
    "batch_verdicts",
    f"""WITH {BARS}, b AS (SELECT series_id, session, close * CASE WHEN volume % 4 = 0 THEN 1.000001 WHEN volume % 7 = 0 THEN 1.01 ELSE 1 END AS close, CASE WHEN volume % 5 <> 0 THEN volume END AS volume FROM bars WHERE session >= DATE '1996-01-01'), s AS (SELECT series_id, session, close, volume FROM bars WHERE session < DATE '2000-01-01')
    SELECT CASE WHEN s.series_id IS NULL THEN 'new' WHEN abs(b.close - s.close) <= greatest(abs(b.close), abs(s.close)) * 1e-5 AND b.volume IS NOT DISTINCT FROM s.volume THEN 'unchanged' ELSE 'revise' END AS verdict, count(*) AS n FROM b LEFT JOIN s USING (series_id, session) GROUP BY 1""",
)
def batch_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A batch against stored rows: adjusted prices count as the same within a tolerance, volumes don't."""
    bars = adapters.order_bars(spark, sf)
    clocks = {"source": F.lit("s"), "as_of": F.col("session"), "fetched_at": F.lit("2024-01-01").cast("timestamp"), "published_at": F.lit(None).cast("timestamp"), "version": F.lit(1)}
    columns = ["source", "series_id", "as_of", "fetched_at", "published_at", "version", "close", "volume"]
    late = F.col("session") >= F.lit("1996-01-01").cast("date")
    v = F.col("volume")
    batch = bars.where(late).withColumn("close", F.col("close") * F.when(v % 4 == 0, 1.000001).when(v % 7 == 0, 1.01).otherwise(1.0)).withColumn("volume", F.when(v % 5 != 0, v)).withColumns(clocks).select(*columns)
    stored = bars.where(F.col("session") < F.lit("2000-01-01").cast("date")).withColumns(clocks).select(*columns)
    return store.classified(batch, stored, ["close", "volume"], noisy=("close",)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "record_faults",
    """WITH r AS (SELECT CASE WHEN event_id % 19 = 0 THEN ' ' ELSE event_type END AS source, CASE WHEN event_id % 23 <> 0 THEN user_id END AS series_id, CAST(ts AS DATE) + CAST(CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS INTEGER) AS as_of, ts AS fetched, CASE WHEN event_id % 31 = 0 THEN ts + INTERVAL 1 HOUR WHEN event_id % 2 = 0 THEN ts END AS published, event_id % 37 AS version FROM events),
    f AS (SELECT CASE WHEN trim(source) = '' THEN 'source' WHEN series_id IS NULL THEN 'series_id' WHEN CAST(fetched AS DATE) < as_of THEN 'fetched_before_as_of' WHEN published > fetched THEN 'published_after_fetched' WHEN version < 1 THEN 'version' END AS fault FROM r) SELECT fault, count(*) AS n FROM f GROUP BY ALL""",
)
def record_faults(spark: SparkSession, sf: str) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts")
    rows = adapters.table(spark, sf, "events").select(
        F.when(i % 19 == 0, " ").otherwise(F.col("event_type")).alias("source"), F.when(i % 23 != 0, F.col("user_id").cast("string")).alias("series_id"), F.date_add(F.to_date(ts), F.when(i % 29 == 0, 1).otherwise(0)).alias("as_of"), ts.alias("fetched_at"),
        F.when(i % 31 == 0, ts + F.expr("INTERVAL 1 HOUR")).when(i % 2 == 0, ts).alias("published_at"), (i % 37).alias("version"),
    )
    return store.faults(rows).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "spread_by_tranche",
    """WITH t AS (SELECT unnest(range(5)) AS tranche), o AS (SELECT CAST(floor(hour(ts) / 4.8) AS INTEGER) AS tranche, value AS bid, value * (1 + (event_id % 9) / 10000.0) AS ask FROM events WHERE hour(ts) < 20 AND value > 0)
    SELECT CAST(t.tranche AS INTEGER) AS tranche, count(bid) AS n, round(avg(ask - bid), 8) AS mean_usd, round(avg((ask - bid) / bid * 100), 8) AS mean_pct, round(avg((ask - bid) / bid * 100) - 0.0042, 8) AS over_declared_pct FROM t LEFT JOIN o USING (tranche) GROUP BY 1""",
)
def spread_by_tranche(spark: SparkSession, sf: str) -> DataFrame:
    """Spreads seen in five parts of a day against the declared one; a part without any stays, with nulls."""
    e = adapters.table(spark, sf, "events").where("hour(ts) < 20 and value > 0")
    o = e.select(F.floor(F.hour("ts") / 4.8).cast("int").alias("tranche"), F.col("value").alias("bid"), (F.col("value") * (1 + (F.col("event_id") % 9) / 10000.0)).alias("ask"))
    return rounded(quality.spreads(o, 5, 0.0042), 8, "mean_usd", "mean_pct", "over_declared_pct")
