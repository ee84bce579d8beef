"""The registry of queries and their DuckDB SQL, and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BARS = """bars AS (SELECT {key} AS series_id, CAST(o_orderdate AS DATE) AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM {tables} GROUP BY 1, 2)"""
BARS = _BARS.format(key="o_orderpriority", tables="orders")
ANCHOR = _BARS.format(key="'anchor'", tables="orders")
SEGMENTS = _BARS.format(key="c_mktsegment", tables="orders JOIN customer ON o_custkey = c_custkey")
W = "WINDOW w AS (PARTITION BY series_id ORDER BY session)"


def over(a: int | str, b: int) -> str:
    end = lambda x: "UNBOUNDED PRECEDING" if isinstance(x, str) else "CURRENT ROW" if x == 0 else f"{-x} PRECEDING"
    return f"OVER (PARTITION BY series_id ORDER BY session ROWS BETWEEN {end(a)} AND {end(b)})"


def full(agg: str, x: str, a: int, b: int) -> str:
    return f"(CASE WHEN count({x}) {over(a, b)} = {b - a + 1} THEN {agg}({x}) {over(a, b)} END)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add

#: Bars of the anchor, markets, goods and sectors, as adapters.market_bars makes them.
MARKET = """ticks AS (SELECT CAST(o_orderdate AS DATE) AS session, o_orderkey AS k, o_totalprice AS p, unnest(['SPX', ['DAX', 'FTSE', 'STOXX', 'NIKKEI', 'HSI'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)],
    ['DXY', 'VIX', 'VIX9D', 'VIX3M', 'OIL'][n_regionkey + 1], CASE o_orderstatus WHEN 'O' THEN 'GOLD' WHEN 'F' THEN 'EURUSD' END, 'SECTOR:' || c_mktsegment]) AS series_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    market AS (SELECT series_id, session, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, count(*) AS volume FROM ticks WHERE series_id IS NOT NULL GROUP BY 1, 2), spx AS (SELECT * FROM market WHERE series_id = 'SPX')"""
#: Returns of all other series at the anchor's sessions, as of (le) and before (lt) them.
BROUGHT = f"""{MARKET}, a AS (SELECT session, ln(close / lag(close) OVER (ORDER BY session)) AS r0 FROM spx),
    o AS (SELECT series_id, session, ln(close / lag(close) OVER w) AS r, ln(close / lag(close, 5) OVER w) AS r5, close AS c FROM market WHERE series_id <> 'SPX' {W}), grid AS (SELECT * FROM a CROSS JOIN (SELECT DISTINCT series_id FROM o)),
    le AS (SELECT grid.*, o.r AS r_le FROM grid ASOF LEFT JOIN o ON grid.series_id = o.series_id AND grid.session >= o.session), j AS (SELECT le.*, o.r AS r_lt, o.r5 AS r5_lt, o.c AS c_lt FROM le ASOF LEFT JOIN o ON le.series_id = o.series_id AND le.session > o.session)"""


def of(series: str, column: str) -> str:
    return f"max(CASE WHEN series_id = '{series}' THEN {column} END)"


def robust(source: str, column: str, name: str) -> str:
    """CTEs that end in `name` (session, z): the robust score of a column over the sessions up to each."""
    return f"""{name}_k AS (SELECT session, {column} AS x FROM {source} WHERE {column} IS NOT NULL), {name}_h AS (SELECT *, median(x) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS med, list(x) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS past FROM {name}_k),
    {name} AS (SELECT session, CASE WHEN len(past) >= 250 AND mad > 0 THEN (x - med) / (1.4826 * mad) END AS z FROM (SELECT *, list_aggregate(list_transform(past, lambda v: abs(v - med)), 'median') AS mad FROM {name}_h))"""


def percentile(source: str, column: str, name: str) -> str:
    """CTEs that end in `name` (session, q): the share of earlier values at most the current."""
    return f"""{name}_k AS (SELECT session, {column} AS x FROM {source} WHERE {column} IS NOT NULL), {name}_h AS (SELECT *, list(x) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM {name}_k),
    {name} AS (SELECT session, CASE WHEN len(past) >= 250 THEN len(list_filter(past, lambda v: v <= x)) / len(past) END AS q FROM {name}_h)"""


def rounds(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c.rsplit('.', 1)[-1]}" for c in columns)
