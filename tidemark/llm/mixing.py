"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a shard, its documents in a seeded order, are a line cut into blocks of BLOCK words. Targets by weight
become blocks: first each source, then each shard of a source gets the blocks that the highest quotients
votes / (2 * blocks + 1) give it. A shard takes its line whole as often as its quota allows, and the rest as one run of
blocks from a seeded start, so that all documents but two a shard are taken whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, REST, carrying, n_words, small, staged

#: Words of a block, and of a shard; a source of more than MAX_SHARDS shards gets larger ones.
BLOCK, SHARD, MAX_SHARDS = 16, 250_000, 65_536
#: Sources are one row each in one task; more than this many are refused.
MAX_SOURCES = 5_000_000
WEIGHTS = (3.0, 1.0, 2.0)


def filled(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of total by weight, none above most times its size; what is cut goes to the others by weight."""
    caps = most * sizes
    if total >= caps.sum():
        return caps
    order = np.argsort(caps / weights, kind="stable")
    c, w = caps[order], weights[order]
    spent, left = np.concatenate([[0.0], np.cumsum(c)[:-1]]), np.cumsum(w[::-1])[::-1]
    level = (total - spent) / left
    first = int(np.argmax(level * w <= c))  # the first in order that keeps below its cap
    out = c.copy()
    out[first:] = level[first] * w[first:]
    back = np.empty_like(out)
    back[order] = out
    return back


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), none above its most; ties go to the earlier place."""
    seats = int(min(seats, most.sum()))
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), most)
    low, high = 0.0, float(votes.max()) * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if given(mid).sum() < seats else (mid, high)
    q = given(high).astype(np.int64)  # at most the seats; ties at the divisor are open
    while (rest := seats - int(q.sum())) > 0:
        quotient = np.where(q < most, votes / (2 * q + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:rest]
        q[best[quotient[best] == quotient[best[0]]]] += 1
    return q


def _targets(sources: DataFrame, weights: Sequence[float], share: float, most: float, block: int, shard: int) -> DataFrame:
    """(source, source_size, target, quota, shards) of (source, source_size)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        names = [None if pd.isna(s) else s.encode() for s in pdf["source"]]
        pdf = pdf.iloc[sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or b""))].reset_index(drop=True)
        size = pdf["source_size"].to_numpy(np.float64)
        w = np.resize(np.array(weights, np.float64), len(pdf))
        target = filled(size, w, share * size.sum(), most)
        quota = sainte_lague(target, round(target.sum() / block), np.floor(most * np.ceil(size / block)))
        shards = np.clip(np.ceil(size / shard), 1, MAX_SHARDS).astype(np.int64)
        return pdf.drop(columns="all").assign(target=target, quota=quota, shards=shards)

    return sources.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "source string, source_size long, target double, quota long, shards long")


def _quotas(shards: DataFrame, most: float, block: int) -> DataFrame:
    """Adds the blocks of each shard (at most MAX_SHARDS a source) to (source, shard, shard_size, quota)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        size = pdf["shard_size"].to_numpy(np.float64)
        return pdf.assign(quota=sainte_lague(size, int(pdf["quota"].iloc[0]), np.floor(most * np.ceil(size / block))))

    return shards.groupBy("source").applyInPandas(run, "source string, shard long, shard_size long, quota long")


def _key(seed: int, id_col: str, text_col: str, source_col: str) -> Column:
    """A seeded hash of what tells rows of the mix apart."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")), F.col(source_col).cast("string"))


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    block: int = BLOCK,
    shard: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, whole (times taken whole), part_from, part_to.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all words; targets stop at
    `most` times a source. The rest of a document is taken once more from word part_from up to part_to (exclusive).
    Null and blank texts have size 0 and are taken 0 times; equal rows lie side by side in the order, each with its
    own words; null ids count as an empty id; other columns of docs aren't looked at; no rows give no rows.
    Reruns and other partitionings give the same sums: rows that tie in the order are equal in id, text and source.
    """
    key = _key(seed, id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"))
    rows = staged(rows, "sizes")
    sources = staged(_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, block, shard), "sources")
    # The list of sources goes to each task if it is small; else the join is shuffled, with the skew handling of the session.
    known = F.broadcast(sources) if sources.limit(100_001).count() <= 100_000 else sources
    rows = rows.withColumnRenamed("source", "s").join(known, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = rows.withColumn("shard", F.pmod(F.shiftright("key", 20), "shards"))
    sizes = rows.groupBy("source", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    quotas = _quotas(sizes, most, block).select(F.col("source").alias("s"), F.col("shard").alias("j"), "shard_size", F.col("quota").alias("q"))
    quotas = staged(quotas, "quotas")
    quotas = F.broadcast(quotas) if quotas.limit(100_001).count() <= 100_000 else quotas
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("j"))).drop("s", "j", "quota")
    line = Window.partitionBy("source", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(line))
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))
    rows = rows.withColumns({"n": n, "whole": F.when(F.col("size") > 0, F.floor(F.col("q") / n)).otherwise(0).cast("int")})
    rows = rows.withColumn("r", F.col("q") - F.floor(F.col("q") / F.col("n")) * F.col("n"))
    # The run starts at a block from which it ends within the line.
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard"), F.lit("start")), F.col("n") - F.col("r") + 1)
    rows = rows.withColumns({"from": start * block, "to": F.least((start + F.col("r")) * block, F.col("shard_size")), "begin": F.col("end") - F.col("size")})
    inside = lambda x: F.least(F.greatest(x - F.col("begin"), F.lit(0)), F.col("size"))
    rows = rows.withColumns({"part_from": inside(F.col("from")), "part_to": inside(F.col("to"))})
    taken = F.col("whole") * F.col("size") + F.col("part_to") - F.col("part_from")
    return rows.select(F.col("id").alias(id_col), "key", "size", "source_size", "target", taken.alias("taken"), "whole", "part_from", "part_to")


def word_range(text: Column, first: Column, last: Column) -> Column:
    """Words first up to last (exclusive) of a text, joined by spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, GAP), lambda w: w != ""), (first + 1).cast("int"), (last - first).cast("int")), " ")


def mixture(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: a row of docs for each time it is taken, with `copy` (from 1) and `taken_words`.

    A document taken in part has the words taken as its text. Rows that repeat (id, text and source) are numbered by
    their other columns, and each is taken as one of them is in the plan, so the mix holds the words of the plan.
    Documents without words are never taken. The columns copy and taken_words of docs, if any, are replaced.
    """
    plan = staged(mixed_documents(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **kw).where("taken > 0"), "plan")
    plan = plan.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("whole").alias("_whole"), F.col("part_from").alias("_from"), F.col("part_to").alias("_to"))
    hashable = [f.name for f in docs.schema.fields if f.name not in ("copy", "taken_words") and "map<" not in f.dataType.simpleString()]
    docs, back = carrying(docs, id_col, text_col, source_col)
    hashable = [F.col(c) if c in docs.columns else F.col(REST)[c] for c in hashable]
    rows = docs.withColumn("_k", _key(seed, id_col, text_col, source_col))
    again = staged(rows.groupBy("_k").count().where("count > 1").select("_k"), "again")
    if again.isEmpty():
        rows = rows.join(plan, F.col("_k") == F.col("_key"))
    else:
        number = Window.partitionBy("_k").orderBy(F.xxhash64(*hashable))
        repeated = rows.join(small(again), "_k", "left_semi").withColumn("_n", F.row_number().over(number))
        place = Window.partitionBy("_key").orderBy("_whole", "_from", "_to")
        numbered = plan.withColumn("_m", F.row_number().over(place))
        once = rows.join(small(again), "_k", "left_anti").join(plan, F.col("_k") == F.col("_key"))
        rows = once.unionByName(repeated.join(numbered, (F.col("_k") == F.col("_key")) & (F.col("_n") == F.col("_m"))).drop("_n", "_m"))
    part = F.col("_to") > F.col("_from")
    times = F.col("_whole") + F.when(part, 1).otherwise(0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    cut = (F.col("copy") > F.col("_whole")) & (F.col("_to") - F.col("_from") < F.col("_size"))
    words = F.when(F.col("copy") > F.col("_whole"), F.col("_to") - F.col("_from")).otherwise(F.col("_size"))
    rows = rows.withColumns({text_col: F.when(cut, word_range(F.col(text_col), F.col("_from"), F.col("_to"))).otherwise(F.col(text_col)), "taken_words": words})
    return back(rows, "copy", "taken_words")
