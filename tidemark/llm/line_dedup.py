"""Line dedup over overlapping windows of consecutive lines, with DataFrame functions only.

Each run of `size` lines is hashed to 128 bits. Windows found again later (by id, text and position) are covered; lines
that covered windows hold are removed. A line seen for the first time in the corpus is in no later window, so no
content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carrying, join_hot, staged


def lines_of(text: Column) -> Column:
    """Lines in order, without their ends; null gives none and the empty text one empty line."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def windows(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, at, w1, w2): the hashes of each window with a line that isn't blank; at counts lines from 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rid"), lines_of(F.col(text_col)).alias("l"))
    rows = rows.where(F.size("l") >= size).select("id", "rid", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), (F.trim(x) != "").alias("b"))).alias("h"))
    flat = rows.select("id", "rid", F.posexplode(F.arrays_zip(*(F.slice("h", F.lit(k + 1), F.size("h") - (size - 1)).alias(f"h{k}") for k in range(size)))).alias("at", "w"))
    part = lambda f: [F.col(f"w.h{k}.{f}") for k in range(size)]
    full = part("b")[0]
    for b in part("b")[1:]:
        full = full | b
    return flat.where(full).select("id", "rid", "at", F.xxhash64(*part("h")).alias("w1"), F.xxhash64(*part("g")).alias("w2"))


def later_windows(found: DataFrame) -> DataFrame:
    """(id, rid, at) of the windows that an earlier one equals. found is read more than once."""
    place = F.struct("id", "rid", "at")
    again = staged(found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1"), "again")
    late = join_hot(found, again, ["w1", "w2"], "m").drop("m")
    # Copies of a row (same id and text) share one place, so the first stays in each.
    return late.where(~F.struct("id", "rid", "at").eqNullSafe(F.col("first"))).select("id", "rid", "at")


def merged(at: Column, size: int) -> Column:
    """Sorted window positions as the runs array<struct<s, e>> of lines they cover, ends exclusive, in time linear in their number."""
    begins = F.filter(at, lambda p, k: (k == 0) | (p > F.get(at, k - 1) + size))
    ends = F.filter(at, lambda p, k: (k == F.size(at) - 1) | (F.get(at, k + 1) > p + size))
    zipped = F.arrays_zip(begins.alias("s"), ends.alias("e"))
    return F.transform(zipped, lambda r: F.struct(r["s"].cast("int").alias("s"), (r["e"] + size).cast("int").alias("e")))


def line_dedup(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rid of repeated windows, and n_lines, removed (runs of lines) and n_removed added.

    Null texts stay null with 0 lines; texts of fewer than `size` lines stay as they are; windows of blank lines alone
    don't count. Rows that repeat (id and text) are edited alike; null ids come first in the order. A text whose lines
    all go becomes empty. The columns n_lines, removed and n_removed of docs, if any, are replaced. No rows give none.
    """
    docs, back = carrying(docs, id_col, text_col)
    found = staged(windows(docs, size, id_col, text_col), "windows")
    late = later_windows(found).groupBy(F.col("id").alias("_id"), F.col("rid").alias("_rid")).agg(F.array_sort(F.collect_set("at")).alias("_at"))
    runs = late.select("_id", "_rid", merged(F.col("_at"), size).alias("_runs"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    out = docs.withColumn("_h", F.xxhash64(text_col)).join(runs, (F.col("_h") == F.col("_rid")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    out = out.withColumns({"_l": lines_of(F.col(text_col)), "removed": F.coalesce("_runs", none)})
    ends = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["e"]))
    starts = F.concat(F.transform("removed", lambda r: r["s"]), F.array(F.size("_l")))
    kept = F.flatten(F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda g: F.slice("_l", g["e"] + 1, F.greatest(g["s"] - g["e"], F.lit(0)))))
    size_of = F.aggregate("removed", F.lit(0), lambda n, r: n + r["e"] - r["s"])
    out = out.withColumns({"n_lines": F.size("_l"), "n_removed": size_of, "_kept": kept})
    text = F.when(F.size("removed") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text_col))
    return back(out.withColumn(text_col, text), "n_lines", "removed", "n_removed")
