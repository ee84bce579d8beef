"""Helpers shared by the corpus operators: staged tables, checked broadcasts, words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A side of at most this many rows of a few machine words each (some 30 MB) may be broadcast.
BROADCAST_ROWS = 400_000
#: The same for rows of one or two longs (some 100 MB).
MANY_LONGS = 1_500_000

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's; on a local master alone else one set here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged frame that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path and _written.pop(path, None):
        _delete(df.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Let the driver forget finished plans, so that the cleaner removes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged_so_far() -> set[str]:
    """The staged tables that stand, to tell later ones from."""
    return set(_written)


def dropped_since(before: set[str]) -> None:
    """Delete what was staged after `before` was taken, once its readers have run."""
    for path in set(_written) - before:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most limit rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: The column that holds the caller's other columns while an operator works.
REST = "__tidemark_rest"


def carrying(docs: DataFrame, *own: str):
    """docs with an operator's own columns and all others as one struct, and the way back.

    Whatever the caller's columns are called, none meets an operator's internal names. back(out, *added) gives the columns of
    docs in their order, own ones from out, and then added ones, which replace columns of the same name.
    """
    own = tuple(dict.fromkeys(own))
    rest = [c for c in docs.columns if c not in own]
    narrow = docs.select(*(F.col(f"`{c}`") for c in own), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias(REST)] if rest else []))

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*((F.col(f"`{c}`") if c in own else F.col(REST)[c].alias(c)) for c in docs.columns if c not in added), *added)

    return narrow, back


def join_hot(rows: DataFrame, counted: DataFrame, keys: list[str], count_col: str, share: float = 1e-5, least: int = 1000) -> DataFrame:
    """Inner join of rows with counted, which has a row for each key and in count_col how many of rows have it.

    Keys of more than `share` of all those rows (at most 1 / share keys, so a bounded table) are broadcast: a key of a
    third of all rows never meets in one task. counted is read several times.
    """
    total = counted.agg(F.sum(count_col)).first()[0] or 0
    hot = F.col(count_col) > max(least, int(total * share))
    heavy, light = F.broadcast(counted.where(hot)), counted.where(~hot)
    return rows.join(heavy, keys).unionByName(rows.join(F.broadcast(counted.where(hot).select(*keys)), keys, "left_anti").join(light, keys))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z alone to lower case, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_list(text: Column) -> Column:
    """The words in order; null or blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
