"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes the rows its predecessor kept. Extra columns of documents pass through; null texts are rejected by
the first stage. Null ids are kept: they link with nothing. Rows that repeat are judged alike. Empty tables give empty
ones. The last stage returns the mix: the columns of documents, `copy` and `taken_words`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import carrying, dropped_since, shared_dir, staged, staged_so_far
from tidemark.llm.decontamination import decontaminated
from tidemark.llm.language_id import identified, learn
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dedup import near_components


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; the rest stay as they are."""
    narrow, back = carrying(docs, "doc_id", "text")
    return back(identified(narrow, learn(docs)).where("not rejected"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three-line windows; texts that are cut to nothing go. n_chars follows the text."""
    narrow, back = carrying(docs, "doc_id", "text", "n_chars")
    out = line_dedup(narrow).where("not (n_removed > 0 and length(trim(text)) = 0)")
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return back(out.withColumn("n_chars", size))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near-duplicates. Rows of one id are one document."""
    gone = staged(near_components(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    return mixture(docs)


STAGES = [("language ID", language_id), ("line dedup", dedup_lines), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]
#: Language identification is learned, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next.

    What a stage staged goes once its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = staged_so_far()
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        dropped_since(before)
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
