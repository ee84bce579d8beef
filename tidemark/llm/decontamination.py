"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Items are partitioned by the size of their shingle sets (powers of two). The MinHash sample of an item holds its
shingles of least seeded hash, as many as its partition needs: a document with a share of `threshold` of the item's
shingles misses at most n - ceil(threshold * n), so one more sampled shingle than that is never missed as a whole.
Documents, however long, are looked up in the samples; candidates are verified on the exact shingles of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carrying, small, staged

SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def hashed_shingles(rows: DataFrame, words: int) -> DataFrame:
    """rows (with array w) with a row for each place of a shingle and its hash h; repeats stay.

    Fewer words make one shingle of all, none make none. A shingle's hash is that of its words' hashes.
    """
    # explode_outer, as the filter that explode implies would be pushed down and make the words a second time.
    of = rows.withColumn("g", F.transform("w", lambda x: F.xxhash64(x)))
    at = of.withColumn("i", F.explode_outer(F.when(F.size("g") > 0, F.sequence(F.lit(0), F.greatest(F.size("g") - words, F.lit(0))))))
    return at.where("i is not null").withColumn("h", F.xxhash64(*(F.get("g", F.col("i") + k) for k in range(words)))).drop("w", "g", "i")


def spelled_shingles(rows: DataFrame, words: int) -> DataFrame:
    """rows (with array w) with the array s of distinct shingles, spelled out, and their number n."""
    places = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))))
    sets = rows.withColumn("s", F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("w", i, F.lit(words)), " "))))
    return sets.withColumn("n", F.size("s")).withColumn("s", F.explode_outer("s")).where("s is not null").drop("w")


def item_shingles(benchmark: DataFrame, words: int, item_col: str, text_col: str) -> DataFrame:
    """(item, version, n, s): a row for each distinct shingle of each item; version tells texts of one id apart."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(text_col).alias("version"), tokens(F.col(text_col)).alias("w")).dropDuplicates(["item", "version"])
    return spelled_shingles(rows, words).select("item", "version", "n", "s")


def minhash_samples(shingles: DataFrame, words: int, threshold: float, seed: int = 17) -> DataFrame:
    """(h, item, version, need): the sampled shingles of each item, by size partition; need is the least overlap."""
    need = lambda n: F.ceil(n * threshold - 1e-9)
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    w = F.split("s", " ")
    h = F.xxhash64(*(F.when(F.size(w) > k, F.xxhash64(F.get(w, F.lit(k)))) for k in range(words)))
    packed = shingles.groupBy("item", "version", "n").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "s").alias("o"), h.alias("h")))).alias("all"))
    take = (largest - need(largest) + 1).cast("int")
    return packed.select(F.explode(F.slice("all", F.lit(1), take)).alias("x"), "item", "version", need(F.col("n")).alias("need")).select("x.h", "item", "version", "need")


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, rid, item, n_shingles, n_shared, containment) of documents that hold `threshold` of an item's shingles.

    rid is the hash of the text, which tells rows of one id apart; repeated rows give one. Null, empty and wordless
    texts and items match nothing; fewer than `words` words match only as a whole text of as few. Items of one id with
    different texts count separately, the fuller match is returned. No rows on either side give none; other columns
    aren't looked at. The samples are broadcast only up to a counted size.
    """
    shingles = staged(item_shingles(benchmark, words, item_col, item_text_col), "items")
    samples = small(staged(minhash_samples(shingles, words, threshold), "samples"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"))
    sized = rows.select("id", "rid", tokens(F.col("text")).alias("w")).withColumn("m", F.greatest(F.size("w") - (words - 1), F.lit(1)))
    looked = hashed_shingles(sized, words).join(samples, "h").where(F.col("m") >= F.col("need"))
    candidates = staged(looked.select("id", "rid", "item", "version").distinct(), "candidates")
    wanted = small(staged(candidates.select(F.col("id").alias("i"), F.col("rid").alias("r")).distinct(), "wanted"))
    read = rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("rid") == F.col("r")), "left_semi")
    spelled = spelled_shingles(read.select("id", "rid", tokens(F.col("text")).alias("w")), words).select("id", "rid", "s")
    shared = spelled.join(small(shingles), "s").groupBy("id", "rid", "item", "version", "n").agg(F.count_distinct("s").alias("k"))
    found = shared.where(F.col("k") >= F.ceil(F.col("n") * threshold - 1e-9))
    same = [F.col(f"found.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("id", "rid", "item", "version")]
    sure = found.alias("found").join(candidates.alias("c"), same[0] & same[1] & same[2] & same[3], "left_semi")
    best = sure.groupBy("id", "rid", "item").agg(F.max(F.struct((F.col("k") / F.col("n")).alias("c"), "n", "k")).alias("x"))
    return best.select("id", "rid", "item", F.col("x.n").cast("long").alias("n_shingles"), F.col("x.k").cast("long").alias("n_shared"), F.col("x.c").alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they are."""
    docs, back = carrying(docs, id_col, text_col)
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **kw).select(F.col("id").alias("_id"), F.col("rid").alias("_rid")).distinct()
    found = small(staged(found, "leaks"))
    return back(docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_rid")), "left_anti"))
