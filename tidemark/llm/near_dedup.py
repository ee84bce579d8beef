"""MinHash near-duplicate detection with odd sketches.

Each text becomes a set of word shingles, the set a MinHash sample, the sample two things: bands, whose equal
values make candidates, and an odd sketch (a bitmap of parities), whose XOR population count estimates the
similarity of a candidate pair closely enough to drop most false ones. What is left is confirmed on full sets.

Groups never become all pairs. Texts of equal sets are one node. Within a bucket of equal bands every node first meets
one pivot, and what those links join is one component. In buckets that still hold several components, the nodes outside
the largest meet all others inside the join, in blocks: only pairs of likely sizes and sketches, each at the first bucket
it shares, leave the join. A bucket of m nodes of which k stand outside costs k * m comparisons, and m alone where k is
bounded. No bucket is capped, and no pair that shares a bucket is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MANY_LONGS, dropped, join_hot, small, staged, swept
from tidemark.llm.graph import components

#: Bands of a text, and values of its MinHash sample; bands take as many values as MISSED allows (see band_rows).
BANDS, SAMPLES = 40, 768
#: The chance at most that a pair just at the threshold shares no band.
MISSED = 1e-4
#: Bits of an odd sketch. Pairs whose estimate is under the threshold by more than ERRORS standard errors go unread.
BITS, ERRORS = 1536, 4.0
#: Members of a bucket that one block of a comparison takes at most (on average).
BLOCK = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: list[bytes], n: int, memo: WordHashes) -> np.ndarray:
    """Hash of each n-word shingle in order; fewer words make one shingle of all, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + h[k : k + len(out)] + np.uint64(k + 1))
    return out


def text_words(text: str | None) -> list[bytes]:
    """Words of the whole text with A-Z in lower case (bytes.lower and bytes.split know ASCII alone)."""
    return text.encode().lower().split() if text else []


def band_rows(similarity: float, bands: int = BANDS, missed: float = MISSED) -> int:
    """The most MinHash values a band may take so that a pair of this similarity shares one of the bands but for a chance of `missed`."""
    return max(1, math.floor(math.log(1 - missed ** (1 / bands)) / math.log(similarity) + 1e-9))


class Sketcher:
    """MinHash sample, band values and odd sketch of a set of 64-bit hashes."""

    def __init__(self, bands: int, rows: int, samples: int = SAMPLES, bits: int = BITS, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, self.k = bands, rows, bits, max(samples, bands * rows)
        self.mul = rng.integers(0, 2**32, self.k, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, self.k, dtype=np.uint32)
        self.salt = rng.integers(0, 2**63, self.k, dtype=np.uint64)

    def sample(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.k, 2**32 - 1, np.uint32)
        x = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 256):  # bounded memory however long the text
            part = x[at : at + 256, None] * self.mul
            part += self.add
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def band_values(self, low: np.ndarray) -> np.ndarray:
        """A value a band, different from those of other bands."""
        wide = low[: self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = mixed(out * _MIX + wide[:, r] + np.uint64(r + 1))
        return out.view(np.int64)

    def odd(self, low: np.ndarray) -> np.ndarray:
        bit = mixed(low.astype(np.uint64) + self.salt) % np.uint64(self.bits)
        return np.packbits((np.bincount(bit.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)).view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int, **kw) -> DataFrame:
    """(id, n_shingles, set_key, bands, odd): set_key is a 128-bit hash of the full set, null with bands and odd for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, sketch = WordHashes(), Sketcher(**kw)
        for pdf in batches:
            sizes, keys, bands, odds = [], [], [], []
            for text in pdf["text"]:
                grams = np.unique(gram_hashes(text_words(text), words, memo))
                sizes.append(len(grams))
                low = sketch.sample(grams) if len(grams) else None
                keys.append(set_key(grams))
                bands.append(None if low is None else sketch.band_values(low))
                odds.append(None if low is None else sketch.odd(low))
            yield pd.DataFrame({"id": pdf["id"], "n_shingles": sizes, "set_key": keys, "bands": bands, "odd": odds})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_shingles long, set_key string, bands array<long>, odd array<long>")


def set_key(grams: np.ndarray) -> str | None:
    """A 128-bit name of a sorted set of hashes; None for the empty set."""
    return xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else None


def gram_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, grams): the full sorted set of shingle hashes of each text, named by its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                sets = [np.unique(gram_hashes(text_words(t), words, memo)) for t in pdf["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"node": [set_key(s) for s in sets], "grams": [s.view(np.int64) for s in sets]})

    return texts.select("text").mapInPandas(run, "node string, grams array<long>")


def standard_error(similarity: float, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Of the Jaccard estimate: that of the sample, and that of folding it (odd bins of u elements in n) at this similarity."""
    u = 2 * samples * (1 - similarity)
    left = math.exp(-2 * u / bits)
    folded = max(0.0, bits * (1 - left * left) / 4 - u * left * left) / (2 * samples * left) ** 2
    return math.sqrt(similarity * (1 - similarity) / samples + folded)


def most_bits(similarity: float, samples: int = SAMPLES, bits: int = BITS, errors: float = ERRORS) -> int:
    """The bits that odd sketches may differ in, n/2 (1 - (1 - 2/n)^(2k(1 - J))) at a similarity so many standard errors below this."""
    least = max(0.0, similarity - errors * standard_error(similarity, samples, bits))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - least))))


def alike(n_a: Column, n_b: Column, odd_a: list[Column], odd_b: list[Column], percent: int, most: int) -> Column:
    """Whether sizes allow the similarity and the sketches differ in no more bits than `most`."""
    apart = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in zip(odd_a, odd_b, strict=True))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (apart <= most)


def _confirmed(likely: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b, n_a, n_b and others) of likely whose full sets (node, grams) reach the similarity."""
    full = likely.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("g_a")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("g_b")), "b")
    both = full.withColumn("i", F.size(F.array_intersect("g_a", "g_b")))
    both = both.where(F.col("i") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("i")) * percent)
    return staged(both.drop("i", "g_a", "g_b"), "links")


def _ends(likely: DataFrame) -> DataFrame:
    return likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()


def similar_components(banded: DataFrame, signs_of, sets, percent: int, words: int = BITS // 64, samples: int = SAMPLES, errors: float = ERRORS, block: int = BLOCK) -> DataFrame:
    """(node, component) of the nodes that links join: pairs that share a band and whose full sets reach the similarity.

    banded: (node, bands), read twice; a node may repeat. signs_of: nodes (node) -> (node, n_shingles, bands, odd), a row a
    node, odd of `words` longs. sets: nodes (node) -> (node, grams), or None where signs_of gives grams itself. Where a bucket holds nodes of several components,
    those outside the largest are compared with all others, in a few machine operations a pair. Without `sets`, for sets of some tens
    of shingles, the sets themselves go into that comparison, and links leave it; else likely pairs do.
    """
    most = most_bits(percent / 100, samples, words * 64, errors)
    rows = banded.select("node", F.posexplode("bands").alias("band", "value"))
    # Values are counted by themselves first: a few machine words a row, added up in memory, and most values stand alone.
    # A hash of the node tells whether there are several, however often one repeats.
    of = rows.select("value", F.hash("node").alias("h")).groupBy("value").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = staged(of.where("lo <> hi").select("value"), "shared")
    del of
    swept(banded.sparkSession)
    buckets = staged(rows.join(small(shared, MANY_LONGS), "value").distinct(), "buckets")
    dropped(shared)
    signs = signs_of(small(staged(buckets.select("node").distinct(), "bucketed"), MANY_LONGS))
    short = sets is None
    signs = staged(signs.select("node", "n_shingles", "bands", *(["grams"] if short else []), *(F.get("odd", F.lit(k)).alias(f"o{k}") for k in range(words))), "signs")
    swept(banded.sparkSession)
    odd = lambda s: [F.col(f"o{k}_{s}") for k in range(words)]
    side = lambda df, s, *more: df.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), *(F.col(f"o{k}").alias(f"o{k}_{s}") for k in range(words)), *more)

    pivots = buckets.groupBy("value").agg(F.min("node").alias("pivot"))
    pairs = buckets.join(pivots, "value").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    likely = pairs.join(side(signs, "a"), "a").join(side(signs, "b"), "b").where(alike(F.col("n_a"), F.col("n_b"), odd("a"), odd("b"), percent, most))
    likely = staged(likely.select("a", "b", "n_a", "n_b"), "likely")
    grams = signs.select("node", "grams") if short else sets(_ends(likely))
    links = _confirmed(likely, grams, percent)
    dropped(likely)
    label = staged(components(links), "label")
    dropped(links)

    at = buckets.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    at = staged(at, "at")
    # In a bucket, what stands outside its largest component meets all of it; the largest is one component already.
    per = at.groupBy("value", "c").agg(F.count("*").alias("m")).groupBy("value").agg(F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top"))
    open_ = per.where(F.col("m") > F.col("top.m")).select("value", F.col("top.c").alias("main"), F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("top.m")) / block).cast("int").alias("odd_blocks"))
    rest = at.join(small(staged(open_, "open")), "value").join(signs, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rest = rest.withColumns({"own": own("blocks"), "odd_own": own("odd_blocks"), "stranger": F.col("c") != F.col("main"), "before": F.slice("bands", F.lit(1), F.col("band"))})
    rest = staged(rest.drop("bands", "main"), "rest")
    for x in (buckets, at):
        dropped(x)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Sets that have been made once are not made again."""
        nodes = staged(nodes, "ends")
        missing = staged(nodes.join(grams.select("node"), "node", "left_anti"), "missing")
        return grams.join(small(nodes), "node", "left_semi").unionByName(sets(missing))

    extra = ["grams"] if short else []
    # Every block of strangers meets every block of the bucket.
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = side(rest.where("stranger").withColumn("j", upto("blocks")), "a", "value", F.col("odd_own").alias("i"), "j", F.col("c").alias("c_a"), F.col("before").alias("before_a"), *(F.col(x).alias(f"{x}_a") for x in extra))
    right = side(rest.withColumn("i", upto("odd_blocks")), "b", "value", "i", F.col("own").alias("j"), F.col("c").alias("c_b"), "stranger", F.col("before").alias("before_b"), *(F.col(x).alias(f"{x}_b") for x in extra))
    first = ~F.arrays_overlap("before_a", "before_b")  # a pair counts at the first band it shares
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("value", "i", "j")]
    once = (~F.col("stranger") | (F.col("a") < F.col("b"))) & (F.col("c_a") != F.col("c_b"))
    likely = once & alike(F.col("n_a"), F.col("n_b"), odd("a"), odd("b"), percent, most) & first
    if short:
        both = F.size(F.array_intersect("grams_a", "grams_b"))
        met = l.join(r, same[0] & same[1] & same[2] & likely & (both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent))
        links = staged(met.select("a", "b", "c_a", "c_b"), "links")
    else:
        met = staged(l.join(r, same[0] & same[1] & same[2] & likely).select("a", "b", "n_a", "n_b", "c_a", "c_b"), "likely")
        links = _confirmed(met, sets_of(_ends(met)), percent)
        dropped(met)
    for x in (rest, signs, grams):
        dropped(x)
    # Labels that later links join: the components of components.
    joined = staged(components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))), "joined")
    again = label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    alone = joined.join(label.select("node"), "node", "left_anti").select("node", "component")
    dropped(links)
    return again.union(alone)


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links), kept.

    Documents link where 100 * intersection >= percent * union of their shingle sets; ids that repeat are one node.
    Null, empty and blank texts have no shingles and link with nothing. A null id links with nothing and is kept,
    with a null component. Other columns of docs are not looked at. No rows give no rows.
    """
    signed = staged(sketched(docs, id_col, text_col, words, bands=BANDS, rows=band_rows(percent / 100)), "sketched")
    classes = signed.where("id is not null and set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = staged(classes, "classes")
    # An id that repeats with other texts stands for several sets; each set keeps its own sketch under its key.
    reps = signed.join(classes.select("set_key", F.col("rep").alias("id")), ["set_key", "id"]).select(F.col("set_key").alias("node"), "id", "n_shingles", "bands", "odd")
    repeats = not signed.groupBy("id").count().where("count > 1").isEmpty()
    reps = staged(reps.dropDuplicates(["node"]) if repeats else reps, "reps")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = small(staged(nodes.join(reps.select("node", "id"), "node"), "wanted"))
        found = gram_sets(texts.join(wanted, "id", "left_semi"), words)
        if repeats:  # the same row twice, or an id with other texts
            found = found.join(wanted, "node", "left_semi").dropDuplicates(["node"])
        return staged(found, "grams")

    sketches = reps.select("node", "n_shingles", "bands", "odd")
    label = staged(similar_components(sketches.select("node", "bands"), lambda nodes: sketches.join(nodes, "node", "left_semi"), sets, percent), "labels")
    dropped(reps)
    # The ids of linked sets: the least of a component stands for it. Ids that stand for several sets join those too.
    named = classes.join(label.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("c", F.coalesce("component", "set_key"))
    named = named.join(named.groupBy("c").agg(F.min("rep").alias("least")), "c").select("set_key", "least", "m")
    named = staged(named, "named")
    member = join_hot(signed.where("id is not null").select("id", "n_shingles", "set_key"), named, ["set_key"], "m").select("id", "n_shingles", F.col("least").alias("component_id"))
    if repeats:
        ends = staged(member.select(F.col("id").alias("a"), F.col("component_id").alias("b")).distinct(), "ends")
        over = components(ends)
        member = member.join(over, F.col("id") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    alone = signed.where("id is null or set_key is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    if repeats:  # an empty text under an id that other texts link
        alone = alone.join(over, F.col("id") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = member.union(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id").withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
