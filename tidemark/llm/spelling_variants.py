"""Spelling variants: words one edit apart, grouped under the most frequent.

A word's letters have a bit each; its mask holds the parity of their counts. An inserted or deleted letter flips one bit,
a replaced one two. The bits are dealt to three bands, so words one edit apart agree in a band: equal bands are joined
with equal lengths or lengths one apart, and a pair is verified where it meets. Few band values are common, so their
buckets are split: one edit also leaves the first or the last half of the shorter word as it is, and words meet in a
band only where such a half agrees. This loses no pair. A word has at most some 180 near words a letter, so neither links
nor forms have hubs.

All joins are shuffled by hint. Spark judges a staged table by its compressed files and takes no account of the rows that
explode makes of each, so twelve rows a word would pass for a table below its broadcast threshold and go to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, dropped, staged

#: Runs of letters, and the letters that are left when A-Z are lower case.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
BANDS = 3
_BANDS = ["".join(LETTERS[k::BANDS]) for k in range(BANDS)]


def corpus_words(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of all texts, A-Z in lower case; where `every` divides the CRC-32 of id:word, one letter is left out.

    A null id counts as an empty one. Counts are added up before they are shuffled.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _parity(letters: Column, of: str) -> Column:
    bits = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(of), c) - 1))
    return F.aggregate(bits, F.lit(0), lambda mask, bit: mask.bitwiseXOR(bit))


def banded(words: DataFrame) -> DataFrame:
    """words with len and the parities b0..b2 of each band's letters."""
    other = lambda of: "".join(c for c in LETTERS if c not in of)
    return words.withColumns({"len": F.length("word")} | {f"b{k}": _parity(F.translate("word", other(of), ""), of) for k, of in enumerate(_BANDS)})


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words (word, n) that one inserted, deleted or replaced letter tells apart, once.

    words must be distinct and of letters of LETTERS; a is the shorter. A pair counts at the first band and half that it shares.
    """
    words = staged(banded(words), "banded")
    masks = [f"b{k}" for k in range(BANDS)]

    def side(s: str, lengths: Column) -> DataFrame:
        """A row for each length that the shorter word may have, each band and each half."""
        of = words.select("word", "n", "len", *masks, F.explode(lengths).alias("short"))
        cut = F.floor(F.col("short") / 2).cast("int")
        half = F.array(F.struct(F.lit(0).alias("h"), F.substring("word", F.lit(1), cut).alias("part")), F.struct(F.lit(1).alias("h"), F.substring("word", F.col("len") - F.col("short") + cut + 1, F.col("short") - cut).alias("part")))
        of = of.select("*", F.inline(half))
        bands = F.array(*(F.struct(F.lit(k).alias("k"), F.col(m).alias("band")) for k, m in enumerate(masks)))
        return of.select(F.col("word").alias(s), F.col("n").alias(f"n_{s}"), F.col("len").alias(f"len_{s}"), *(F.col(m).alias(f"{m}_{s}") for m in masks), "short", "h", "part", F.inline(bands))

    # The shorter word, and words of its length or one more.
    left = side("a", F.array("len"))
    right = side("b", F.array(F.col("len"), F.col("len") - 1))
    met = left.join(right.hint("merge"), ["short", "h", "part", "k", "band"])
    flipped = sum(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in masks)
    met = met.where(F.when(F.col("len_a") == F.col("len_b"), (flipped == 2) & (F.col("a") < F.col("b"))).otherwise(flipped == 1))
    for k in range(BANDS - 1):
        met = met.where((F.col("k") <= k) | (F.col(f"b{k}_a") != F.col(f"b{k}_b")))
    cut = F.floor(F.col("short") / 2).cast("int")
    met = met.where((F.col("h") == 0) | (F.substring("a", F.lit(1), cut) != F.substring("b", F.lit(1), cut)))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form): forms followed to the last, by doubling the step.

    A form has twice the count of its word, so chains are as long as the logarithm of the largest count and the
    rounds as the logarithm of that.
    """
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = staged(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        dropped(at)
        at = step.select("word", "root")
        at._staged_path = step._staged_path
        if step.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have least_length letters and least_count occurrences. form: the near word of the largest count (ties: the
    first in code-point order), if that is at least twice the word's own; else null, as is form_n. root: the last of
    the forms from the word on, itself if it has none. n_near: how many words are near. Null and empty texts have no words;
    repeated rows count each time; other columns are not looked at; without words there are no rows.
    """
    words = staged(corpus_words(docs, every, id_col, text_col).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    pairs = staged(near_words(words), "near")
    both = pairs.union(pairs.select(F.col("b"), "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("c"), F.col("b").alias("w"))).alias("best"))
    all_ = words.join(best.hint("merge"), "word", "left").withColumn("has", F.coalesce(-F.col("best.c") >= 2 * F.col("n"), F.lit(False)))
    named = staged(all_.select("word", F.when(F.col("has"), F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("best.c")).alias("form_n")), "forms")
    dropped(pairs)
    dropped(words)
    last = roots(named.where("form is not null"))
    return named.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
