"""Language identification by nearest centroid over TF-IDF weighted character n-grams.

A text becomes a vector of hashed character n-grams (1 to 3 characters of its letters, words padded by a space),
1 + ln(count) times the inverse document frequency, normalised. Each language has several centroids, found by
spherical k-means in a bounded sample of its labelled texts; a text gets the language of the centroid with the highest
cosine. It is rejected where that cosine is far below those of the labelled texts, all of them, that got the same language
and have about its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carrying, staged

DIM = 4096
#: Labelled texts sampled for the centroids of a language (in expectation; by a hash of the text), and centroids.
PER_LANG, CENTROIDS = 800, 4
#: More labels than this are refused with an error: the model holds LANGS * CENTROIDS * DIM numbers at most.
LANGS = 2000
#: A text is rejected as far below the LOW quantile of the cosines of its class as that lies below their median (MARGIN at
#: least). Classes of fewer than ENOUGH distinct texts are pooled with their neighbours. Cosines are counted in BINS.
LOW, MARGIN, ENOUGH, BINS = 0.01, 0.05, 1000, 1000
LEVELS = 32
UNKNOWN = "und"
_CHUNK = 1 << 16


#: Runs of anything but letters (Unicode categories L): digits, fractions, Roman and ringed numbers, signs, marks.
_OTHER = regex.compile(r"\P{L}+")


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of anything but letters one space, a space at both ends."""
    runs = f" {_OTHER.sub(' ', text.lower()).strip(' ')} "
    return np.frombuffer(runs.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_counts(text: str | None, dim: int = DIM) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the whole text (dim is a power of two), all 0 without a letter.

    Long texts are hashed in pieces. Letters are the characters of the Unicode categories L.
    """
    out = np.zeros(dim, np.int64)
    code = _letters(text) if text else np.empty(0, np.uint32)
    if len(code) <= 2:
        return out
    for at in range(0, len(code), _CHUNK):
        c = code[at : at + _CHUNK + 2]
        last = min(_CHUNK, len(c))
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c[2:]
        grams = np.concatenate([one[:last], (two * np.uint32(0x27D4EB2F))[:last], (three * np.uint32(0x165667B1))[:last]])
        out += np.bincount((grams >> np.uint32(9)) & np.uint32(dim - 1), minlength=dim)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of rows of counts; a row of zeros stays so."""
    x = counts.astype(np.float32)
    np.log(x, out=x, where=x > 0)
    x += counts > 0
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _level(counts: np.ndarray) -> np.ndarray:
    """The length class of rows of counts: log2 of the n-grams."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64), LEVELS - 1)


def _k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[[int(rng.integers(len(x)))]]
    while len(centre) < min(k, len(x)):  # the next is the one least like those so far
        centre = np.vstack([centre, x[[int(np.argmin((x @ centre.T).max(axis=1)))]]])
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centre.astype(np.float32)


@dataclass
class LanguageModel:
    """Inverse document frequencies, centroids with their languages, and the lowest cosine accepted by centroid and length class."""

    idf: np.ndarray
    langs: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, LEVELS)))

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: whether it has no n-gram, its length class, its nearest centroid and the cosine."""
        counts = np.stack([ngram_counts(t, len(self.idf)) for t in texts])
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        return counts.sum(axis=1) == 0, _level(counts), best, np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True})
        none, level, best, score = self.nearest(texts)
        pred = np.where(none, UNKNOWN, np.array(self.langs, dtype=object)[best])
        return pd.DataFrame({"lang_pred": pred, "score": np.where(none, 0.0, score), "rejected": none | (score < self.least[best, level])})


def _bound(counts: np.ndarray) -> float:
    """The lowest cosine accepted beside texts whose cosines have these counts by bin."""
    upto = np.cumsum(counts)
    low, mid = (int(np.searchsorted(upto, max(1, share * upto[-1]))) / BINS for share in (LOW, 0.5))
    return max(0.0, low - max(mid - low, MARGIN))


def _pooled(counts: np.ndarray, level: int, enough: int) -> np.ndarray:
    """Counts of the level and so many levels on both sides that there are enough, or of all."""
    for reach in range(LEVELS):
        pool = counts[max(0, level - reach) : level + reach + 1].sum(axis=0)
        if pool.sum() >= enough:
            break
    return pool


def least_cosines(counts: np.ndarray, every: np.ndarray, enough: int = ENOUGH) -> np.ndarray:
    """The lowest cosine accepted by length class, of a language's counts by class and bin and those of all languages.

    Languages of fewer than enough texts are pooled with all others. A class with few texts is judged no harder than its
    own ones allow, and nothing is held against texts shorter than any that was learned.
    """
    out, seen = np.zeros(LEVELS), np.flatnonzero(counts.sum(axis=1))
    wide = counts if counts.sum() >= enough else every
    for level in range(seen[0] if len(seen) else LEVELS, LEVELS):
        own = counts[level]
        out[level] = _bound(_pooled(wide, level, enough))
        if 0 < own.sum() < enough:
            out[level] = min(out[level], _bound(own))
    return out


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, k: int = CENTROIDS, dim: int = DIM) -> LanguageModel:
    """The model of rows with text and lang; rows where either is null teach nothing, and no rows give an empty model.

    Document frequencies count all rows. Centroids come from distinct texts of which a hash keeps per_lang a language
    in expectation, so that copies and frequent languages weigh no more than others. The lowest cosines accepted come from
    all distinct texts. The driver holds the model and counts of cosines by language, length class and bin.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(dim, np.int64)
        total = 0
        for pdf in batches:
            for t in pdf["text"]:
                seen += ngram_counts(t, dim) > 0
            total += len(pdf)
        yield pd.DataFrame({"k": np.arange(dim + 1), "n": np.append(seen, total)})

    found = rows.select("text").mapInPandas(counted, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dim + 1)
    df[found["k"]] = found["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    langs = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("m"))
    langs = staged(langs, "langs")
    if langs.count() > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    span = 1 << 40
    chosen = rows.join(F.broadcast(langs), "lang").where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(span)) < F.lit(float(span) * per_lang) / F.col("m"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at : at + 128]
                counts = np.stack([ngram_counts(t, dim) for t in part["text"]])
                use = counts.sum(axis=1) > 0
                if use.any():
                    yield pd.DataFrame({"lang": part["lang"][use], "h": part["h"][use], "x": list(weighted(counts[use], idf))})

    # Vectors of a fixed size, not texts, are grouped by language: about per_lang * dim numbers a group.
    sample = chosen.select("lang", F.xxhash64("text").alias("h"), "text").mapInPandas(vectors, "lang string, h long, x array<float>")

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.drop_duplicates("h").sort_values("h")["x"])
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(_k_means(x, k))})

    got = sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>").toPandas()
    if got.empty:
        return LanguageModel(idf)
    got = got.assign(c=[tuple(c) for c in got["centroid"]]).sort_values(["lang", "c"])
    model = LanguageModel(idf, list(got["lang"]), np.stack(got["centroid"]).astype(np.float32))

    names = sorted(set(model.langs))
    shared = labelled.sparkSession.sparkContext.broadcast((model, np.array([names.index(c) for c in model.langs])))

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, lang = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at : at + 128]
                none, level, best, score = m.nearest(list(part["text"]))
                yield pd.DataFrame({"h": part["h"].to_numpy(), "lang": lang[best], "level": level, "bin": np.minimum(score * BINS, BINS - 1).astype(int)})[~none]

    each = rows.select(F.xxhash64("text").alias("h"), "text").mapInPandas(cosines, "h long, lang int, level int, bin int")
    # Equal texts have equal cosines up to rounding, so one row of each is counted.
    spread = each.groupBy("h").agg(F.min(F.struct("lang", "level", "bin")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).select("x.*", "n").toPandas()
    every = np.zeros((LEVELS, BINS), np.int64)
    np.add.at(every, (spread["level"], spread["bin"]), spread["n"])
    by_lang = dict(list(spread.groupby("lang")))
    model.least = np.zeros((len(model.langs), LEVELS))
    for k, name in enumerate(names):
        counts = np.zeros((LEVELS, BINS), np.int64)
        if k in by_lang:
            np.add.at(counts, (by_lang[k]["level"], by_lang[k]["bin"]), by_lang[k]["n"])
        model.least[[c == name for c in model.langs]] = least_cosines(counts, every)
    return model


def identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language; `und` for null texts and texts without a letter), score and rejected.

    Equal texts get equal predictions; the columns lang_pred, score and rejected of docs, if any, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [shared.value.predict([t if isinstance(t, str) else None for t in texts.iloc[at : at + 128]]) for at in range(0, len(texts), 128)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    docs, back = carrying(docs, text_col)
    out = docs.withColumn("_p", predict(F.col(text_col)))
    named = ("lang_pred", "score", "rejected")
    return back(out.withColumns({c: F.col(f"_p.{c}") for c in named}), *named)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
