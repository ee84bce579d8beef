"""Quality of documents by attention over their passages.

A document is a bag of passages that shares one label. Every passage is encoded (byte and byte-pair histograms and
measures of its words, through a learned layer), a gated attention learned from the labels of documents alone weighs the
passages, and the weighted sum of the encodings is scored. Junk that fills a part of a text thus counts by that part's
passages, which nobody labelled.

The model is learned from a bounded sample: at most PER_CLASS documents a class, of at most LONGEST passages each.
Everything is scored, every text whole, in blocks of passages whose attention is added up as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a passage, which ends at the next blank within as many again as SLACK, else there.
PASSAGE, SLACK = 600, 200
#: Labelled documents a class that the model is learned from, and the passages that such a document may have.
PER_CLASS, LONGEST = 3000, 48
#: Buckets of byte pairs; measures of words; sizes of the encoding and of the attention.
PAIRS, MEASURES, ENCODED, GATES = 256, 6, 48, 24
BYTES = 128 + 1
#: Passages encoded at once.
BLOCK = 1024
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: its CRC-32 leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def passages(raw: np.ndarray) -> np.ndarray:
    """Starts of the passages of a text's bytes, which cover it; an empty text has one empty passage."""
    n = len(raw)
    if n <= PASSAGE + SLACK:
        return np.zeros(1, np.int64)
    blanks = np.flatnonzero(_WHITE[raw])
    starts, at = [0], PASSAGE
    while at < n - SLACK:
        k = np.searchsorted(blanks, at)
        at = int(blanks[k]) + 1 if k < len(blanks) and blanks[k] < at + SLACK else at + SLACK
        starts.append(at)
        at += PASSAGE
    return np.array([s for s in starts if s < n] or [0], np.int64)


def word_measures(piece: bytes) -> tuple:
    """Of a passage: log of its bytes and words, mean and spread of word lengths, share of distinct words, share of lines."""
    words = piece.split()
    n = len(words)
    if not n:
        return np.log1p(len(piece)), 0.0, 0.0, 0.0, 1.0, 0.0
    long = np.fromiter(map(len, words), np.float32, n)
    return np.log1p(len(piece)), np.log1p(n), long.mean(), long.std(), len(set(words)) / n, piece.count(b"\n") / n


def measured(text: bytes) -> Iterator[np.ndarray]:
    """Features of all passages of a text in blocks of rows: square roots of byte and byte-pair shares, and word measures."""
    raw = np.frombuffer(text, np.uint8)
    starts = np.r_[passages(raw), len(raw)]
    for at in range(0, len(starts) - 1, BLOCK):
        cut = starts[at : at + BLOCK + 1]
        part, count = raw[cut[0] : cut[-1]], len(cut) - 1
        size = np.maximum(1, np.diff(cut)).astype(np.float32)[:, None]
        of = np.repeat(np.arange(count), np.diff(cut))
        single = np.bincount(of * BYTES + np.minimum(part, BYTES - 1), minlength=count * BYTES).reshape(count, BYTES)
        pair = (part[:-1].astype(np.int64) * 40503 + part[1:].astype(np.int64) * 34283) >> 3
        double = np.bincount(of[:-1] * PAIRS + pair % PAIRS, minlength=count * PAIRS).reshape(count, PAIRS)
        words = np.array([word_measures(text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.float32)
        yield np.hstack([np.sqrt(single / size), np.sqrt(double / size), words]).astype(np.float32)


class Attention:
    """Encoder, gated attention and score. params: W, b (encoder), V, U, w (attention), c, d (score), mu, s (scales)."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - p["mu"]) / p["s"], -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"]), self._sigmoid(h @ p["U"])
        return x, h, a, g, (a * g) @ p["w"]

    def score(self, text: bytes) -> float:
        """Probability of label 1; attention is summed over blocks, relative to the largest weight so far."""
        top, mass, bag = -np.inf, 0.0, np.zeros(self.p["W"].shape[1])
        for x in measured(text):
            _, h, _, _, e = self._forward(x)
            high = max(top, float(e.max()))
            weight = np.exp(e - high)
            keep = np.exp(top - high) if top > -np.inf else 0.0
            bag, mass, top = bag * keep + weight @ h, mass * keep + weight.sum(), high
        return float(self._sigmoid(bag / mass @ self.p["c"] + self.p["d"]))

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Attention:
        """Weighted log loss of documents by Adam; gradients reach the attention through the score alone."""
        rng = np.random.default_rng(seed)
        n, m = [len(b) for b in bags], bags[0].shape[1]
        everything, starts = np.concatenate(bags), np.r_[0, np.cumsum(n)]
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        scale = {"mu": everything.mean(axis=0), "s": everything.std(axis=0) + 1e-3}
        p = {"W": draw(m, ENCODED), "b": np.zeros(ENCODED, np.float32), "V": draw(ENCODED, GATES), "U": draw(ENCODED, GATES), "w": draw(GATES), "c": draw(ENCODED), "d": np.zeros((), np.float32)}
        model = cls(p | scale)
        first, second, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        for _ in range(rounds):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in pick])
                of = np.repeat(np.arange(len(pick)), [n[k] for k in pick])
                cut = np.r_[0, np.cumsum([n[k] for k in pick])[:-1]]
                x, h, a, g, e = model._forward(everything[rows])
                alpha = np.exp(e - np.maximum.reduceat(e, cut)[of])
                alpha /= np.add.reduceat(alpha, cut)[of]
                bag = np.add.reduceat(alpha[:, None] * h, cut)
                off = (model._sigmoid(bag @ p["c"] + p["d"]) - labels[pick]) * weights[pick] / weights[pick].sum()
                to_bag = off[:, None] * p["c"]
                # Through the softmax: what a passage adds over the bag's mean.
                to_alpha = (h * to_bag[of]).sum(axis=1)
                to_e = alpha * (to_alpha - np.add.reduceat(alpha * to_alpha, cut)[of])
                to_a, to_g = to_e[:, None] * p["w"] * g * (1 - a * a), to_e[:, None] * p["w"] * a * g * (1 - g)
                to_h = (alpha[:, None] * to_bag[of] + to_a @ p["V"].T + to_g @ p["U"].T) * (1 - h * h)
                grad = {"W": x.T @ to_h, "b": to_h.sum(axis=0), "V": h.T @ to_a, "U": h.T @ to_g, "w": (a * g).T @ to_e, "c": bag.T @ off, "d": off.sum()}
                step += 1
                for k, v in grad.items():
                    v = v + decay * p[k] if k not in "bd" else v
                    first[k], second[k] = 0.9 * first[k] + 0.1 * v, 0.999 * second[k] + 0.001 * v * v
                    p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                    model.p[k] = p[k]
        return model


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(q, x, passages): distinct labelled texts with their features, at most per_class ids a class, chosen by a hash of the id.

    An id whose labels disagree counts as what most of them say (ties: 0). Null labels are none.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg(F.when(F.col("quality") == 1, 1).otherwise(0)) > 0.5).cast("int").alias("q"))
    # An ordered limit keeps the least rows of each task, so no task sorts a class.
    ids = [marks.where(F.col("q") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, text in zip(pdf["q"], pdf["text"], strict=True):
                first = next(measured((text or "").encode()))
                if len(first) <= LONGEST:
                    yield pd.DataFrame({"q": [q], "x": [first.astype(np.float16).tobytes()], "passages": [len(first)]})

    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("text").alias("text"), F.avg("q").alias("q"))
    return texts.select("q", "text").mapInPandas(run, "q double, x binary, passages int")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Attention | float:
    """The model of labelled documents; where a class has none, the share of label 1 (0.5 without any label).

    Sampled classes weigh as they do among all labels, so scores are probabilities.
    """
    shares = labels.where("doc_id is not null and quality is not null").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")).first()
    rows = sampled(docs, labels, per_class).collect()  # at most 2 * per_class documents of LONGEST passages
    rows.sort(key=lambda r: bytes(r.x))
    y = np.array([r.q for r in rows])
    good, n = float((y > 0.5).sum()), len(rows)
    if not good or good == n:
        return (shares["good"] or 0) / shares["n"] if shares["n"] else 0.5
    share = min(max((shares["good"] or 0) / shares["n"], 1e-6), 1 - 1e-6)
    weights = np.where(y > 0.5, share / good, (1 - share) / (n - good)) * n
    bags = [np.frombuffer(r.x, np.float16).reshape(r.passages, -1).astype(np.float32) for r in rows]
    return Attention.fit(bags, y.astype(np.float32), weights.astype(np.float32))


def scored(docs: DataFrame, model: Attention | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; only the text is read for the score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [model if isinstance(model, float) else model.score((t or "").encode()) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "score": np.array(scores, np.float64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Labels (doc_id, quality) of held-out documents are not learned from. Null texts score as empty ones, which are one
    empty passage. Rows that repeat score alike; null ids are scored and not held out; other columns are not looked at; an
    empty table gives no rows.
    """
    known = lambda df: df.where(~held_out(F.col("doc_id")))
    model = learn(known(docs), known(labels), per_class)
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
