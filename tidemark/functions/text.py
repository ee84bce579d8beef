"""Titles: normal form, hashes, similarity, and instructions hidden in them."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(title: str) -> str:
    """Case folded, without accents and signs, spaces collapsed."""
    letters = (c for c in unicodedata.normalize("NFKD", title.casefold()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in letters).split())


@F.pandas_udf(T.StringType())
def normalised(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: None if t is None else plain(t))


def title_hash(normal: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(normal, 256))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching characters of two texts, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sketch(texts: list[str], q: int, bits: int) -> np.ndarray:
    """A set of bits a text (words of 64) of its q-grams, repeats told apart: two sets differ in no more bits than their texts' q-grams do."""
    parts = [np.zeros((0, bits // 64), np.uint64)]
    for at in range(0, len(texts), 1024):
        some = texts[at : at + 1024]
        n = np.array([[len(t)] for t in some])
        width = max(int(n.max()), q)
        codes = np.array(some, f"U{width}").view(np.uint32).reshape(len(some), width).astype(np.uint64)
        place = np.arange(width - q + 1)
        grams = codes[:, : len(place)]
        for k in range(1, q):
            grams = grams * np.uint64(0x110000) + codes[:, k : k + len(place)]
        grams = np.sort(np.where(place <= n - q, grams, np.uint64(2**64 - 1)), axis=1)
        starts = np.ones(grams.shape, bool)
        starts[:, 1:] = grams[:, 1:] != grams[:, :-1]
        repeat = place - np.maximum.accumulate(np.where(starts, place, 0), axis=1)
        mixed = (grams + repeat.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        row, col = np.nonzero(place <= n - q)
        found = np.zeros((len(some), bits), bool)
        found[row, (mixed[row, col] >> np.uint64(40)) % np.uint64(bits)] = True
        parts.append(np.packbits(found, axis=1).view(np.uint64))
    return np.concatenate(parts)


def like_one_kept(texts: list[str], threshold: float) -> list[bool]:
    """Whether each of distinct texts is at least threshold alike to one before it that is not itself alike to one kept.

    Texts of together s characters, m of them matching in blocks, have d = s - 2 * m others, at least one between two blocks; so
    their characters differ in at most d places and their pairs of characters in 3 * d. Only what passes both is compared.
    """
    n = np.array([len(t) for t in texts], int)
    total = np.arange(2 * n.max(initial=0) + 1)
    over = np.maximum(total, 1)
    least = np.ceil(total * threshold / 2)
    least += 2.0 * least / over < threshold
    least -= (least > 0) & (2.0 * (least - 1) / over >= threshold)
    others = np.where(total == 0, 0, total - 2 * least).astype(int)
    one, two = sketch(texts, 1, 256), sketch(texts, 2, 1024)
    kept = np.zeros(len(texts), bool)
    step = min(512, max(16, 400_000 // max(len(texts), 1)))
    for at in range(0, len(texts), step):
        rows = np.arange(at, min(at + step, len(texts)))
        past = np.concatenate([np.flatnonzero(kept[:at]), rows])
        apart = np.zeros((len(rows), len(past)), np.uint16)
        for w in range(one.shape[1]):
            apart += np.bitwise_count(one[rows, w][:, None] ^ one[past, w])
        most = others[n[rows][:, None] + n[past]]
        i, j = np.nonzero((apart <= most) & (np.abs(n[rows][:, None] - n[past]) <= most) & (past < rows[:, None]))
        close = np.bitwise_count(two[rows[i]] ^ two[past[j]]).sum(axis=1) <= 3 * most[i, j]
        i, j = i[close], j[close]
        for r, these in zip(rows, np.split(past[j], np.searchsorted(i, np.arange(1, len(rows)))), strict=True):
            kept[r] = not any(kept[k] and difflib.SequenceMatcher(None, texts[r], texts[k]).ratio() >= threshold for k in these)
    return (~kept).tolist()


# Markers of a conversation, and phrases that give orders, in the normal form of a title.
MARKERS = ("```", "system:", "assistant:", "developer:")
ORDERS = (
    r"\bignore (all |the |any )*(previous|above|prior)\b",
    r"\bdisregard (all |the |any )*(previous|above|prior)\b",
    r"\bnew instructions?\b",
    r"\byou are now\b",
    r"\bact as\b",
    r"\boverride\b",
    r"\bolvida (lo|las|todas las) (anterior|instrucciones)\b",
    r"\bignora (lo|las|todas las) (anterior|instrucciones)\b",
    r"\bdevuelve (solo|unicamente)\b",
    r"\bresponde (solo|unicamente)\b",
)


def suspicious(title: Column, normal: Column) -> Column:
    """Whether a title holds an order, in its normal form, or a marker as it stands."""
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(F.lower(title), F.lit(m))
    for o in ORDERS:
        marked = marked | normal.rlike(o)
    return F.coalesce(marked, F.lit(False))
