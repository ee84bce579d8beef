"""Headlines nearly the same as one kept before: the plain rule, and blocks of many unlike titles."""

import datetime as dt
import difflib
import random
import time

import pytest

from tidemark.functions import text
from tidemark.operators import news

KIND = "block string, id long, published_at timestamp, title string, normal string"
ORDER = ("published_at", "title", "id")


def plain(texts, threshold):
    kept, near = [], []
    for t in texts:
        near.append(any(difflib.SequenceMatcher(None, t, k).ratio() >= threshold for k in kept))
        if not near[-1]:
            kept.append(t)
    return near


def edited(rng, t, letters, most):
    t = list(t)
    for _ in range(rng.randint(0, most)):
        k = rng.randint(0, len(t))
        t[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
    return "".join(t)


@pytest.mark.parametrize(("letters", "longest", "threshold"), [("ab", 12, 0.9), ("abcdefghij ", 80, 0.9), ("aé一😀 ", 40, 0.8), ("abcdefghijklmnopqrstuvwxyz ", 260, 0.95), ("abc ", 30, 2 / 3), ("abc", 6, 1.0)])
def test_near_titles_are_those_of_the_plain_rule(letters, longest, threshold):
    rng = random.Random(3)
    base = ["", *("".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(9))]
    texts = base + [edited(rng, rng.choice(base), letters, 1 + int(longest * (1 - threshold) * 0.7)) for _ in range(110)]
    rng.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    got = text.like_one_kept(texts, threshold)
    assert got == plain(texts, threshold) and (any(got) or threshold == 1)


def test_equal_rows_of_the_order_are_told_apart(spark):
    """Copies of a title at one instant: the one of the smallest id stays, however the rows come."""
    at = dt.datetime(2024, 1, 1)
    rows = [("b", k, at, "Markets rise", "markets rise") for k in range(40)] + [("b", 90, at, None, None), ("c", 91, at, "", ""), ("c", 92, at, "!", "")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = news.nearly_same(spark.createDataFrame(rows, KIND).repartition(3 + seed), order=ORDER).where("not near_duplicate").collect()
        assert sorted(r.id for r in got) == [0, 90, 91]
    with pytest.raises(ValueError, match="threshold"):
        news.nearly_same(spark.createDataFrame(rows, KIND), 1.5)


def test_a_block_of_many_unlike_titles(spark):
    """2500 titles in one block, with copies and edited copies: not every pair may be compared by its longest matches."""
    rng = random.Random(5)
    titles = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=80)) for _ in range(2500)]
    late = [(t, True) for t in rng.sample(titles, 40)] + [(t[:30] + "#" + t[33:], True) for t in rng.sample(titles, 40)] + [(t[::-1], False) for t in rng.sample(titles, 40)]
    rows = [("b", k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), t, t) for k, t in enumerate([*titles, *(t for t, _ in late)])]
    began = time.time()
    got = news.nearly_same(spark.createDataFrame(rows, KIND), order=ORDER).where("near_duplicate").collect()
    assert time.time() - began < 40
    assert sorted(r.id for r in got) == [2500 + k for k, (_, near) in enumerate(late) if near]
