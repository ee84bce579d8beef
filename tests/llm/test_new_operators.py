"""Quality, spelling variants and the filter audit against plain versions, on edges, and on held-out labels."""

import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.test_contracts import filler
from tidemark.llm import filter_audit, quality, queries, spelling_variants

DOCS = "doc_id long, text string, lang string, n int, part string, mask int, word string, h string, q int, first int, id int, least int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "w", "h", 3, 4, 5, 6) for r in rows], DOCS)


def edge_rows():
    base = [None, "", " \n ", "x", filler(3, 120), filler(3, 120), "ABC DEF " * 60, "a|b", filler(4, 99) + " #", "é" * 30, (filler(5, 200) + " ") * 100, "over ovr oveer Over OVER over ovr ovr"]
    out = [(k, t, ("en", "de", None)[k % 3]) for k, t in enumerate(base)]
    return out + [out[4], out[6], (20, base[6], "en"), (None, base[4], "en"), (None, base[4], None), (None, None, None), (4, base[9], "de"), (7, base[4], "fr")]


def plain_audit(rows, labels):
    good, toxic = ({x[0] for x in labels if x[k] == 1} - {None} for k in (1, 2))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    items = {}
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        items.setdefault(part or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, its in items.items():
        removed_all = Counter()
        for order in permutations("ABCDE"):
            left = its
            for s, f in enumerate(order):
                lost = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_all[f] += len(lost)
                fails = sum(f in x[0] for x in its)
                out[part, "".join(order), s + 1] = [len(left), len(lost), fails - len(lost), sum(x[0] == {f} for x in its), sum(x[1] for x in lost), sum(x[2] for x in lost), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = removed_all[out[key][6]]
    return out


def test_audit_equals_every_order_applied(spark):
    rows = edge_rows()
    labels = [(4, 1, 0), (5, 1, 1), (6, 0, 1), (6, 1, None), (20, 1, 1), (None, 1, 1), (99, 1, 1), (0, None, 1), (7, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs(spark, rows), marks).collect()
    want = plain_audit(rows, labels)
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in cols] for r in got} == want and len(got) == 600 * 4
    assert filter_audit.filter_audit(docs(spark, rows).limit(0), marks).count() == 0
    none = filter_audit.filter_audit(docs(spark, rows), marks.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def plain_variants(rows, least_length=5, least_count=3, every=97):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, near = {}, {}
    for w, n in words.items():
        beside = [x for x in words if apart(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        near[w], form[w] = len(beside), best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return out


def spelled(seed=5):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcdeéÀß"), rng.integers(4, 8))) for _ in range(40)]
    rows = []
    for i in range(60):
        words = []
        for w in rng.choice(stems, 40):
            if rng.random() < 0.4:  # a wrong letter, one too few or one too many
                k, c = rng.integers(len(w)), rng.choice(list("abcdeÿ"))
                w = (w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:])[rng.integers(3)]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, ", ".join(words), None))
    return rows


@pytest.mark.parametrize("every,length,count", [(97, 5, 3), (3, 5, 3), (97, 1, 1)])
def test_variants_equal_all_pairs_compared(spark, every, length, count):
    rows = spelled() + edge_rows()
    got = spelling_variants.spelling_variants(docs(spark, rows), length, count, every).collect()
    want = plain_variants(rows, length, count, every)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.form for r in got)


def test_variants_follow_forms_to_the_last(spark):
    """Counts that double along a chain of single edits: every word ends at the most frequent."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    rows = [(None, (w + " ") * (3 * 2**k), None) for k, w in enumerate(chain)]
    got = {r.word: r for r in spelling_variants.spelling_variants(docs(spark, rows)).collect()}
    assert {w: got[w].form for w in chain} == dict(zip(chain, [*chain[1:], None], strict=True))
    assert {got[w].root for w in chain} == {"bbbbbb"}


def test_variants_of_nothing(spark):
    d = docs(spark, edge_rows())
    assert spelling_variants.spelling_variants(d.limit(0)).count() == 0
    assert spelling_variants.spelling_variants(docs(spark, [(1, None, None), (2, "", None), (3, "1 2 3", None)])).count() == 0


def test_variants_send_no_table_to_the_driver(spark, monkeypatch):
    """Spark takes the exploded sides for tables as small as their staged files; none may be broadcast, planned or adapted."""
    plans, staged = [], spelling_variants.staged

    def planned(df):
        got = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return got

    def watched(df, name):
        planned(df)
        return staged(df, name)

    monkeypatch.setattr(spelling_variants, "staged", watched)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # Spark's own
    assert planned(spelling_variants.spelling_variants(docs(spark, spelled())))
    assert sum("SortMergeJoin" in p for p in plans) >= 4  # near words, forms, roots, result
    assert not [p for p in plans if "Broadcast" in p]


def good_and_bad(n, seed):
    """Plain prose, and prose of which a part is shouted or symbols: the label says of the document alone that it holds some."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        parts = [filler(seed * 1000 + 10 * k + j, int(rng.integers(60, 200))) for j in range(rng.integers(1, 5))]
        bad = k % 3 == 0
        if bad:
            at = rng.integers(len(parts))
            parts[at] = parts[at].upper().replace(" ", "!! ") if k % 2 else parts[at].replace(" ", "%%% ")
        rows.append((seed * 1000 + k, "\n".join(parts), 0 if bad else 1))
    return rows


def test_quality_of_held_out_documents(spark):
    rows = good_and_bad(600, 1)
    marks = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 0), (1, None), (rows[0][0], rows[0][2])], "doc_id long, quality int")
    d = docs(spark, [(i, t, "en") for i, t, _ in rows])
    got = quality.quality(d, marks).toPandas().set_index("doc_id")
    want = pd.Series({i: q for i, _, q in rows})
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]
    away = got[got.held_out]
    assert len(away) > 150 and (away.predicted == want[away.index]).mean() >= 0.95
    again = quality.quality(d, marks.where(~quality.held_out(F.col("doc_id")))).toPandas().set_index("doc_id")
    assert np.allclose(again.score[got.index], got.score, atol=1e-6)  # held-out labels are not looked at


def test_attention_finds_the_passages(spark):
    """Passages are not labelled, yet the junk of a document takes more of the weight than its share."""
    rows = good_and_bad(400, 2)
    marks = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.learn(docs(spark, [(i, t, "en") for i, t, _ in rows]), marks)
    long = "\n".join([filler(k, 150) for k in range(6)])
    junk = filler(77, 90).replace(" ", "%%% ")
    assert model.score(long.encode()) > 0.5 > model.score((long + "\n" + junk).encode())


def test_quality_is_that_of_the_blocks_at_once(spark):
    """The sum over blocks of passages equals the softmax over all, and passages cover a text."""
    rows = good_and_bad(200, 3)
    model = quality.learn(docs(spark, [(i, t, "en") for i, t, _ in rows]), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    text = filler(8, 120_000).encode()
    x = np.vstack(list(quality.measured(text)))
    assert len(x) > quality.BLOCK
    _, h, _, _, e = model._forward(x)
    a = np.exp(e - e.max())
    whole = model._sigmoid((a / a.sum()) @ h @ model.p["c"] + model.p["d"])
    assert abs(model.score(text) - whole) < 1e-6
    for t in (b"", b"x" * 5000, text, b"word " * 300):
        s = quality.passages(np.frombuffer(t, np.uint8))
        assert s[0] == 0 and (np.diff(s) > 0).all() and (len(t) == 0 or s[-1] < len(t)) and np.diff(np.r_[s, len(t)]).max() <= 2 * (quality.PASSAGE + quality.SLACK)


def test_quality_edges(spark):
    d = docs(spark, edge_rows())
    marks = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    got = quality.quality(d, marks((0, 1), (3, 0), (4, 1), (6, 0), (6, 1), (None, 1))).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0} | {r.score for r in got if r.doc_id == 1}) == 1  # null as empty
    assert {r.score for r in quality.quality(d, marks((0, 1)).limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.quality(d, marks((0, 1), (4, 1))).collect()} == {1}
    assert quality.quality(d.limit(0), marks((0, 1), (3, 0))).count() == 0


def test_their_queries_read_the_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = queries.QUERIES["op12_parity_band_spelling_variants"](spark, sf).collect()
    few = {w[0]: w for w in plain_variants([tuple(r) for r in rows][:0])}
    assert few == {} and len(got) > 1000
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert {r.word: r.n for r in got} == {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert queries.QUERIES["op11_attention_quality"](spark, sf).count() == len(rows)
