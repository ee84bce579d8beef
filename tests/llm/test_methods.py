"""The dealt methods against plain versions of themselves, and what they find of planted cases."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_contracts import docs, filler
from tidemark.llm import language_id, media, mixing, near_dedup, pii, secret_scan, substring_dedup

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"base62": DIGITS + UPPER + LOWER, "HEX": DIGITS + "ABCDEF", "lower36": DIGITS + LOWER, "base64url": UPPER + LOWER + DIGITS + "-_", "base32": UPPER + "234567"}
WORDS = "the of and that with this from have they were about which their would there people other because first could after where those being under between system process number public general during without another however against himself important national something different government".split()


def key(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def identifiers(r, n):
    """Names, paths and joined words as code and prose hold them."""
    made = []
    for k in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(4, 6))]
        made.append([w[0] + "".join(x.title() for x in w[1:]), "_".join(w), "/".join(w), "".join(w), "-".join(w) + str(r.randint(1, 99)), "_".join(w).upper()][k % 6])
    return [m for m in made if len(m) >= 20]


def scanned(spark, texts):
    got = secret_scan.secrets(docs(spark, texts)).select("doc_id", "added").collect()
    return {r.doc_id: [(x.s, x.e) for x in r.added] for r in got}


def test_planted_keys_are_found_and_names_are_not(spark):
    r = random.Random(7)
    texts, planted = [], {}
    for name, alphabet in ALPHABETS.items():
        for n in (20, 24, 32, 40, 64):
            for _ in range(12):
                k = key(r, alphabet, n)
                before = prose(r, 20)
                planted[len(texts)] = (name, n, len(before) + 1, len(before) + 1 + n)
                texts.append(f"{before} {k} {prose(r, 15)}")
    names = range(len(texts), len(texts) + 400)
    texts += [f"{prose(r, 10)} {x} {prose(r, 10)}" for x in identifiers(r, 430)[:400]]
    got = scanned(spark, texts)
    found = {k: (s, e) in got[k] for k, (_, _, s, e) in planted.items()}
    share = lambda fit: np.mean([found[k] for k, v in planted.items() if fit(v)])
    assert share(lambda v: v[1] >= 32) >= 0.95
    assert share(lambda v: v[1] >= 24) >= 0.9
    for name in ALPHABETS:
        assert share(lambda v: v[0] == name and v[1] >= 32) >= 0.9, name
    assert sum(bool(got[k]) for k in names) <= 4  # a hundredth


def test_battery_and_discoveries_match_plain_python(spark):
    r = random.Random(11)
    tokens = [key(r, ALPHABETS[a], n) for a in ALPHABETS for n in (20, 31, 48)] + identifiers(r, 60) + ["a" * 24, "0" * 30, "12345678901234567890"]
    made = {x.token: x for x in secret_scan.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}

    def below(z):
        return 0.5 * math.erfc(-z / math.sqrt(2))

    freq = [0.8 * secret_scan.LETTERS[c] / sum(secret_scan.LETTERS.values()) + 0.2 / 26 for c in LOWER]
    mean = -sum(p * math.log(p) for p in freq)
    sd = 1.2 * math.sqrt(sum(p * (math.log(p) + mean) ** 2 for p in freq))
    for t in tokens:
        name, letters, share, switch = next(e for e in secret_scan.ENCODINGS if set(t) <= set(e[1]))
        n, k = len(t), len(letters)
        chi = k / n * sum(t.count(c) ** 2 for c in set(t)) - n
        extra = n * (k * share - 1)
        zs = [(k - 1 + extra - chi) / math.sqrt(2 * (k - 1) + 4 * max(extra, 0))]
        weight = 1.0
        odd = [-math.log(freq[LOWER.index(c)]) for c in t.lower() if c in LOWER]
        if len(odd) >= 8:
            zs.append((np.mean(odd) - mean) / sd * math.sqrt(len(odd)))
            weight += 2
        kind = lambda c: "d" if c in DIGITS else "l" if c in LOWER else "u" if c in UPPER else "s"
        if switch is not None:
            w = (n - 1) * switch
            zs.append((sum(kind(a) != kind(b) for a, b in zip(t, t[1:])) - w) / math.sqrt(w * (1 - switch)))
            weight += 1
        v = np.array([c in secret_scan.VOWELS for c in t.lower()], float)
        d = v - v.mean()
        if len(odd) >= 8 and (d * d).sum() > 0:
            zs.append(((d[:-1] * d[1:]).sum() / (d * d).sum() - secret_scan.TURNS) * math.sqrt(n))
            weight += 1
        assert made[t].encoding == name
        assert made[t].p_words == pytest.approx(below(-sum(zs) / math.sqrt(weight)), abs=2e-7), t
    rows = [(x.token, x.n, x.p_words, x.p_random) for x in made.values()]
    got = {x.token for x in secret_scan.discoveries(spark.createDataFrame(list(made.values()))).collect()}
    bins = lambda p: min(int(-20 * math.log10(max(p, 1e-20))), secret_scan._BINS)
    want = set()
    for stratum in {int(2 * math.log2(n)) for _, n, _, _ in rows}:
        mine = [x for x in rows if int(2 * math.log2(x[1])) == stratum]
        ok = [b for b in {bins(x[2]) for x in mine} if 10 ** (-b / 20) * len(mine) / sum(bins(x[2]) >= b for x in mine) <= secret_scan.FDR]
        want |= {x[0] for x in mine if ok and bins(x[2]) >= min(ok) and x[3] >= secret_scan.ALPHA}
    assert got == want and got


def test_a_text_of_very_many_tokens_takes_seconds(spark):
    r = random.Random(3)
    text = " ".join(key(r, ALPHABETS["base62"], 24) if k % 2 else f"token={k:08d}" for k in range(20_000))
    began = time.time()
    got = secret_scan.secrets(docs(spark, [text])).select(F.size("base").alias("b"), F.size("added").alias("a")).collect()[0]
    assert got.b == 10_000 and time.time() - began < 90


def edited(r, passage, edits):
    words = passage.split()
    for at in r.sample(range(len(words)), edits):
        words[at] = "zz" + words[at]
    return " ".join(words)


def test_passages_of_all_lengths_are_found(spark):
    r = random.Random(5)
    texts, cases = [], []
    for c, (kind, n, edits) in enumerate((("exact", 30, 0), ("exact", 50, 0), ("exact", 100, 0), ("edited", 50, 1), ("edited", 100, 2), ("paragraph", 20, 0))):
        for k in range(25):
            passage = filler(100_000 + 100 * c + k, n - 1).strip() + " end."
            wrap = (lambda p, a, b: f"{a}\n\n{p}\n\n{b}") if kind == "paragraph" else (lambda p, a, b: f"{a} {p} {b}")
            cases.append((kind, n, edits, len(texts) + 1, passage))
            for copy in range(2):
                seed = 7 * len(texts) + 3
                p = edited(r, passage, edits) if copy else passage
                texts.append(wrap(p, filler(seed, 60 + k), filler(seed + 1, 40 + 2 * k)))
    found = substring_dedup.passages(substring_dedup.repeated_paragraphs(docs(spark, texts))).collect()
    by = {}
    for x in found:
        by.setdefault(x.id, []).append((x.s, x.e))
    seen, share = {}, {}
    for kind, n, edits, k, passage in cases:
        hit = sum(e - s for s, e in by.get(k, []))
        seen.setdefault((kind, n, edits), []).append(hit > 0)
        share.setdefault((kind, n, edits), []).append(min(1.0, hit / len(passage)))
    rate = {c: np.mean(v) for c, v in seen.items()}
    removed = {c: np.mean(v) for c, v in share.items()}
    assert rate["exact", 30, 0] >= 0.9 and rate["exact", 50, 0] >= 0.9 and rate["edited", 50, 1] >= 0.9 and rate["exact", 100, 0] == 1 and rate["edited", 100, 2] >= 0.9 and rate["paragraph", 20, 0] == 1, rate
    assert removed["exact", 100, 0] >= 0.75 and removed["exact", 50, 0] >= 0.5, removed
    clean = set(range(len(texts))) - {k for _, _, _, k, _ in cases}
    assert not clean & set(by)  # first copies stay


def test_any_percent_and_band_tuning(spark):
    texts = [filler(1, 80), filler(1, 80), filler(2, 80)]
    for percent in (60, 75, 95):
        got = substring_dedup.repeated_paragraphs(docs(spark, texts), percent=percent)
        assert {x.id for x in got.where("not kept").collect()} == {1}
    for percent in (60, 75, 80, 95):
        bands = substring_dedup.tuned_bands(percent / 100, 0.99, substring_dedup.ROWS)
        assert 1 - (1 - (percent / 100) ** substring_dedup.ROWS) ** bands >= 0.99
    for s in (0.8, 0.85):
        rows = near_dedup.band_rows(s)
        assert (1 - s**rows) ** near_dedup.BANDS <= near_dedup.MISSED < (1 - s ** (rows + 1)) ** near_dedup.BANDS


def shingles(text, n=3):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies_of_all_likenesses(spark):
    """Pairs from 0.75 to 0.97, and a group whose members are mostly unlike one another: components equal brute force."""
    r = random.Random(9)
    texts = []
    for k in range(120):
        base = filler(5000 + k, 150)
        texts += [base, edited(r, base, r.randint(1, 9))]
    hub = filler(9000, 150)
    texts += [hub] + [edited(r, hub, r.randint(1, 12)) for _ in range(150)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(docs(spark, texts), words=3, percent=85).collect()}
    want = {k: find(k) for k in range(len(texts))}
    linked = [k for k in want if want[k] != k]
    assert len(linked) > 100 and all(want[got[k]] == want[k] for k in got)  # no false link
    assert sum(got[k] == want[k] for k in linked) >= 0.99 * len(linked)


def test_odd_sketches_estimate_similarity():
    sketch = near_dedup.Sketcher(near_dedup.BANDS, 9)
    r = np.random.default_rng(2)
    for share in (0.7, 0.85, 0.95):
        off = []
        for _ in range(60):
            both = r.integers(0, 2**63, 400, dtype=np.uint64)
            n = round(len(both) * (1 - share) / share / 2)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2))
            z = int(np.bitwise_count((sketch.odd(sketch.sample(a)) ^ sketch.odd(sketch.sample(b))).view(np.uint64)).sum())
            j = len(both) / (len(a) + len(b) - len(both))
            off.append(1 + math.log(1 - 2 * z / sketch.bits) * sketch.bits / (4 * sketch.k) - j)
        assert abs(np.mean(off)) < 0.012 and np.std(off) < 1.5 * near_dedup.standard_error(share)


def test_disclosure_values_match_plain_python(spark):
    texts = [f"alpha beta mail joe@ex.org gamma{k % 2} delta" for k in range(6)] + [f"alpha note {k} without" for k in range(20)] + ["call +49 1234 567890 omega psi"] * 2 + ["omega call again +49 1234 567890 psi"]
    df = docs(spark, texts)
    scanned_ = pii._scanned(df.select(F.col("doc_id").alias("id"), "text"), "bigint")
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(scanned_, df.select("text")).collect()}
    n_t, n_e, n_et, versions = {}, {}, {}, {}
    for t in texts:
        for w in set(pii._TERM.findall(t.lower())):
            n_t[w] = n_t.get(w, 0) + 1
        pairs = {(e, w) for e, w, _, _ in pii._near(t, pii.find_pii(t))}
        for e in {e for e, _ in pairs}:
            n_e[e] = n_e.get(e, 0) + 1
        for p in pairs:
            n_et[p] = n_et.get(p, 0) + 1
            versions.setdefault(p, set()).add(t)
    want = {p: 1 - -math.log(min(1, n_et[p] / n_t[p[1]])) / -math.log(n_e[p[0]] / len(texts)) for p in n_et if len(versions[p]) > 1}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want) and ("email:joe@ex.org", "alpha") in want


def test_long_identifiers_hide_no_term():
    text = "x" * 30 + " 1.2.3.4 " + " ".join("4111 1111 1111 1111" for _ in range(3)) + " secretname joe@example.org"
    spans = pii.find_pii(text)
    for _, _, s, e in pii._near(text, spans):
        assert not any(b[1] < e and s < b[2] for b in spans)
    assert any(t == "x" * 30 for _, t, _, _ in pii._near(text, spans))


def test_language_is_that_of_the_nearest_centroid(spark):
    r = np.random.RandomState(1)
    words = {"en": WORDS, "de": "der die und nicht mit sich auch ein wird aber nach oder wenn diese ihre werden zwischen".split(), "fr": "le la les des une dans pour avec mais sont cette leurs entre toujours jamais".split()}
    rows = [(k, " ".join(r.choice(words[lang], 40)), lang) for k, lang in enumerate(sorted(words) * 60)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(r.choice(words[lang], 25)) for lang in sorted(words) for _ in range(20)] + ["½ ² Ⅷ ①", "12 34 !", "ñ"]
    got = language_id.identified(docs(spark, texts), model).orderBy("doc_id").collect()
    for t, x in zip(texts, got, strict=True):
        counts = language_id.ngram_counts(t)
        if not counts.any():
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert x.lang_pred == model.langs[int(cosine.argmax())] and x.score == pytest.approx(min(1, cosine.max()), abs=1e-5)
    assert [x.lang_pred for x in got[-3:-1]] == ["und", "und"] and got[-1].lang_pred != "und"
    assert np.mean([x.lang_pred == lang for x, lang in zip(got, [a for a in sorted(words) for _ in range(20)])]) == 1.0


def test_the_mixture_holds_the_words_of_the_plan(spark):
    rows = [(k % 40, " ".join(["w"] * (1 + k % 40 * 3)), "ab"[k % 2], "x", 1) for k in range(400)] + [(None, None, None, "x", 1), (7, "", "a", "y", 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, taken_words int")
    plan = mixing.mixed_documents(df).collect()
    got = mixing.mixture(df).collect()
    assert sum(x.taken_words for x in got) == sum(x.taken for x in plan) and all(len(x.text.split()) == x.taken_words for x in got)
    per = lambda xs, of, n: sorted((k, sum(getattr(x, n) for x in xs if of(x) == k)) for k in {of(x) for x in xs if getattr(x, n)})
    assert per(got, lambda x: x.doc_id, "taken_words") == per(plan, lambda x: x.doc_id, "taken")


def test_blocks_are_chosen_as_the_quotas_say(spark):
    """A shard's quota of blocks, counted from the result, is that of Sainte-Laguë over its shards."""
    rows = [(k, " ".join(["w"] * (5 + k % 60)), "s") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(df, shard=4000).collect()
    total = sum(x.size for x in got)
    assert got[0].target == pytest.approx(1.5 * total) and abs(sum(x.taken for x in got) - 1.5 * total) <= 2 * mixing.BLOCK * math.ceil(total / 4000)
    parts = [x for x in got if 0 < x.part_to - x.part_from < x.size]
    assert len(parts) <= 2 * math.ceil(total / 4000) and {x.whole for x in got} <= {0, 1, 2}


def test_fingerprints_match_a_plain_transform():
    r = np.random.RandomState(4)
    for n in (64, 256, 320, 1024):
        data = r.randint(0, 255, n).astype(np.uint8)
        x = data.astype(float) - 128
        x = np.append(x, np.zeros((media.FRAME - len(x)) if len(x) < media.FRAME else (media.FRAME - len(x)) % media.HOP))
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
        basis = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
        peaks = []
        for t, at in enumerate(range(0, len(x) - media.FRAME + 1, media.HOP)):
            power = np.abs(basis @ (x[at : at + media.FRAME] * hann))
            local = [(-power[k], k) for k in range(2, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
            peaks += [(t, k) for _, k in sorted(local)[: media.PEAKS]]
        times, bins = media.spectral_peaks(data.tobytes())
        assert list(zip(times.tolist(), bins.tolist(), strict=True)) == peaks
        pairs = sorted((t, (a << 12) | (b << 4) | (u - t)) for t, a in peaks for u, b in peaks if 1 <= u - t <= media.AHEAD)
        got = media.fingerprints(times, bins)
        assert sorted(zip(*(v.tolist() for v in got), strict=True)) == pairs
