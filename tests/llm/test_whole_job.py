"""The operators on texts of other forms than those of the test tables."""

import textwrap

import numpy as np

from tests.llm.test_contracts import docs, filler
from tidemark.llm import language_id, license_scan, media


def full(name):
    return next(t for n, t in reversed(license_scan.TEMPLATES) if n == name)


def test_licenses_in_prose_and_wrapped(spark):
    prose = "We keep the sources of our tools in one place. Released under the MIT License. Ask us for the older releases."
    words = "the sources of our tools lie in one place Released under the MIT License and older ones are kept by the museum of the town for all to see"
    grant = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 300)
    comment = "\n".join(" * " + x for x in textwrap.wrap(grant, 78))
    both = textwrap.fill(full("MIT"), 60) + "\n\n" + "\n".join("# " + x for x in textwrap.wrap(full("ISC"), 70))
    edited = full("MIT").replace("AUTHORS OR COPYRIGHT HOLDERS", "REGENTS")
    texts = [prose, words, filler(1, 400) + "\n/*\n" + comment + "\n */\n" + filler(2, 50), both, edited + "\n" + edited, "-" * 200_000 + ". " * 50_000, "released under the MIT licence"]
    got = {r.doc_id: r.found for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert [[x.license for x in got[k]] for k in range(7)] == [["MIT"], ["MIT"], ["MIT"], ["MIT", "ISC"], ["MIT", "MIT"], [], []]
    for k in (0, 1):
        assert texts[k][got[k][0].s : got[k][0].e] == "Released under the MIT License"
    assert texts[2][got[2][0].s : got[2][0].e].startswith("Permission") and not any(x.differences for k in (0, 1, 2, 3) for x in got[k])
    assert all(x.differences == ["-authors or copyright holders +regents"] for x in got[4])


def test_every_license_text_finds_itself():
    scanner = license_scan.Scanner()
    for name, t in license_scan.TEMPLATES:
        found = scanner.scan(filler(3, 90) + " " + t + " " + filler(4, 90))
        assert [(x["license"], x["differences"]) for x in found] == [(name, [])]


def test_a_lone_long_text_sets_no_threshold(spark):
    words = {"en": "the of and that with this from have they were".split(), "de": "der die und nicht mit sich auch ein wird aber".split()}
    r = np.random.RandomState(5)
    text = lambda lang, n: " ".join(r.choice(words[lang], n))
    rows = [(text(lang, 30) + " " + filler(k, 10), lang) for lang in words for k in range(150)] + [(text("en", 3000), "en")]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    other = text("en", 2900) + " " + filler(500, 100)  # English too, of the class with one text
    got = language_id.identified(docs(spark, [other, text("de", 3000), "zzqx jjkw vvpy " * 20]), model).orderBy("doc_id").collect()
    assert [r.rejected for r in got] == [False, False, True] and [r.lang_pred for r in got][:2] == ["en", "de"]


def test_thresholds_come_from_all_texts_and_pool_neighbours():
    def drawn(seed, n):
        r = np.random.RandomState(seed)
        counts = np.zeros((language_id.LEVELS, language_id.BINS), np.int64)
        np.add.at(counts, (8, np.clip(r.normal(0.7, 0.04, n) * language_id.BINS, 0, 999).astype(int)), 1)
        return counts

    small, large = (language_id.least_cosines(c, c) for c in (drawn(1, 2_000), drawn(2, 400_000)))
    assert abs(small[8] - large[8]) < 0.02 and 0.45 < large[8] < 0.6
    one = drawn(3, 5_000)
    one[12, 950] = 1
    assert language_id.least_cosines(one, one)[12] < 0.6
    few = drawn(4, 20)
    assert abs(language_id.least_cosines(few, few + drawn(2, 400_000))[8] - large[8]) < 0.05


def test_fingerprints_hear_the_last_64_bytes():
    r = np.random.RandomState(7)
    head = r.randint(0, 255, 1024 + 128).astype(np.uint8).tobytes()
    for n in (1024, 1024 + 64, 1024 + 128):
        one, two = (head[: n - 64] + r.randint(0, 255, 64).astype(np.uint8).tobytes() for _ in range(2))
        peaks = [media.spectral_peaks(s) for s in (one, two)]
        assert [p[0].max() for p in peaks] == [-(-(n - media.FRAME) // media.HOP)] * 2
        a, b = (set(zip(*(v.tolist() for v in media.fingerprints(*p)), strict=True)) for p in peaks)
        assert a != b


def forms(seed, text):
    import textwrap

    alone = textwrap.wrap(text, 60, break_on_hyphens=False)
    return [text, f"{filler(seed, 30)} {text} {filler(seed + 1, 30)}", "\n".join(f" * {x}" for x in alone), text.upper(), f"{filler(seed, 9)}.\n# {text}\n{filler(seed, 12)}"]


PLANTED = {
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT"], "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"], "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"], "ISC": ["Distributed under the ISC License.", "SPDX-License-Identifier: ISC"], "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"], "MPL-2.0": ["Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."], "CC-BY-4.0": ["Licensed under CC BY 4.0."], "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."], "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."], "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
}


def test_planted_licenses_are_told_apart():
    """Thirty notices in five forms: at least 95 in 100 are found, and no other name ever."""
    scanner = license_scan.Scanner()
    got = [(name, [x["license"] for x in scanner.scan(f)]) for name, texts in PLANTED.items() for k, t in enumerate(texts) for f in forms(20 * k, t)]
    assert len(got) >= 145
    assert all(x in ([], [name]) for name, x in got), [g for g in got if g[1] not in ([], [g[0]])]
    assert sum(x == [name] for name, x in got) >= 0.95 * len(got)


def test_no_license_by_another_name():
    """A version or a name that no template has is no license, however alike the rest."""
    scanner = license_scan.Scanner()
    gpl = PLANTED["GPL-3.0"][0]
    for text in (gpl.replace("version 3", "version 4"), gpl.replace("GNU General", "GNU Lesser Affero General"), gpl.replace("General Public", "Special Public"), "Licensed under CC BY-NC 5.0.", "Not licensed under the Foo License."):
        assert scanner.scan(text) == [], text
    odd = scanner.scan(gpl.replace("redistribute it", "pass it on"))
    assert [x["license"] for x in odd] == ["GPL-3.0"] and odd[0]["differences"]


def plain_scan(text, templates):
    """Every template at every place, word for word; where some meet, what saves most of the bytes of their words together."""
    words = [(m[0].lower(), m.start(), m.end()) for m in license_scan._WORD.finditer(text)]
    w = [x[0] for x in words]
    scanner = license_scan.Scanner(templates)
    hits = [(p, p + len(t), k) for k, (_, t) in enumerate(scanner.templates) for p in range(len(w) - len(t) + 1) if w[p : p + len(t)] == t]
    out = []
    while hits:
        hits.sort()
        block, end = [hits[0]], hits[0][1]
        for h in hits[1:]:
            if h[0] < end:
                block.append(h)
                end = max(end, h[1])
        part = w[block[0][0] : end]
        best = max(block, key=lambda h: (scanner.gain(part, h[2]), -h[2]))
        out.append((templates[best[2]][0], words[best[0]][1], words[best[1] - 1][2]))
        hits = [h for h in hits if h[1] <= best[0] or h[0] >= best[1]]
    return sorted(out, key=lambda x: x[1])


def test_compression_decides_as_the_plain_version(monkeypatch):
    """Exact notices against all templates at all places, and without the gain other results."""
    notices = license_scan.TEMPLATES[: -len(license_scan._FULL)]
    texts = [f for texts in PLANTED.values() for k, t in enumerate(texts) for f in forms(31 * k, t)[:2]] + [" ".join((t, filler(5, 4), u)) for (_, t), (_, u) in zip(license_scan.NOTICES, license_scan.NOTICES[3:], strict=False)]
    run = lambda: [[(x["license"], x["s"], x["e"]) for x in license_scan.Scanner(notices).scan(t)] for t in texts]
    got = run()
    assert got == [plain_scan(t, notices) for t in texts]
    monkeypatch.setattr(license_scan.Scanner, "ranked", lambda self, words: [(1.0, k) for k in range(len(self.templates))])
    assert run() != got


def test_strangers_in_a_hot_bucket_meet_all_of_it(spark):
    """A group of near copies with strangers among its bands: the components are those of all pairs, in blocks of any size."""
    from tidemark.llm import near_dedup

    base = filler(900, 300).split()
    texts = []
    for k in range(60):  # near copies of one text
        w = list(base)
        w[5 * k % 300] = f"x{k}"
        texts.append(" ".join(w))
    for k in range(6):  # strangers at about the threshold, alike in pairs
        w = list(base)
        for j in range(14 + k % 3):
            w[(j * 20 + k // 2 * 7) % 300] = f"y{k // 2}-{j}"
        texts.append(" ".join(w))
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = near_dedup.near_components(docs(spark, texts), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label)) and len(set(label)) > 1
