"""License scan by conditional compression.

Runs of three words that templates have place candidate blocks in a text, whatever the lines and sentences around. Each
block is compressed plainly and with every template as zstandard raw dictionary, and the templates are ranked by what
they take off its size. Going down the ranking, the first whose wording confirms wins its words: few of them differ, and
none that tells licenses apart, such as a name or a version. What is left of the block is ranked anew.
"""

from __future__ import annotations

import difflib
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short notices, opening paragraphs and full texts of public licenses, as their owners word them.
_FULL = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0")
#: Names that stand after "licensed under", and further tags of SPDX.
_NAMED: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("MIT", ("the MIT License", "the MIT license (MIT)", "MIT"), ("MIT",)),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"), ("Apache-2.0",)),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"), ("BSD-2-Clause",)),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"), ("BSD-3-Clause",)),
    ("ISC", ("the ISC License",), ("ISC",)),
    ("Zlib", ("the zlib License",), ("Zlib",)),
    ("BSL-1.0", ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"), ("BSL-1.0",)),
    ("Unlicense", ("the Unlicense",), ("Unlicense",)),
    ("MPL-2.0", ("the Mozilla Public License, v. 2.0", "the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"), ("MPL-2.0",)),
    ("EPL-1.0", ("the Eclipse Public License v1.0", "the Eclipse Public License 1.0"), ("EPL-1.0",)),
    ("EPL-2.0", ("the Eclipse Public License v2.0", "the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"), ("EPL-2.0",)),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL version 2", "GPLv2"), ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL version 3", "GPLv3"), ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("LGPL-2.1", ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPLv2.1"), ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPLv3"), ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPLv3"), ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal License"), ("CC0-1.0",)),
    ("CC-BY-4.0", ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"), ("CC-BY-4.0",)),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-SA-4.0",)),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-NC-4.0",)),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"), ("CC-BY-ND-4.0",)),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("CC-BY-NC-SA-4.0",)),
)
_VERBS = ("licensed under", "released under", "distributed under")
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    *((name, f"{verb} {called}") for name, named, _ in _NAMED for called in named for verb in _VERBS),
    *((name, f"SPDX-License-Identifier: {tag}") for name, _, tags in _NAMED for tag in tags),
    *NOTICES,
    *((name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in _FULL),
)
#: Words that tell licenses apart: none may be missing or stand for another, and none of MORE may be put in.
NAMES = frozenset("mit apache bsd isc zlib boost unlicense mozilla eclipse gnu gpl lgpl agpl lesser library affero general cc cc0 by-sa by-nc by-nd by-nc-sa creative commons attribution sharealike noncommercial noderivatives universal 2-clause 3-clause simplified".split())
MORE = frozenset("lesser library affero sharealike noncommercial noderivatives by-sa by-nc by-nd by-nc-sa sa nc nd not".split())
_VERSION = re.compile(r"v?\d(?:\.\d)*")
_WORD = re.compile(r"\w++(?:[.+-]++\w++)*+")
#: Words of a run that places a template.
RUN = 3
#: The winner must save MIN_GAIN of the words it covers; of its words at most DIFFER may be missing, altered or put in.
MIN_GAIN, DIFFER = 0.25, 0.15


def _gap(one: difflib.Match, two: difflib.Match, words: bool = True) -> int:
    """Words that differ between two matching runs; without words, those of the template alone."""
    missing = two.a - one.a - one.size
    return max(missing, two.b - one.b - one.size) if words else missing


def wording(template: list[str], words: list[str]) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """Of the best place in words: where it starts and ends, and the parts (i, j, k, l) where template[i:j] reads words[k:l]."""
    same = [m for m in difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    for end, step in ((-1, -2), (0, 1)):  # words at an edge that cost more to reach than to miss
        while len(same) > 1 and _gap(*sorted((same[end], same[step]))) >= (_gap(*sorted((same[end], same[step])), words=False) + same[end].size):
            same.pop(end)
    if not same:
        return 0, 0, [(0, len(template), 0, 0)]
    first, last = same[0], same[-1]
    odd, i, k = [], first.a, first.b
    if first.a:
        odd.append((0, first.a, first.b, first.b))
    for m in same:
        if m.a > i or m.b > k:
            odd.append((i, m.a, k, m.b))
        i, k = m.a + m.size, m.b + m.size
    if i < len(template):
        odd.append((i, len(template), k, k))
    return first.b, last.b + last.size, odd


def tells_apart(template: list[str], words: list[str], odd: list[tuple[int, int, int, int]], versions: bool) -> bool:
    """Whether a difference touches a word that names a license or, where versions count, one."""
    for i, j, k, l in odd:  # noqa: E741
        both = {*template[i:j], *words[k:l]} if i < j else set()
        plain = {p for w in both for p in (w, *w.split("-"))}
        if plain & NAMES or MORE & {p for w in words[k:l] for p in (w, *w.split("-"))} or versions and any(_VERSION.fullmatch(w) for w in (*template[i:j], *words[k:l])):
            return True
    return False


class Scanner:
    """Runs of words and compressors of the templates, built once a task."""

    def __init__(self, templates=TEMPLATES, level: int = 9) -> None:
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.templates = [(name, [w.lower() for w in _WORD.findall(t)]) for name, t in templates]
        raw = [zstandard.ZstdCompressionDict(" ".join(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in self.templates]
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in raw]
        self.edits = [int(DIFFER * len(t)) for _, t in self.templates]
        #: Templates before the full texts, whose own numbering and years may differ.
        self.n_notices = len(templates) - (len(_FULL) if templates is TEMPLATES else 0)
        self.at: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))  # run length -> run -> (template, place)
        for k, (_, t) in enumerate(self.templates):
            q = min(RUN, len(t))
            for o in range(len(t) - q + 1 if t else 0):
                self.at[q][tuple(t[o : o + q])].append((k, o))

    def gain(self, words: list[str], k: int) -> float:
        """The share of the bytes of words that template k saves."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        return 1 - len(self.given[k].compress(data)) / len(self.plain.compress(data))

    def places(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        """(template, starts, offsets, windows) where enough runs of a template lie whole, the fullest window first.

        An edit breaks at most q runs of q words and moves those after it by a word. So a wording within DIFFER keeps at
        least n - q + 1 - q * edits runs, all within 2 * edits of one another, counted from where the template would start.
        """
        for q, runs in self.at.items():
            grams = [words[i:] for i in range(q)]
            if runs.keys().isdisjoint(zip(*grams)):
                continue
            hits = defaultdict(list)
            for p, g in enumerate(zip(*grams)):
                for k, o in runs.get(g, ()):
                    hits[k].append((p - o, o))
            for k, found in hits.items():
                most, need = self.edits[k], self.need(k)
                if len(found) < need:
                    continue
                found.sort()
                windows, count, high, seen = [], defaultdict(int), 0, 0
                for low, (s, o) in enumerate(found):
                    while high < len(found) and found[high][0] <= s + 2 * most:
                        count[found[high][1]] += 1
                        high += 1
                    if high > seen and len(count) >= need:  # else an earlier window holds this one
                        windows.append((-len(count), low, high))
                    seen = max(seen, high)
                    count[o] -= 1
                    if not count[o]:
                        del count[o]
                at = np.array(found)
                yield k, at[:, 0], at[:, 1], [w[1:] for w in sorted(windows)]

    def need(self, k: int) -> int:
        n = len(self.templates[k][1])
        q = min(RUN, n)
        return max(1, n - q + 1 - q * self.edits[k])

    def candidates(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first, end, template) of places whose words may confirm: enough of the template's words are there."""
        out = set()
        for k, starts, offsets, windows in self.places(words):
            template, most = self.templates[k][1], self.edits[k]
            bag, n_runs = Counter(template), len(template) - min(RUN, len(template))
            for low, high in windows:
                o = offsets[low:high]
                p = starts[low:high] + o
                i, j = p.argmin(), p.argmax()
                first = max(0, int(p[i] - o[i]) - (most if o[i] else 0))
                end = min(len(words), int(p[j] - o[j]) + len(template) + (most if o[j] < n_runs else 0))
                if (Counter(words[first:end]) & bag).total() >= len(template) - most:
                    out.add((first, end, k))
        return sorted(out)

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(gain, template) of every template, what it takes off the size of words, the largest first (ties: the template given first)."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / plain, k) for k, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def confirmed(self, words: list[str], first: int, end: int, k: int) -> tuple[int, int, list[str]] | None:
        """(start, end, differences) in words if those of a place are the template's but for few, and for none that tells licenses apart."""
        template, part = self.templates[k][1], words[first:end]
        s, e, odd = wording(template, part)
        if e == s or sum(max(j - i, m - l) for i, j, l, m in odd) > self.edits[k] or tells_apart(template, part, odd, versions=k < self.n_notices):
            return None
        return first + s, first + e, ["-" + " ".join(template[i:j]) + " +" + " ".join(part[l:m]) for i, j, l, m in odd]

    def winners(self, words: list[str], left: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, float, list[str]]]:
        """(start, end, template, gain, differences) of a block of overlapping places."""
        while left:
            low = min(x[0] for x in left)
            block = words[low : max(x[1] for x in left)]
            at: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for first, end, k in left:
                at[k].append((first, end))
            win = None
            for _, k in self.ranked(block):
                for first, end in at.get(k, ()):
                    sure = self.confirmed(words, first, end, k)
                    if sure and (gain := self.gain(words[sure[0] : sure[1]], k)) >= MIN_GAIN:
                        win = (sure[0], sure[1], k, gain, sure[2])
                        break
                if win:
                    break
            if not win:
                return
            yield win
            # Places beside the winner's words are left; those that only reach into them keep what lies outside.
            s, e = win[:2]
            rest = [(a, b, k) for first, end, k in left for a, b in ((first, min(end, s)), (max(first, e), end)) if b - a >= len(self.templates[k][1]) - self.edits[k]]
            left = sorted(set(rest))

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [x[0] for x in found]
        keep: list[dict] = []
        block: list[tuple[int, int, int]] = []
        for place in [*self.candidates(words), None]:
            if block and (place is None or place[0] >= max(x[1] for x in block)):
                for s, e, k, gain, diff in self.winners(words, block):
                    keep.append({"license": self.templates[k][0], "s": found[s][1], "e": found[e - 1][2], "gain": float(gain), "differences": diff})
                block = []
            if place:
                block.append(place)
        return sorted(keep, key=lambda x: x["s"])


FOUND = "array<struct<license:string,s:int,e:int,gain:double,differences:array<string>>>"


def license_scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and found, the licenses by place (code points, ends exclusive).

    Null and empty texts find nothing; repeated rows and null ids stay; other columns aren't looked at; no rows give
    none. differences lists where the wording leaves the template, "-" what it has and "+" what stands there instead.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "found": [scanner.scan(t) if isinstance(t, str) else [] for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, found {FOUND}").withColumnRenamed("id", id_col)
