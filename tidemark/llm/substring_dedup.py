"""Substring dedup of paragraphs by MinHash bands.

Texts seldom mark the passages they share, so paragraphs are found by content and cover each text once: blocks between
blank lines, and within a block sentences (lines end sentences too), short ones with those after them up to LEAST
words. Where a passage stands moves the cuts of its first paragraph at most, so two texts that share it have the others
in common. Paragraphs of equal words are one class; classes that collide in a band of MinHash values are compared, exact
Jaccard of their word shingles confirms, and components of what is linked keep their first paragraph only. Repeats that
lie side by side are one passage, which goes if it has RUN words or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import carrying, dropped, join_hot, small, staged, swept
from tidemark.llm.near_dedup import mixed, similar_components

#: Words of a paragraph within a block at least, and of a repeated passage.
LEAST, RUN = 12, 16
#: Sentences of more words end at words chosen by their hash too, one in LONG_END.
LONG, LONG_END = 32, 12
#: MinHash values of a band, of the sample, and words of 64 bits in an odd sketch.
ROWS, SAMPLES, WORDS = 2, 48, 2
#: Keys that a task remembers: of a paragraph it has met, the bands are not given again.
MET = 200_000
#: Bytes of text that are cut at once; a longer text is cut by itself, in some 60 bytes a byte of it.
AT_ONCE = 1 << 19
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What a byte of a word counts for: nothing if it is an ASCII sign, the same for A-Z and a-z.
_BYTE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[[k for k in range(128) if not chr(k).isalnum()]] = 0
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[[ord(c) for c in "\"')]"]] = True


def tuned_bands(similarity: float, recall: float, rows: int = 1) -> int:
    """The least number of bands at which a pair of this similarity shares one with at least this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Paragraphs:
    """Cuts texts into paragraphs and hashes them."""

    def __init__(self, words: int, bands: int, least: int = LEAST, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        self.n, self.bands, self.least, self.k = words, bands, max(least, words), max(SAMPLES, bands * ROWS)
        self.mul = (rng.integers(0, 2**32, self.k, dtype=np.uint32) | np.uint32(1))[:, None]
        self.add = rng.integers(0, 2**32, self.k, dtype=np.uint32)[:, None]
        self.salt = rng.integers(0, 2**63, self.k, dtype=np.uint64)[:, None]
        self.powers = np.ones(1, np.uint64)
        self.met: set[bytes] = set()

    def first_time(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys this task meets for the first time."""
        raw = keys.tobytes()
        new = []
        for at in range(0, len(raw), 16):
            key = raw[at : at + 16]
            new.append(key not in self.met)
            self.met.add(key)
        if len(self.met) > MET:
            self.met.clear()
        return np.array(new, bool)

    def tokens(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words of UTF-8 bytes; a character of a script without spaces is a word."""
        space = _SPACE[data]
        inside = np.concatenate([[False], ~space, [False]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turn[::2], turn[1::2]
        if data.max(initial=0) >= 0xE3:
            wide = np.flatnonzero((data >= 0xE3) & (data <= 0xED))  # CJK, kana, Hangul: three bytes each
            if len(wide):
                after = wide + 3
                more = np.concatenate([wide, after[(after < len(data)) & ~space[np.minimum(after, len(data) - 1)]]])
                all_starts = np.union1d(starts, more)
                run_end = ends[np.searchsorted(starts, all_starts, side="right") - 1]
                starts, ends = all_starts, np.minimum(np.append(all_starts[1:], len(data)), run_end)
        if not len(starts):
            return starts, ends, np.empty(0, np.uint64)
        value = _BYTE[data]
        kept = np.cumsum(value > 0)
        before = kept[starts] - (value[starts] > 0)
        rank = np.zeros(len(data), np.int64)  # of a byte among those of its word that count, from 1
        rank[starts[0] :] = kept[starts[0] :] - np.repeat(before, np.diff(np.append(starts, len(data))))
        longest = int(rank.max())
        if longest >= len(self.powers):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest + 64, _BASES[0])]), dtype=np.uint64)
        return starts, ends, mixed(np.add.reduceat(value * self.powers[rank], starts))

    def cut(self, data: np.ndarray) -> tuple:
        """(hashes of the words, their starts and ends, first and last words of the paragraphs, ends exclusive)."""
        starts, ends, h = self.tokens(data)
        none = np.empty(0, np.int64)
        if not len(h):
            return h, starts, ends, none, none
        last = data[ends - 1]
        stop = _STOPS[last] | (_CLOSES[last] & _STOPS[data[np.maximum(ends - 2, 0)]])
        if data.max() >= 0xC0:  # the stops of other scripts, by their last two bytes
            two = data[np.maximum(ends - 2, 0)].astype(np.uint16) << 8 | last
            stop |= np.isin(two, (0x8082, 0xBC81, 0xBC9F, 0xD89F, 0xA5A4))
        lines = np.cumsum(data == 10)
        breaks = np.append(lines[starts[1:]] - lines[ends[:-1] - 1], 2)
        hard = breaks >= 2
        stop |= breaks >= 1
        close = np.flatnonzero(stop) + 1
        size = np.diff(np.concatenate([[0], close]))
        if size.max() > LONG:
            soft = np.repeat(size > LONG, size) & (mixed(h + np.uint64(3)) % np.uint64(LONG_END) == 0)
            close = np.flatnonzero(stop | soft) + 1
        first, end, at = [], [], 0
        for c, whole in zip(close.tolist(), hard[close - 1].tolist(), strict=True):
            if whole or c - at >= self.least:
                if c - at >= self.n:
                    first.append(at)
                    end.append(c)
                at = c
        return h, starts, ends, np.array(first, np.int64), np.array(end, np.int64)

    def grams(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(h) - self.n + 1), np.uint64)
        for k in range(self.n):
            out = mixed(out + h[k : k + len(out)] + np.uint64(k + 1))
        return out

    def rows(self, texts: list[bytes]) -> Iterator[tuple]:
        """Arrays (text, place, words, s, e, key, n, bands, odd, grams) of a bounded number of paragraphs at once; key has two columns,
        grams are the n shingles of each in a row."""
        begin = np.cumsum([0, *(len(t) + 2 for t in texts)])
        data = np.frombuffer(b"\n\n".join(texts) + b"\n\n", np.uint8)
        h, starts, ends, first, last = self.cut(data)
        if not len(first):
            return
        grams = self.grams(h)
        points = np.cumsum((data & 0xC0) != 0x80)
        point = lambda x: points[x - 1] * (x > 0)  # noqa: E731  code points before byte x
        who = np.searchsorted(begin, starts[first], side="right") - 1
        place = np.arange(len(who)) - np.searchsorted(who, who)
        s, e = point(starts[first]) - point(begin[who]), point(ends[last - 1]) - point(begin[who])
        for at in range(0, len(first), 512):
            part = slice(at, at + 512)
            a, b = first[part], last[part]
            size = b - a - self.n + 1
            cut = np.concatenate([[0], np.cumsum(size)[:-1]])
            own = np.repeat(np.arange(len(a)), size)
            g = grams[np.arange(size.sum()) - np.repeat(cut - a, size)]
            order = np.lexsort((g, own))
            new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (own[order][1:] != own[order][:-1])])
            n = np.add.reduceat(new.astype(np.int64), cut)
            low = np.minimum.reduceat(self.mul * (g >> np.uint64(32)).astype(np.uint32) + self.add, cut, axis=1)
            bit = mixed(low.astype(np.uint64) + self.salt) % np.uint64(64 * WORDS)
            mark = np.uint64(1) << (bit & np.uint64(63))
            odd = np.stack([np.bitwise_xor.reduce(np.where(bit >> np.uint64(6) == k, mark, np.uint64(0)), axis=0) for k in range(WORDS)], axis=1)
            long = b - a
            cut_w = np.concatenate([[0], np.cumsum(long)[:-1]])
            step = np.arange(long.sum()) - np.repeat(cut_w, long)
            word = h[step + np.repeat(a, long)]
            keys = [np.add.reduceat(mixed(word + base * (step + 1).astype(np.uint64)), cut_w) for base in _BASES]
            bands = np.repeat(np.arange(1, self.bands + 1, dtype=np.uint64)[None], len(a), axis=0)
            for r in range(ROWS):
                bands = mixed(bands * _BASES[0] + low[r : self.bands * ROWS : ROWS].T.astype(np.uint64) + np.uint64(r + 1))
            yield who[part], place[part], long, s[part], e[part], np.stack(keys, axis=1), n, bands, odd, (g[order][new] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def paragraphs(rows: DataFrame, words: int, bands: int) -> DataFrame:
    """(id, rid, u, w, s, e, key, n, bands, odd, grams) of rows (id, rid, text): the paragraphs, counted by u, of w words; key is a
    128-bit hash of their words in order, grams the set of their shingles (32 bits each, as sets are small). A task gives
    the bands and shingles of a key once, so that copies don't multiply what is shuffled."""
    kind = rows.schema["id"].dataType.simpleString()

    def table(cutter: Paragraphs, ids: pa.Array, rids: pa.Array, part: tuple) -> pa.RecordBatch:
        who, place, long, s, e, keys, n, values, odd, grams = part
        at, count = pa.array(who), len(s)
        offsets = lambda k: np.arange(0, (count + 1) * k, k, dtype=np.int32)
        lists = lambda x: pa.ListArray.from_arrays(offsets(x.shape[1]), np.ascontiguousarray(x).view(np.int64).ravel())
        new = cutter.first_time(keys)  # empty lists of bands and shingles for the others
        ends = np.concatenate([[0], np.cumsum(new * values.shape[1])]).astype(np.int32)
        banded = pa.ListArray.from_arrays(ends, np.ascontiguousarray(values[new]).view(np.int64).ravel())
        named = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets(16)), pa.py_buffer(np.ascontiguousarray(keys))])
        cuts = np.concatenate([[0], np.cumsum(np.where(new, n, 0))]).astype(np.int32)
        sets = pa.ListArray.from_arrays(cuts, grams[np.repeat(new, n)])
        ints = [pa.array(x.astype(np.int32)) for x in (place, long, s, e)]
        columns = [ids.take(at), rids.take(at), *ints, named, pa.array(n.astype(np.int32)), banded, lists(odd), sets]
        return pa.RecordBatch.from_arrays(columns, ["id", "rid", "u", "w", "s", "e", "key", "n", "bands", "odd", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Paragraphs(words, bands)
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, rids, column = batch.columns
                texts: list[bytes] = []
                held, begun = 0, 0
                for k, text in enumerate(column):
                    texts.append(_encoded(text.as_py()))
                    held += len(texts[-1])
                    if held >= AT_ONCE or k + 1 == len(column):
                        for part in cutter.rows(texts):
                            yield table(cutter, ids.slice(begun), rids.slice(begun), part)
                        texts, held, begun = [], 0, k + 1

    return rows.mapInArrow(run, f"id {kind}, rid long, u int, w int, s int, e int, key binary, n int, bands array<long>, odd array<long>, grams array<int>")


def repeated_paragraphs(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.99, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, s, e, n_words, run, first_id, kept) of every paragraph that others repeat, in code points, ends exclusive.

    kept is true for the first of each component (by id, hash of the text, place), first_id is that one's id. run is
    where the passage starts to which the paragraph belongs; passages of fewer than `run` words are no repeats. Null and
    empty texts and those under `words` words have no paragraphs. A row that repeats (id and text) counts once; null ids
    come first; other columns aren't looked at; no rows give none. Every text is cut as a whole.
    """
    bands = tuned_bands(percent / 100, recall, ROWS)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"))
    if not rows.groupBy("id", "rid").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "rid"])
    found = staged(paragraphs(rows, words, bands), "paragraphs")
    place = F.struct("id", "rid", "s")
    classes = found.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("m"))
    again = staged(classes.where("m > 1"), "again")
    swept(docs.sparkSession)
    kept = []

    def signs_of(nodes: DataFrame) -> DataFrame:
        """The first paragraph of each node, with its sketch; bands and shingles are equal in all that have them."""
        of = found.join(nodes.select(F.col("node").alias("key")), "key")
        what = F.max_by(F.struct("bands", "grams"), F.size("bands")).alias("y")
        got = of.groupBy(F.col("key").alias("node")).agg(F.min(place).alias("first"), F.first("n").alias("n_shingles"), F.first("odd").alias("odd"), what)
        kept.append(staged(got.select("node", "first", "n_shingles", "odd", "y.*"), "first"))
        return kept[0]

    label = similar_components(found.where(F.size("bands") > 0).select(F.col("key").alias("node"), "bands"), signs_of, None, percent, words=WORDS, samples=max(SAMPLES, bands * ROWS))
    label = staged(label.select(F.col("node").alias("key"), "component"), "labels")
    swept(docs.sparkSession)

    own = kept[0].join(label.select(F.col("key").alias("node")), "node", "left_semi").select(F.col("node").alias("key"), "first", F.lit(1).cast("long").alias("m"))
    alone = own.join(again.select("key"), "key", "left_anti")
    classes = again.union(alone).join(label, "key", "left").withColumn("c", F.coalesce("component", "key"))
    classes = staged(classes.select("key", "first", "m", "c"), "classes")
    heads = classes.groupBy("c").agg(F.min("first").alias("head"))
    heads = staged(classes.join(heads, "c").select("key", "head", "m"), "heads")
    each = join_hot(found.select("id", "rid", "u", "w", "s", "e", "key"), heads, ["key"], "m").select("id", "rid", "u", "w", "s", "e", "head")
    each = staged(each.withColumn("kept", place.eqNullSafe(F.col("head"))), "each")
    for x in (found, again, classes, heads, kept[0]):
        dropped(x)
    swept(docs.sparkSession)
    # Repeats side by side are one passage. Windows are a text's own paragraphs.
    text = Window.partitionBy("id", "rid")
    gone = each.where("not kept").withColumn("k", F.col("u") - F.row_number().over(text.orderBy("u")))
    passage = Window.partitionBy("id", "rid", "k")
    gone = gone.withColumns({"total": F.sum("w").over(passage), "run": F.min("s").over(passage)}).where(F.col("total") >= run)
    gone = staged(gone.select("id", "rid", "s", "e", "w", "run", "head", "kept"), "gone")
    keep = each.where("kept").join(small(gone.select("head").distinct()), "head", "left_semi").select("id", "rid", "s", "e", "w", F.col("s").alias("run"), "head", "kept")
    return gone.union(keep).select("id", "rid", "s", "e", F.col("w").alias("n_words"), "run", F.col("head.id").alias("first_id"), "kept")


def passages(repeated: DataFrame) -> DataFrame:
    """(id, rid, s, e, n_words) of the passages that go, from the rows of repeated_paragraphs."""
    return repeated.where("not kept").groupBy("id", "rid", F.col("run").alias("s")).agg(F.max("e").alias("e"), F.sum("n_words").alias("n_words"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with the text rid of repeated passages but the first, and removed (their code points) added.

    Null texts stay null; rows that repeat are edited alike; a column removed of docs, if any, is replaced.
    """
    docs, back = carrying(docs, id_col, text_col)
    gone = passages(repeated_paragraphs(docs, id_col=id_col, text_col=text_col, **kw))
    gone = gone.groupBy(F.col("id").alias("_id"), F.col("rid").alias("_rid")).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_runs"))
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_rid")), "left")
    out = out.withColumn("removed", F.coalesce("_runs", F.array().cast("array<struct<s:int,e:int>>")))
    ends = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["e"]))
    starts = F.concat(F.transform("removed", lambda r: r["s"]), F.array(F.length(text_col)))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda g: F.substring(F.col(text_col), g["e"] + 1, g["s"] - g["e"])), "")
    return back(out.withColumn(text_col, F.when(F.size("removed") > 0, kept).otherwise(F.col(text_col))), "removed")
