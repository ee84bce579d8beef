"""Audit of how filters interact: what each removes in every order they may be applied.

Every text gets a mask of the filters it fails. Failing is a matter of the text and its duplicates alone, never of the
order, so 32 counts a part (one for each mask) hold all there is to know: what any order keeps and removes at any step are
sums of some of them.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, word_list

FILTERS = "ABCDE"
#: The filters that a text fails by itself; the last is failed by those that repeat an earlier id's text.
ALONE, REPEATS = 4, 16
_CELLS = 1 << len(FILTERS)
#: Orders in which exactly the filters of a set of this size, then one given filter, come first.
_ORDERS = (24, 6, 4, 6, 24)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words, capitals = word_list(text), F.regexp_count(text, F.lit("[A-Z]"))
    fails = (
        n_words(text) < 100,
        F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(80),
        capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of documents a part and mask, and those labelled good and toxic.

    Texts are told apart by SHA-256. A text's least id is the minimum over the groups of rows that agree in all but the
    id, of which there are few a text however often it is repeated; no group is gathered.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("q"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("t"))
    marks = marks.where("id is not null and (q or t)")
    of = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failures(F.col("text")).alias("m"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("h"),
    )
    kind = ["h", "m", "part", "q", "t"]
    # Ids that are null meet no label; their rows are spread by their text instead of by the id.
    known = of.where("id is not null").join(marks, "id", "left").fillna(False, ["q", "t"])
    known = known.groupBy("id", *kind).agg(F.count("*").alias("n")).groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    unknown = of.where("id is null").groupBy("h", "m", "part").agg(F.count("*").alias("n"))
    groups = known.select(*kind, "n", "first").unionByName(unknown.withColumns({"q": F.lit(False), "t": F.lit(False)}), allowMissingColumns=True)
    least = groups.groupBy("h").agg(F.min("first.id").alias("least"), F.collect_list(F.struct("m", "part", "q", "t", "n", "first")).alias("g"))
    each = least.select("least", F.inline("g"))
    # Rows of the least id, and rows without one, repeat no smaller id.
    unique = F.when(F.col("first").isNull(), F.col("n")).when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = each.select("part", "q", "t", F.explode(F.array(F.struct(F.col("m").alias("mask"), unique.alias("n")), F.struct((F.col("m") + REPEATS).alias("mask"), (F.col("n") - unique).alias("n")))).alias("c"))
    amount = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(amount).alias("n"), F.sum(F.when(F.col("q"), amount).otherwise(0)).alias("good"), F.sum(F.when(F.col("t"), amount).otherwise(0)).alias("toxic")).where("n > 0")


def _steps() -> list[tuple]:
    """(order, step, bits of the filters before, bit of this one) for every order and step."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[k] for k in order), step + 1, sum(1 << k for k in order[:step]), 1 << f))
    return out


def orders(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts by mask (part, mask, n, good, toxic)."""
    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    at = lambda sets, hit, value: F.transform(F.array(*map(F.lit, sets)), lambda s: F.aggregate(F.filter("cells", lambda c: hit(c["mask"], s)), F.lit(0).cast("long"), lambda sum_, c: sum_ + c[value]))
    # passed[S]: rows that fail no filter of S. What S leaves and f then removes is passed[S] - passed[S + f].
    passed = [at(range(_CELLS), lambda mask, s: mask.bitwiseAND(s) == 0, x).alias(f"p_{x}") for x in ("n", "good", "toxic")]
    per = per.select("part", *passed, at([1 << k for k in range(len(FILTERS))], lambda mask, s: mask == s, "n").alias("sole"))

    # Literals of hundreds of fields go in as text: one call to the JVM instead of one a field.
    pairs = lambda f: [(s, s | f, _ORDERS[s.bit_count()]) for s in range(_CELLS) if not s & f]
    worth = [f"aggregate(array({', '.join(f'struct({b} b, {a} a, {w}L w)' for b, a, w in pairs(1 << k))}), 0L, (x, y) -> x + (p_n[y.b] - p_n[y.a]) * y.w)" for k in range(len(FILTERS))]
    plan = ", ".join(f"struct('{o}' filter_order, {s} step, {b} b, {b | f} a, {f} f, {f.bit_length() - 1} k)" for o, s, b, f in _steps())
    per = per.withColumn("worth", F.expr(f"array({', '.join(worth)})"))
    rows = per.select("*", F.inline(F.expr(f"array({plan})")))
    lost = lambda x: F.get(f"p_{x}", F.col("b")) - F.get(f"p_{x}", F.col("a"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("p_n", F.col("a")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("p_n", F.lit(0)) - F.get("p_n", F.col("f")) - lost("n")).alias("redundant"),
        F.get("sole", F.col("k")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("worth", F.col("k")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language; null: ''), order of the five filters and step: what is kept, removed and lost there.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are not looked at. Filters: A under 100 words;
    B 100 * distinct words < 80 * words; C 100 * A-Z > 10 * code points; D any of #$%&*|; E the text of a smaller id.
    Null texts are empty ones. Rows that repeat an id with its text repeat no smaller id, so E keeps them; a null id is
    smaller than none and none is smaller than it. An id is good or toxic if any of its labels says so. Ties do not
    arise: counts have no order. Without rows there are no parts and no rows.
    """
    return orders(masked(docs, labels))
