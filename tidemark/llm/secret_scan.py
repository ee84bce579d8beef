"""Secret scan: credential patterns, and tokens that a battery of randomness tests takes for random keys.

Only DataFrame functions are used. Every token of 20 or more key characters is a candidate. Its encoding is the
smallest alphabet holding all its characters. Three kinds of tests judge it, each against two hypotheses:

* chi-squared of the character counts: how even they are, and how well they fit the letters of written language,
* runs: of characters above and below the alphabet's middle, and of digits, capitals, small letters and signs,
* serial correlation of neighbouring characters, and of vowels, which take turns with consonants in language.

Against uniform draws their p-values are joined by the Cauchy combination; a token that fails (below ALPHA) is no key.
Against written language and identifiers their deviations add up (Stouffer) to one p-value, the chance that words of that
length look so random. Those get false-discovery control (Benjamini-Hochberg) within classes of length, all encodings
together and over the whole corpus: short tokens deviate less, so they need to be rarer to be found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, alphabet in order, the sum of squared character shares that written language has in it, and the share of
#: neighbours of different kinds (digit, capital, small letter, sign) in words and identifiers; none where one kind is all.
ENCODINGS = (
    ("decimal", _D, 0.2, None),
    ("hex", _D + "abcdef", 0.12, 0.15),
    ("HEX", _D + "ABCDEF", 0.12, 0.15),
    ("lower", _L, 0.066, None),
    ("upper", _U, 0.066, None),
    ("base32", _U + "234567", 0.06, 0.15),
    ("lower36", _D + _L, 0.058, 0.15),
    ("upper36", _D + _U, 0.058, 0.15),
    ("base62", _D + _U + _L, 0.055, 0.35),
    ("base64", _U + _L + _D + "+/", 0.055, 0.35),
    ("base64url", _U + _L + _D + "-_", 0.055, 0.35),
)
# Letters of English text in percent.
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
#: Correlation of vowels with the next character being one, in written language.
VOWELS, TURNS = "aeiouy", -0.3
#: Tokens failing the battery at this level aren't random; the share of false discoveries let in within a class of length.
ALPHA, FDR = 0.001, 0.01
_BINS = 400  # of twentieths of -log10 p


_HIT = "array<struct<s:int,e:int,t:string>>"


def _added_up(both: Column, start: Column) -> Column:
    """Gaps and matches array<struct<g, h>> as struct<p, o>: the offset after the last, and the spans from offset start."""

    def step(acc: Column, x: Column) -> Column:
        s = acc["p"] + F.length(x["g"])
        e = s + F.length(x["h"])
        return F.struct(e.alias("p"), F.concat(acc["o"], F.array(F.struct(s.alias("s"), e.alias("e"), x["h"].alias("t")))).alias("o"))

    return F.aggregate(both, F.struct(start.alias("p"), F.array().cast(_HIT).alias("o")), step)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, t>>: code point offsets and the matched text.

    The text between matches and the matches themselves, in turn, add up to the offsets. They are added up in pieces of
    the square root of their number, as an array is copied whenever it grows: n matches cost n * sqrt(n) steps.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))

    def pieces(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        firsts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int"))
        return F.transform(firsts, lambda k: _added_up(F.slice(x, k * size + 1, size), F.lit(0)))

    def joined(parts: Column) -> Column:
        zero = F.array(F.lit(0))
        offsets = F.aggregate(parts, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["p"])))
        moved = F.zip_with(parts, F.slice(offsets, F.lit(1), F.size(parts)), lambda part, at: F.transform(part["o"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["t"].alias("t"))))
        return F.flatten(moved)

    # Bound once by a transform over an array of one: an expression that is named twice would be evaluated twice.
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    return F.when(text.rlike(pattern), once(once(both, pieces), joined)).otherwise(F.array().cast(_HIT))


def below(z: Column) -> Column:
    """The normal distribution function (five-term rational tail)."""
    a = F.least(F.abs(z), F.lit(12.0))
    t = 1.0 / (1.0 + a * 0.2316419)
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = tail * F.exp(a * a * -0.5) * 0.3989422804014327
    return F.when(z < 0, tail).otherwise(1.0 - tail)


def battery(tokens: DataFrame, col: str = "token") -> DataFrame:
    """Adds encoding, n, p_random (of uniform draws) and p_words (of written language) to rows with a token.

    Tokens of mixed symbols that fit no encoding get a null encoding and null p-values.
    """
    bare = F.regexp_replace(col, "=+$", "")
    enc = F.lit(None).cast("string")
    for name, letters, *_ in reversed(ENCODINGS):
        enc = F.when(F.col("bare").rlike("^[" + letters.replace("-", r"\-") + "]+$"), F.lit(name)).otherwise(enc)

    def per(value) -> Column:
        out = F.lit(None)
        for e in ENCODINGS:
            out = F.when(F.col("encoding") == e[0], value(e)).otherwise(out)
        return out

    df = tokens.withColumn("bare", bare).withColumn("encoding", enc)
    letters = F.array(*(F.lit(-math.log(_smooth(c))) for c in _L))
    kinds = "0" * 10 + "l" * 26 + "U" * 26
    df = df.withColumns(
        {
            "n": F.length("bare").cast("double"),
            "k": per(lambda e: F.lit(float(len(e[1])))),
            "share": per(lambda e: F.lit(e[2])),
            "switch": per(lambda e: F.lit(e[3]).cast("double")),
            "high": per(lambda e: F.translate("bare", e[1], "0" * (len(e[1]) // 2) + "1" * (len(e[1]) - len(e[1]) // 2))),
            "x": per(lambda e: F.transform(F.filter(F.split("bare", ""), lambda c: c != ""), lambda c: F.instr(F.lit(e[1]), c).cast("double"))),
            "chars": F.array_distinct(F.filter(F.split("bare", ""), lambda c: c != "")),
            "kinds": F.regexp_replace(F.translate("bare", _D + _L + _U, kinds), "[^0lU]", "s"),
            "v": F.transform(F.filter(F.split(F.lower("bare"), ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(VOWELS), c) > 0, 1.0).otherwise(0.0)),
            "odd": F.filter(F.transform(F.split(F.lower("bare"), ""), lambda c: F.when(c != "", F.get(letters, F.instr(F.lit(_L), c) - 1))), lambda r: r.isNotNull()),
        }
    )
    count = lambda part: F.length("bare") - F.length(F.replace(F.col("bare"), part, F.lit("")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    df = df.withColumn("squares", F.aggregate("chars", F.lit(0.0), lambda s, c: s + F.pow(count(c).cast("double"), 2)))
    n, k = F.col("n"), F.col("k")
    changes = lambda col, marks: sum(F.length(F.regexp_replace(col, f"{m}+", m)) - F.length(F.replace(F.regexp_replace(col, f"{m}+", m), F.lit(m), F.lit(""))) for m in marks).cast("double") - 1
    df = df.withColumns(
        {
            "chi": k / n * F.col("squares") - n,
            "ones": F.length(F.replace(F.col("high"), F.lit("0"), F.lit(""))).cast("double"),
            "runs": 1 + changes("high", "01"),
            "switches": changes("kinds", "0lUs"),
            "mean": total(F.col("x")) / n,
            "mean_v": total(F.col("v")) / n,
        }
    )
    lag = lambda x, m: total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - F.col(m)) * (b - F.col(m))))
    around = lambda x, m: total(F.transform(x, lambda v: (v - F.col(m)) * (v - F.col(m))))
    df = df.withColumns({"around": around("x", "mean"), "lag": lag("x", "mean"), "around_v": around("v", "mean_v"), "lag_v": lag("v", "mean_v")})
    mu = 2 * F.col("ones") * (n - F.col("ones")) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    free = k - 1
    wilson = (F.cbrt(F.col("chi") / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    extra = n * (k * F.col("share") - 1)
    m, e_, sd = F.size("odd"), *_language()
    apart = (n - 1) * F.col("switch")
    # Against language: how even, how unlike its letters, how mixed in kind and how free of its turns a token is.
    even = (free + extra - F.col("chi")) / F.sqrt(2 * free + 4 * F.greatest(extra, F.lit(0.0)))
    unlike = F.when(m >= 8, (total(F.col("odd")) / m - e_) / sd * F.sqrt(m.cast("double")))
    mixed = (F.col("switches") - apart) / F.sqrt(apart * (1 - F.col("switch")))
    turns = F.when((m >= 8) & (F.col("around_v") > 0), (F.col("lag_v") / F.greatest(F.col("around_v"), F.lit(1e-12)) - TURNS) * F.sqrt(n))
    tests = [even, unlike, mixed, turns]
    # The first two look at the same counts: their correlation is taken as a half.
    weight = sum(F.when(t.isNotNull(), 1.0).otherwise(0.0) for t in tests) + F.when(unlike.isNotNull(), 1.0).otherwise(0.0)
    df = df.withColumns(
        {
            "z_chi": wilson,
            "z_runs": F.when(var > 0, (F.col("runs") - mu) / F.sqrt(F.greatest(var, F.lit(1e-12)))).otherwise(12.0),
            "z_serial": F.when(F.col("around") > 0, F.col("lag") / F.greatest(F.col("around"), F.lit(1e-12)) * F.sqrt(n)).otherwise(12.0),
            "p_words": below(sum(F.coalesce(t, F.lit(0.0)) for t in tests) / F.sqrt(weight) * -1),
        }
    )
    tests = [1 - below(F.col("z_chi")), 2 * (1 - below(F.abs("z_runs"))), 2 * (1 - below(F.abs("z_serial")))]
    cauchy = sum(F.tan((0.5 - F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))) * 3.141592653589793) for p in tests) / 3
    df = df.withColumn("p_random", 0.5 - F.atan(cauchy) / 3.141592653589793)
    return df.select(*tokens.columns, "encoding", "n", "p_random", "p_words")


def _smooth(letter: str) -> float:
    """The share of a letter in written language, a fifth of it spread evenly for other languages and names."""
    return 0.8 * LETTERS[letter] / sum(LETTERS.values()) + 0.2 / 26


def _language() -> tuple[float, float]:
    """Mean and deviation of -ln share of the letters of written language; the deviation widened by a fifth, as letters come in groups."""
    p = [_smooth(c) for c in _L]
    mean = -sum(x * math.log(x) for x in p)
    return mean, 1.2 * math.sqrt(sum(x * (math.log(x) + mean) ** 2 for x in p))


def discoveries(tested: DataFrame, fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """The tested tokens taken for keys: Benjamini-Hochberg on p_words within classes of length, two to a doubling.

    Chances are counted in bins, so the corpus shrinks to at most lengths x bins rows before anything is ordered, and
    the limits broadcast are one row a class. Ties share a bin and are found together.
    """
    binned = tested.where("encoding is not null").withColumns(
        {
            "stratum": F.least(F.floor(F.log2("n") * 2), F.lit(32)).cast("int"),
            "bin": F.least(F.floor(F.log10(F.greatest("p_words", F.lit(1e-20))) * -20), F.lit(_BINS)).cast("int"),
        }
    )
    counts = binned.groupBy("stratum", "bin").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("stratum")
    falling = whole.orderBy(F.desc("bin"))
    limits = (
        counts.withColumns({"m": F.sum("c").over(whole), "above": F.sum("c").over(falling)})
        .where(F.pow(F.lit(10.0), F.col("bin") / -20.0) * F.col("m") / F.col("above") <= fdr)
        .groupBy("stratum")
        .agg(F.min("bin").alias("from_bin"))
    )
    return binned.join(F.broadcast(limits), "stratum").where((F.col("bin") >= F.col("from_bin")) & (F.col("p_random") >= alpha)).drop("stratum", "bin", "from_bin")


def clear_of(found: DataFrame) -> DataFrame:
    """(id, rid, x) of the tokens of found (id, rid, base, tokens) that meet no base span; a text's spans are put in order once."""
    tokens = found.where(F.size("tokens") > 0).select("id", "rid", (F.size("base") > 0).alias("crowded"), F.explode("tokens").alias("x"))
    own = tokens.where("crowded").select("id", "rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), "x")
    fixed = found.where((F.size("tokens") > 0) & (F.size("base") > 0)).select("id", "rid", F.explode("base").alias("b"))
    both = own.unionByName(fixed.select("id", "rid", F.col("b.s").alias("s"), F.col("b.e").alias("e")), allowMissingColumns=True)
    upto = lambda order: Window.partitionBy("id", "rid").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    base_end = F.max(F.when(F.col("x").isNull(), F.col("e"))).over(upto(F.asc("s")))
    base_next = F.min(F.when(F.col("x").isNull(), F.col("s"))).over(upto(F.desc("s")))
    seen = both.withColumns({"base_end": base_end, "base_next": base_next}).where("x is not null")
    free = (F.coalesce("base_end", F.lit(0)) <= F.col("s")) & (F.col("base_next").isNull() | (F.col("base_next") >= F.col("e")))
    return tokens.where("not crowded").select("id", "rid", "x").union(seen.where(free).select("id", "rid", "x"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base (kind, s, e of the credential patterns) and added (the same of random tokens).

    Offsets count code points, ends are exclusive. Random tokens that overlap a base span are left out. Null and
    empty texts give empty arrays. Rows with equal id and text get equal results; a null id is kept as it is;
    other columns of docs are not looked at; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = lambda k, found: F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("kind"), x["e"].alias("e")))
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("rid"), text.alias("text"))
    found = raw.select(
        "id",
        "rid",
        F.filter(spans(F.col("text"), ASSIGN), lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 6).alias("assign"),
        spans(F.col("text"), ACCESS).alias("access"),
        spans(F.col("text"), HEX).alias("hex"),
        spans(F.col("text"), TOKEN).alias("tokens"),
    )
    base = F.array_sort(F.concat(kind(0, F.col("assign")), kind(1, F.col("access")), kind(2, F.col("hex"))))
    found = staged(found.select("id", "rid", base.alias("base"), "tokens"), "secrets")
    tokens = clear_of(found).select("id", "rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.t").alias("token")).distinct()
    picked = discoveries(staged(battery(tokens), "battery")).groupBy("id", "rid").agg(F.array_sort(F.collect_set(F.struct("s", F.lit(3).alias("kind"), "e"))).alias("added"))
    picked = picked.select(F.col("id").alias("id2"), F.col("rid").alias("rid2"), "added")
    out = found.drop("tokens").join(picked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("rid") == F.col("rid2")), "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast("array<struct<s:int,kind:int,e:int>>")).alias("added"))


def span_text(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span in order, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
