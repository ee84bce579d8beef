"""Personal data: identifiers by pattern, and the words that give them away.

A term t discloses an entity e (an address, a card, a phone) as far as knowing t lowers the information of e:
1 - IC(e|t) / IC(e), with IC(e) = -ln(n(e) / N) and IC(e|t) = -ln(n(e, t) / n(t)), counted in documents over the whole
corpus. Terms near an entity that exceed GENERALISE are replaced by a general form, those that exceed REMOVE are taken
out. A pair must be seen in two different texts, or every rare word near an entity would disclose it.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carrying, join_hot, small, staged

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 10  # words on either side, within the line
GENERALISE, REMOVE = 0.8, 0.95

# The patterns of the base kinds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\w{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign is tried once with the run of local characters before it, so long runs cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            yield start, hit.end()
        free = hit.end() if hit else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    odd = [int(d) for d in reversed(digits)]
    return sum(odd[::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def find_pii(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every identifier, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if len(m[0]) < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub(r'[^0-9]', '', value)}"


def _near(text: str, found: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words within NEAR words of an entity in its line, outside all entities."""
    if not found:
        return []
    words = [m.span() for m in _TERM.finditer(text)]
    begins, ends = [s for s, _ in words], [e for _, e in words]
    blocked = sorted((s, e) for _, s, e in found)
    first, until, reach = [s for s, _ in blocked], [], 0  # how far the entities up to each one reach
    for _, e in blocked:
        reach = max(reach, e)
        until.append(reach)

    def free(s: int, e: int) -> bool:
        at = bisect.bisect_left(first, e)
        return not at or until[at - 1] <= s

    out = []
    for kind, s, e in found:
        low, high = text.rfind("\n", 0, s) + 1, text.find("\n", e)
        high = len(text) if high < 0 else high
        upto, after = bisect.bisect_right(ends, s), bisect.bisect_left(begins, e)
        around = words[max(bisect.bisect_left(begins, low), upto - NEAR) : upto] + words[after : min(bisect.bisect_right(ends, high), after + NEAR)]
        name = _entity(kind, text[s:e])
        out += [(name, text[a:b].lower(), a, b) for a, b in around if free(a, b)]
    return out


_SPAN = "array<struct<kind:int,s:int,e:int>>"


def _scanned(docs: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            found = [find_pii(t) for t in texts]
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "rid": [hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t in texts],
                    "base": [[{"kind": k, "s": s, "e": e} for k, s, e in f] for f in found],
                    "near": [[{"entity": n, "term": t, "s": s, "e": e} for n, t, s, e in _near(x, f)] for x, f in zip(texts, found, strict=True)],
                }
            )

    return docs.mapInPandas(run, f"id {kind}, rid string, base {_SPAN}, near array<struct<entity:string,term:string,s:int,e:int>>")


def _term_counts(docs: DataFrame) -> DataFrame:
    """Documents holding each term, over whole texts; added up within a batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                seen: Counter = Counter()
                for t in pdf["text"].iloc[at : at + 2000]:
                    seen.update(set(_TERM.findall((t or "").lower())))
                if not seen:
                    continue
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return docs.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, n_et, disclosure) of the pairs seen in two different texts at least, in n_et rows."""
    near = scanned.where(F.size("near") > 0).select("rid", F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"], x["term"]))).alias("near"))
    flat = near.select("rid", F.explode("near").alias("x")).select("rid", F.col("x.entity").alias("entity"), F.col("x.term").alias("term"))
    pairs = flat.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi")
    pairs = staged(pairs.select("entity", "term", "n_et"), "pairs")
    n_e = near.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    total = float(max(1, scanned.count()))
    # A term may stand near a third of all entities, an entity beside a third of all terms: both are joined by join_hot.
    per_term = staged(_term_counts(texts).join(small(pairs.groupBy("term").agg(F.count("*").alias("m"))), "term"), "terms")
    per_entity = staged(n_e.join(small(pairs.groupBy("entity").agg(F.count("*").alias("m"))), "entity"), "entities")
    all_ = join_hot(join_hot(pairs, per_term, ["term"], "m").drop("m"), per_entity, ["entity"], "m")
    prior = -F.log(F.least(F.col("n_e") / total, F.lit(0.999999)))
    given = -F.log(F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0)))
    return all_.select("entity", "term", "n_et", (1 - given / prior).alias("disclosure"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per document: id, base spans (kind, s, e) and terms (s, e, remove) to generalise or take out.

    Offsets count code points, ends are exclusive. Null and empty texts give empty arrays; rows of equal id and text
    get equal results; null ids stay; other columns are not looked at; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = staged(_scanned(rows, kind), "pii")
    given = staged(disclosures(scanned, rows.select("text")).where(F.col("disclosure") >= generalise), "disclosing")
    flat = scanned.where(F.size("near") > 0).select("id", "rid", F.explode("near").alias("x"))
    flat = flat.select("id", "rid", F.col("x.entity").alias("entity"), F.col("x.term").alias("term"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    hits = join_hot(flat, given, ["entity", "term"], "n_et").groupBy("id", "rid", "s", "e").agg(F.max(F.col("disclosure") >= remove).alias("remove"))
    hits = hits.groupBy(F.col("id").alias("id2"), F.col("rid").alias("rid2")).agg(F.array_sort(F.collect_set(F.struct("s", "e", "remove"))).alias("terms"))
    out = scanned.drop("near").join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("rid") == F.col("rid2")), "left")
    return out.select(F.col("id").alias(id_col), "rid", "base", F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,remove:boolean>>")).alias("terms"))


def replaced(text: str | None, base: list, terms: list) -> str | None:
    """The text with identifiers named by kind, disclosing terms generalised to their shape, or taken out."""
    if text is None:
        return None
    edits = [(x["s"], x["e"], f"[{KINDS[x['kind']]}]") for x in base]
    edits += [(x["s"], x["e"], "" if x["remove"] else "[number]" if text[x["s"] : x["e"]].isdigit() else "[word]") for x in terms]
    out, at = [], 0
    for s, e, new in sorted(edits):
        if s >= at:
            out += [text[at:s], new]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with the text sanitised; all other columns as they are."""
    docs, back = carrying(docs, id_col, text_col)
    found = personal_data(docs, id_col, text_col, **kw).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates([id_col, "rid"])
    found = found.select(F.col(id_col).alias("_i"), F.col("rid").alias("_r"), F.col("base").alias("_b"), F.col("terms").alias("_t"))

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.blake2b((t or "").encode(), digest_size=16).hexdigest())

    @F.pandas_udf("string")
    def edit(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, b if b is not None else [], x if x is not None else []) for t, b, x in zip(texts, base, terms, strict=True)])

    keyed = docs.withColumn("_d", digest(text_col))
    out = keyed.join(found, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_d") == F.col("_r")), "left")
    return back(out.withColumn(text_col, edit(text_col, "_b", "_t")))
