"""The registered queries of the corpus operators, thin over the operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Words of `text` with A-Z in lower case, in DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op1_randomness_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import secrets, span_text

    found = secrets(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query("op2_information_theoretic_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import KINDS, personal_data
    from tidemark.llm.secret_scan import span_text

    found = personal_data(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    added = F.transform("terms", lambda x: F.struct(F.lit(4).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    counts = [of(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"), span_text(F.concat("base", added), KINDS).alias("spans"))


@query("op3_centroid_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import held_out, identified, learn

    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_sainte_lague_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixed_documents

    return mixed_documents(tables(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op5_window_line_dedup",
    r"""
    WITH lines AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
    win AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS p, l FROM lines WHERE len(l) >= 3),
    keyed AS (SELECT doc_id, p, l[p + 1 : p + 3] AS w FROM win WHERE trim(l[p + 1]) <> '' OR trim(l[p + 2]) <> '' OR trim(l[p + 3]) <> ''),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM keyed),
    gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM ranked WHERE r > 1),
    per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
    SELECT lines.doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(coalesce(len(ps), 0) AS INTEGER) AS n_removed,
        CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda k: NOT list_contains(ps, k)), lambda k: l[k + 1]), chr(10)) END AS text
    FROM lines LEFT JOIN per USING (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import line_dedup

    return line_dedup(tables(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query("op6_paragraph_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with repeated passages: what goes, and the documents whose paragraphs it repeats."""
    from tidemark.llm.substring_dedup import repeated_paragraphs

    found = repeated_paragraphs(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = found.groupBy("id", "run", "kept").agg(F.max("e").alias("e"), F.sum("n_words").alias("w"), F.collect_set("first_id").alias("f"))
    gone = F.when(~F.col("kept"), F.struct("run", "e"))
    per = runs.groupBy(F.col("id").alias("doc_id")).agg(
        F.array_sort(F.collect_set(gone)).alias("r"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("w"))), F.lit(0)).alias("words_removed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("first_doc_ids")
    )
    text = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["run"].cast("string"), x["e"].cast("string"))), ",")
    return per.select("doc_id", F.size("r").cast("long").alias("n_removed"), "words_removed", text.alias("removed"), "first_doc_ids")


@query("op7_wav_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.media import media_columns

    out = media_columns(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    coded = F.concat_ws(",", F.transform(F.arrays_zip("times", "hashes"), lambda x: F.concat_ws(":", x["times"].cast("string"), x["hashes"].cast("string"))))
    return out.withColumn("feature", F.concat_ws("|", F.size("hashes").cast("string"), F.sha2(coded, 256)))


@query("op8_conditional_compression_licenses")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import license_scan

    found = license_scan(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["s"].cast("string"), x["e"].cast("string")))
    exact = F.size(F.filter("found", lambda x: F.size(x["differences"]) == 0)).cast("long")
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), exact.alias("n_exact"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"), F.array_join(named, ",").alias("spans"))


@query(
    "op9_containment_decontamination",
    r"""
    WITH texts AS (SELECT doc_id AS id, 0 AS side, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
        UNION ALL SELECT item_id, 1, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
    sets AS (SELECT id, side, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) END AS s FROM texts),
    flat AS (SELECT id, side, len(s) AS n, unnest(s) AS g FROM sets)
    SELECT d.id AS doc_id, i.id AS item_id, CAST(i.n AS BIGINT) AS n_shingles, count(*) AS n_shared, count(*) / i.n AS containment
    FROM flat d JOIN flat i ON d.g = i.g AND d.side = 0 AND i.side = 1 GROUP BY d.id, i.id, i.n HAVING 5 * count(*) >= 4 * i.n
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import leaks

    found = leaks(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", "containment")


@query(
    "op10_odd_sketch_near_dedup",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM words),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
        GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.c = e.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
    FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_components

    return near_components(tables(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


@query("op11_attention_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    return quality(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("op12_parity_band_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spelling_variants import spelling_variants

    return spelling_variants(tables(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op13_filter_interaction_audit",
    r"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    least AS (SELECT x, min(doc_id) AS lo FROM texts GROUP BY x),
    marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS q, bool_or(coalesce(toxic = 1, false)) AS t FROM labels GROUP BY doc_id),
    masked AS (SELECT part, coalesce(q, false) AS q, coalesce(t, false) AS t,
        (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x))::INT
        + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS mask
        FROM texts JOIN least USING (x) LEFT JOIN marks USING (doc_id)),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (q) AS good, count(*) FILTER (t) AS toxic FROM masked GROUP BY part, mask),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
    orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
    steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own, coalesce(list_sum(bits[1 : s - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS s FROM orders)),
    done AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, own)
    SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM done
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.filter_audit import filter_audit

    return filter_audit(tables(spark, sf_dir, "documents").select("doc_id", "text", "lang"), tables(spark, sf_dir, "labels"))
