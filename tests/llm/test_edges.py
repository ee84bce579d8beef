"""Every operator and stage on nulls, repeats, empty tables, long texts and clashing names; the queries against their SQL."""

import os
from glob import glob

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_contracts import filler
from tidemark.llm import decontamination, language_id, license_scan, line_dedup, media, mixing, near_dedup, pii, queries, secret_scan, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, value int, node string, w int, h long, component string"
SF = "/root/testdata/sf0.001"


#: Names that operators use inside, as columns of the caller.
INSIDE = "_id _rid _at _runs _h _l _kept _k _n _p _i _r _b _t _d _m _x _key _size _whole _from _to _e _s key size shard c s e j i m n u blocks band bands odd grams member first head kept again run rest plan number part start begin end quota target taken component_id removed n_removed n_lines copy taken_words lang_pred score rejected terms base added found".split()


def crowded(df):
    """df with a column of every such name."""
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in INSIDE))


CARRY = {
    "lines": (lambda d, b: line_dedup.line_dedup(d), {"n_lines", "removed", "n_removed"}),
    "paragraphs": (lambda d, b: substring_dedup.substring_dedup(d), {"removed"}),
    "leaks": (lambda d, b: decontamination.decontaminated(d, b), set()),
    "languages": (lambda d, b: language_id.identified(d, language_id.learn(d)), {"lang_pred", "score", "rejected"}),
    "mixture": (lambda d, b: mixing.mixture(d), {"copy", "taken_words"}),
    "sanitised": (lambda d, b: pii.sanitised(d), set()),
}


@pytest.mark.parametrize("name", sorted(CARRY))
def test_any_column_of_the_caller_comes_back(spark, name):
    """Columns named as those inside an operator come back as they were, but for those that it adds."""
    run, adds = CARRY[name]
    df, bench = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(BENCH, "item_id long, text string")
    plain, got = run(df, bench), run(crowded(df), bench)
    assert set(got.columns) == set(plain.columns) | set(INSIDE)
    assert [c for c in got.columns if c not in adds] == [c for c in crowded(df).columns if c not in adds]
    own = [c for c in INSIDE if c not in adds]
    assert got.where(" or ".join(f"`{c}` is null or `{c}` <> 'own {c}'" for c in own)).count() == 0
    shown = lambda x: sorted(map(repr, x.select(*sorted(plain.columns)).collect()))
    assert shown(got) == shown(plain) and got.count() > 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_carry_any_column(spark, tmp_path, k):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = crowded(spark.createDataFrame(rows(), SCHEMA))
    got = corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path))
    last = k == len(corpus_pipeline.STAGES) - 1
    own = [c for c in INSIDE if not (last and c in ("copy", "taken_words"))]
    assert set(got.columns) == set(df.columns) and (last or got.columns == df.columns)
    assert got.where(" or ".join(f"`{c}` is null or `{c}` <> 'own {c}'" for c in own)).count() == 0 < got.count()


def rows():
    long = filler(1, 40_000) + "\n" + filler(2, 3000).replace(".", ".\n")
    texts = [None, "", " \n\n ", "x", long, long, filler(3, 60), filler(3, 60), "\U0001f600 é ß", "a\nb\nc\nd\na\nb\nc\nd", "token=abcdef12 joe@x.org"]
    made = [(k % 8, t, "en" if k % 3 else None, None if k == 6 else "s", 1, "i", 2, "n", 3, 4, "c") for k, t in enumerate(texts)]
    return made + [made[4], made[7], (None, filler(3, 60), "en", "s", 1, "i", 2, "n", 3, 4, "c"), (None, None, None, None, None, None, None, None, None, None, None)]


BENCH = [(1, filler(3, 60)), (1, filler(3, 60)), (None, None), (2, ""), (3, filler(9, 20))]

OPERATORS = {
    "secrets": lambda d, b: secret_scan.secrets(d),
    "personal_data": lambda d, b: pii.personal_data(d),
    "sanitised": lambda d, b: pii.sanitised(d),
    "identified": lambda d, b: language_id.identified(d, language_id.learn(d)),
    "mixed": lambda d, b: mixing.mixed_documents(d),
    "lines": lambda d, b: line_dedup.line_dedup(d),
    "media": lambda d, b: media.media_columns(d),
    "licenses": lambda d, b: license_scan.license_scan(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_in_rows_out(spark, name):
    """Operators of a row a document keep every row, whatever it holds, and take an empty table."""
    df, bench = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(BENCH, "item_id long, text string")
    got = OPERATORS[name](df, bench)
    assert len(got.collect()) == len(rows())
    assert OPERATORS[name](df.limit(0), bench).count() == 0


def test_near_components_edges(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = near_dedup.near_components(df).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[4] == by[5] == {4} and by[6] == by[7] == {6} and by[None] == {None}
    assert all(len(v) == 1 for v in by.values())
    assert near_dedup.near_components(df.limit(0)).count() == 0


def test_paragraph_edges(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = substring_dedup.substring_dedup(df).collect()
    assert len(got) == len(rows()) and [f for f in df.columns] == [f for f in df.columns if f in got[0].asDict()]
    assert sum(r.text is None for r in got) == 2
    kept = [r for r in got if r.doc_id in (4, 5) and r.text and len(r.text) > 100_000]
    assert len(kept) == 2  # both rows of id 4; 5 lost its copy
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_leak_edges(spark):
    df, bench = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(BENCH, "item_id long, text string")
    left = decontamination.decontaminated(df, bench)
    assert left.columns == df.columns and not left.where(F.col("text") == filler(3, 60)).count()
    assert left.count() == sum(r[1] != filler(3, 60) for r in rows())
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, k):
    """A stage keeps the columns, all but the last give no new ones, and an empty table stays empty."""
    name, stage = corpus_pipeline.STAGES[k]
    df = spark.createDataFrame(rows(), SCHEMA)
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, df, str(tmp_path))
    last = k == len(corpus_pipeline.STAGES) - 1
    assert got.columns == df.columns + ["copy", "taken_words"] * last
    assert (got.count() <= len(rows())) or last
    empty = stage(spark, df.limit(0), str(tmp_path))
    assert empty.count() == 0
    if name == "near-dedup":
        assert sorted(r.doc_id for r in got.where(F.col("text") == filler(3, 60)).collect() if r.doc_id is not None) == [6]
    if name == "decontamination":
        assert got.where(F.col("text") == filler(3, 60)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    plain = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns)[:2]).sort_values("doc_id", kind="stable").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(queries.QUERIES[name](spark, SF).toPandas()), plain(con.sql(queries.SQL[name]).df()), check_dtype=False)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_runs_and_leaves_the_mix(spark):
    got = corpus_pipeline.run(spark, SF)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns == [*d.columns, "copy", "taken_words"] and 0 < got.count()
    assert got.join(d, "doc_id", "left_anti").count() == 0
