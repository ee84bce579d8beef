"""Digests under any order, partitions and cell; persisted features; the experiment registry and its order."""

import datetime as dt
import json
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests
from tidemark.operators import persisted
from tidemark.sources import experiments
from tidemark.sources.store import Store

SCHEMA = "session date, a double, b double, s string, n long, flag boolean, at timestamp, xs array<double>, m map<string,int>, o struct<z:int,y:string>"


def rows(n=60):
    rng, day = random.Random(1), dt.date(2024, 1, 1)
    words = ["x", "é", "\U0001f600 q", 'say "hi"\\n\n', "", None, "\u2028\x01"]
    out = []
    for k in range(n):
        out.append((day + dt.timedelta(days=k), rng.choice([0.0, -0.0, 1 / 3, 1e-300, 123456789.123456, None]), rng.random(), rng.choice(words), k, k % 2 == 0, dt.datetime(2024, 1, 1, 3, k % 60), [1.0, None, rng.random()], {"b": k, "a": None}, (k, rng.choice(words))))
    return out


def test_row_text_is_json_in_ascii_with_sorted_keys(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = df.select(digests.row_json(df).alias("j"), *df.columns).collect()
    for r in got:
        assert r.j.isascii() and " " not in r.j.replace(json.dumps(r.s)[1:-1], "").replace(json.dumps(r.o.y)[1:-1], "")
        back = json.loads(r.j)
        assert list(back) == sorted(back) and list(back["o"]) == ["y", "z"] and list(back["m"]) == ["a", "b"]
        assert back["s"] == r.s and back["o"] == {"y": r.o.y, "z": r.o.z} and back["n"] == r.n and back["flag"] == r.flag and back["m"] == r.m
        assert back["a"] == (None if r.a is None else float(f"{r.a:.12g}")) and back["xs"][1] is None and back["xs"][2] == pytest.approx(r.xs[2], rel=1e-11)
        assert back["session"] == str(r.session) and back["at"] == r["at"].isoformat(timespec="microseconds")


def test_table_digest_knows_the_rows_alone(spark):
    data = rows()
    of = lambda df, **kw: digests.table_digest(df, **kw).first()
    df = spark.createDataFrame(data, SCHEMA)
    base = of(df)
    random.Random(2).shuffle(data)
    assert of(spark.createDataFrame(data, SCHEMA).repartition(7)) == base and of(df.coalesce(1).select(*reversed(df.columns))) == base and base.n == 60
    assert of(df.union(df.limit(1))).digest != base.digest and of(df.where("n > 0")).digest != base.digest
    for c in df.columns:
        other = {"session": F.date_add("session", 1), "a": F.coalesce(F.col("a"), F.lit(0.0)) + 1, "b": F.col("b") * (1 + 1e-10), "s": F.concat(F.coalesce("s", F.lit("")), F.lit("!")), "n": F.col("n") + 1, "flag": ~F.col("flag"), "at": F.col("at") + F.expr("INTERVAL 1 MICROSECOND")}.get(c)
        if other is not None:
            assert of(df.withColumn(c, F.when(F.col("n") == 17, other).otherwise(F.col(c)))).digest != base.digest, c
    assert of(df.withColumn("b", F.col("b") * (1 + 1e-15))) == base  # beyond twelve digits
    assert of(df.withColumnRenamed("a", "c")).digest != base.digest
    per = digests.table_digest(df, by=("flag",)).collect()
    assert {r.n for r in per} == {30} and len({r.digest for r in per}) == 2
    assert of(df.limit(0)).n == 0 and digests.table_digest(df.limit(0), by=("flag",)).count() == 0
    with pytest.raises(Exception, match="finite"):
        of(spark.createDataFrame([(math.nan,)], "a double"))


def test_features_are_persisted_with_versions(spark, tmp_path):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    vol = spark.createDataFrame([(day(k), float(k), math.inf if k == 3 else 0.5) for k in range(10)], "session date, tr double, rv double")
    tech = spark.createDataFrame([(day(k), k / 7) for k in range(2, 12)], "session date, rsi double")
    store = Store(spark, str(tmp_path), {"derived.vol": persisted.feature_schema(["tr", "rv"]), "derived.tech": persisted.feature_schema(["rsi"]), "derived.labels": persisted.label_schema()})
    specs = {"vol": {"window": 14}, "tech": {"window": 14, "name": "é"}}
    frames = {"vol": (vol, ["tr", "rv"]), "tech": (tech, ["rsi"])}
    write = lambda fr, sp, at: persisted.persist(store, fr, sp, "SPX", at, before="2024-01-10")
    assert write(frames, specs, "2024-02-01 00:00:00") == {"vol": {"new": 7}, "tech": {"new": 7}}
    assert write(frames, specs, "2024-02-02 00:00:00") == {"vol": {"unchanged": 7}, "tech": {"unchanged": 7}}
    changed = vol.withColumn("tr", F.when(F.col("session") == F.lit(day(5)), -1.0).otherwise(F.col("tr")))
    assert write({**frames, "vol": (changed, ["tr", "rv"])}, specs, "2024-02-03 00:00:00")["vol"] == {"unchanged": 6, "revise": 1}
    got = {r.as_of: r for r in store.current("derived.vol").collect()}
    assert sorted(got) == [day(k) for k in range(2, 9)] and got[day(3)].rv is None and (got[day(5)].tr, got[day(5)].version) == (-1.0, 2)
    assert len({r.feature_version for r in got.values()}) == 7 and len({r.row_sha256 for r in got.values()}) == 7
    assert write(frames, {**specs, "vol": {"window": 15}}, "2024-02-04 00:00:00")["vol"] == {"revise": 7}
    with pytest.raises(Exception, match="repeats"):
        persisted.feature_records(vol.union(vol), "vol", ["tr", "rv"], {}, "SPX", "2024-02-01 00:00:00").collect()
    labels = spark.createDataFrame([(day(k), "target", "stop", 0.1, -0.1) for k in range(3)], "session date, label_long string, label_short string, ret_long double, ret_short double")
    assert store.replace("derived.labels", persisted.label_records(labels, "SPX", "2024-02-01 00:00:00")) == {"new": 3}


def test_one_writer_wins(spark, tmp_path):
    registry = experiments.Registry(spark, str(tmp_path))
    config, result = {"family": "elasticnet", "l1": 0.5}, {"sharpe": 0.3}
    won = []
    threads = [threading.Thread(target=lambda: won.append(registry._exclusive(f"{tmp_path}/runs/{registry.digest(config)}", f'{{"writer": {k}}}'))) for k in range(16) for k in [k]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 15 + [True]
    other = experiments.Registry(spark, f"{tmp_path}/more")
    name, first = other.record(config, result, "2024-01-01")
    assert first and other.record(dict(reversed(config.items())), result, "2024-05-05") == (name, False)
    with pytest.raises(ValueError, match="another result"):
        other.record(config, {"sharpe": 0.4}, "2024-01-01")
    other.record({**config, "l1": 0.6}, {"sharpe": 0.5}, "2024-01-02")
    got = {r.config_sha256: r for r in other.load().collect()}
    assert len(got) == 2 and got[name].sharpe == 0.3 and got[name].family == "elasticnet" and got[name].as_of == "2024-01-01" and all(r.sound for r in got.values())
    n = other.trials(extra=3).first()
    assert n.n_trials == 5 and n.variance == pytest.approx(0.02)


def test_the_order_of_candidates_is_total(spark):
    kind = "g string, brier_score double, log_loss double, family string, run_sha256 string"
    data = [
        ("brier", 0.2, 0.9, "lightgbm", "b"), ("brier", 0.21, 0.1, "elasticnet", "a"),
        ("loss", 0.2 + 1e-13, 0.5, "lightgbm", "b"), ("loss", 0.2, 0.6, "elasticnet", "a"),
        ("family", 0.2, 0.5, "lightgbm", "a"), ("family", 0.2, 0.5 + 1e-13, "elasticnet", "b"), ("family", 0.2, 0.5, "other", "0"),
        ("hash", 0.2, 0.5, "elasticnet", "b"), ("hash", 0.2, 0.5, "elasticnet", "a"), ("hash", 0.2, 0.5, "elasticnet", "a"),
        ("open", 0.2, 0.5, "elasticnet", "a"), ("open", None, 0.5, "elasticnet", "b"),
    ]
    df = spark.createDataFrame(data, kind)
    assert {r.g: r.run_sha256 for r in experiments.chosen(df, ("g",)).collect()} == {"brier": "b", "loss": "b", "family": "b", "hash": "a"}
    assert [r.run_sha256 for r in experiments.chosen(df.where("g = 'loss'")).collect()] == ["b"]
