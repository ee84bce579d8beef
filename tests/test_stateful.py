"""Streams leave what the same plan over a table leaves: the store's sink, state across sessions, horizons; intervals; callables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import deciding, engine, intervals, labels
from tidemark.sources.store import Store
from tidemark.streaming import horizon, sink, state

RECORD = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("series_id", T.StringType()), T.StructField("as_of", T.DateType()), T.StructField("fetched_at", T.TimestampType()), T.StructField("published_at", T.TimestampType()), T.StructField("version", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("note", T.StringType())]
)
KEY = ("source", "series_id", "as_of", "fetched_at", "version", "value", "note")


def records(seed=1, n=300):
    rng, at = random.Random(seed), dt.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        at += dt.timedelta(minutes=rng.randint(1, 400))
        day = at.date() - dt.timedelta(days=rng.randint(0, 30))
        out.append((rng.choice("pq"), rng.choice("xyz"), day.replace(day=1), at, None if k % 3 else at, 1, rng.choice([1.0, 2.0, None, 1.0]), rng.choice([None, "n"])))
    return out


def one_by_one(rows):
    """Every record in turn against the last version of its identity."""
    last, out = {}, set()
    for r in sorted(rows, key=lambda r: r[3]):
        had = last.get(r[:3])
        if had is None or had[1:] != r[6:]:
            last[r[:3]] = (1 if had is None else had[0] + 1, *r[6:])
            out.add((*r[:4], *last[r[:3]]))
    return out


def held(store):
    rows = store.read("raw.x").collect()
    got = {tuple(r[c] for c in KEY) for r in rows}
    assert len(got) == len(rows)
    return got


def test_records_in_sequence(spark):
    rows = records()
    got = sink.appended(spark.createDataFrame(rows, RECORD))
    assert {tuple(r[c] for c in KEY) for r in got.collect()} == one_by_one(rows)
    assert sink.appended(spark.createDataFrame([], RECORD)).count() == 0


def test_the_sink_leaves_what_one_run_leaves(spark, tmp_path):
    rows = records()
    store = Store(spark, str(tmp_path), {"raw.x": RECORD})
    to = sink.StoreSink(store, "raw.x", "q")
    parts = [spark.createDataFrame(rows[k : k + 100], RECORD) for k in (0, 100, 200)]
    for k, part in enumerate(parts):
        assert to.write(part, k)
        assert not to.write(part, k)  # given twice
    assert held(store) == one_by_one(rows)
    assert to.write(parts[2], 3) and held(store) == one_by_one(rows)  # the same rows sent again in a batch of their own
    assert {(r.source, r.series_id, r.as_of, r.value) for r in store.current("raw.x").collect()} == {(k[0], k[1], k[2], v) for k, v in _last(rows).items()}


def _last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[3]):
        out[r[:3]] = r[6]
    return out


class Killed(Exception):
    pass


class Dying(sink.StoreSink):
    """Dies after so many moves, or before the record."""

    def __init__(self, *args, after):
        super().__init__(*args)
        self.left = after

    def move(self, fs, at, to):
        if self.left == 0:
            raise Killed
        self.left -= 1
        super().move(fs, at, to)

    def record(self, batch_id, files):
        raise Killed


@pytest.mark.parametrize("after", [0, 1, 3, 10_000])
def test_a_killed_batch_is_taken_up(spark, tmp_path, after):
    rows = records(7, 200)
    store = Store(spark, str(tmp_path), {"raw.x": RECORD})
    parts = [spark.createDataFrame(rows[k : k + 100], RECORD) for k in (0, 100)]
    sink.StoreSink(store, "raw.x", "q").write(parts[0], 0)
    with pytest.raises(Killed):
        Dying(store, "raw.x", "q", after=after).write(parts[1], 1)
    again = sink.StoreSink(store, "raw.x", "q")
    assert again.write(parts[1], 1) and not again.write(parts[1], 1)
    assert held(store) == one_by_one(rows)


def test_refused_records_do_not_stop_a_stream(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", {"raw.x": RECORD})
    good = records(3, 90)
    bad = [("", "x", dt.date(2024, 1, 1), dt.datetime(2024, 1, 2), None, 1, 1.0, None), ("p", None, dt.date(2024, 1, 1), dt.datetime(2024, 1, 2), None, 1, 1.0, None)]
    for k in range(3):
        spark.createDataFrame(good[30 * k : 30 * k + 30] + bad, RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # started again it finds nothing
        stream.writeStream.foreachBatch(sink.StoreSink(store, "raw.x", "q")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    assert held(store) == one_by_one(good)
    refused = spark.read.parquet(*[f"{tmp_path}/s/_refused/raw.x/q-{k}" for k in range(3)])
    assert sorted(r.fault for r in refused.collect()) == ["series_id"] * 3 + ["source"] * 3


def trades(seed=2, n=160):
    rng, day, out = random.Random(seed), dt.date(2024, 1, 2), []
    for _ in range(n):
        day += dt.timedelta(days=rng.choice([0, 1, 1, 1, 2, 3, 9, 12]) if rng.random() < 0.5 else 1)
        out.append((rng.choice("ab"), day, float(rng.randint(-5, 5))))
    return out


def plain_state(rows, sessions, absence=7, observation=5):
    """The rule as it reads: sequences of sessions, the last gap, sessions of the calendar since."""
    out = {}
    for s in {r[0] for r in rows}:
        mine = sorted({r[1] for r in rows if r[0] == s})
        for d in mine:
            seq = [x for x in mine if x <= d]
            begun = None
            for a, b in zip(seq, seq[1:], strict=False):
                if (b - a).days > absence:
                    begun = b
            left = 0 if begun is None else max(0, observation - sum(begun <= x <= d for x in sessions) + 1)
            of = lambda key: sum(p for t, x, p in rows if t == s and x < d and key(x) == key(d))  # noqa: B023, E731
            out[s, d] = (sum(r[0] == s and r[1] == d for r in rows), 0.0, of(lambda x: x.isocalendar()[:2]), of(lambda x: (x.year, x.month)), left)
    return out


def calendar_days(spark, first=dt.date(2024, 1, 1), n=1200):
    days = [first + dt.timedelta(days=k) for k in range(n)]
    return spark.createDataFrame([(d, d.weekday() < 5 and d.day != 4) for d in days], "day date, is_session boolean"), [d for d in days if d.weekday() < 5 and d.day != 4]


def test_session_state_is_the_rule(spark):
    rows = trades()
    days, sessions = calendar_days(spark)
    got = state.session_state(spark.createDataFrame([*rows, (None, rows[0][1], 1.0)], "series_id string, session date, pnl double"), days).collect()
    want = plain_state(rows, sessions)
    assert {(r.series_id, r.session): (r.trades, r.day_pnl, r.week_pnl, r.month_pnl, r.observation_left) for r in got} == want
    assert {v[4] for v in want.values()} >= {0, 1, 5}
    assert state.session_state(spark.createDataFrame([], "series_id string, session date, pnl double"), days).count() == 0


def test_a_stream_of_trades_gives_the_state_of_the_table(spark, tmp_path):
    """Trades come in any order within ten days, in several batches; each session is emitted once, in order."""
    state.keyed_state(spark)
    rows = trades(5, 60)
    days, _ = calendar_days(spark)
    kind = "series_id string, session date, pnl double"
    shuffled = sorted(rows, key=lambda r: (r[1] + dt.timedelta(days=random.Random(str(r)).randint(0, 8)), r[0]))
    end = rows[-1][1] + dt.timedelta(days=60)
    parts = [shuffled[:25], shuffled[25:45], shuffled[45:], [("z", end, 0.0)], [("z", end + dt.timedelta(days=40), 0.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = state.session_state_stream(stream, days, late="10 days").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(240)
    assert q.exception() is None
    rowed = lambda df: sorted(tuple(r) for r in df.where("series_id <> 'z'").collect())
    got = rowed(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rowed(state.session_state(spark.createDataFrame(rows, kind), days)) and len(got) > 30


def headlines(seed=4):
    """Repeats within a day, or more than three days apart; times in order but for some hours."""
    rng, at, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for k in range(120):
        at += dt.timedelta(hours=rng.choice([1, 2, 5]))
        out.append((f"h{rng.randint(0, 3) if k % 24 < 8 else k}", at, k))
    return out


def plain_first(rows, hours=24):
    kept, since = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if r[0] not in since or r[1] - since[r[0]] > dt.timedelta(hours=hours):
            since[r[0]] = r[1]
            kept.append(r)
    return kept


def test_first_within_a_horizon(spark):
    rows = headlines() + headlines()[:5] + [(None, dt.datetime(2024, 1, 1), 0), ("h0", None, 1)]
    got = horizon.first_within(spark.createDataFrame(rows, "h string, at timestamp, k int"), "h", "at").collect()
    assert sorted(map(tuple, got)) == sorted(plain_first([r for r in rows if r[0] and r[1]]))
    assert 40 < len(got) < 120


def test_a_stream_of_repeats_keeps_what_the_table_keeps(spark, tmp_path):
    """Shuffled within a day and repeated: titles that come again count again once the watermark is past their day."""
    start = dt.datetime(2024, 1, 1)
    days = [[(f"h{k % 7}", start + dt.timedelta(days=4 * d, hours=k % 20), k) for k in range(30)] for d in range(4)]
    # Time goes on between the days: one batch moves the watermark on, the next drops what it has passed.
    marks = lambda d: [[(f"mark{d}-{h}", start + dt.timedelta(days=4 * d + 3, hours=h), 0)] for h in (0, 1)]
    for d, part in enumerate(x for d in range(4) for x in (days[d], *marks(d))):
        random.Random(d).shuffle(part)
        spark.createDataFrame(part, "h string, at timestamp, k int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{d}")
    read = spark.readStream.schema("h string, at timestamp, k int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    horizon.first_within(read, "h", "at").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(180)
    table = horizon.first_within(spark.read.schema("h string, at timestamp, k int").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), "h", "at")
    episodes = lambda df: sorted((r.h, (r.at - start).days // 4) for r in df.collect())
    assert episodes(spark.read.parquet(f"{tmp_path}/out")) == episodes(table) and len(episodes(table)) == 7 * 4 + 8


def test_intervals_hold_points(spark):
    rng = random.Random(9)
    t0 = dt.datetime(2024, 3, 8)
    at = lambda: t0 + dt.timedelta(minutes=rng.randint(0, 6000))
    points = [(k, "ab"[k % 2], at()) for k in range(300)] + [(300, "a", None), (301, None, at())]
    spans = []
    for k in range(40):
        a = at()
        spans.append((k, "ab"[k % 2], a, a + dt.timedelta(minutes=rng.choice([0, 5, 59, 60, 390, 2000]))))
    points += [(400 + k, s[1], s[2 + k % 2]) for k, s in enumerate(spans)]  # on the bounds
    spans += [(50, "a", t0, None), (51, "a", t0 + dt.timedelta(hours=2), t0)]
    p, s = spark.createDataFrame(points, "id int, key string, at timestamp"), spark.createDataFrame(spans, "span int, key string, lo timestamp, hi timestamp")
    hit = {(i, j) for i, k, t in points for j, m, lo, hi in spans if t and lo and hi and k == m and lo <= t <= hi}
    got = intervals.held_by(p, s, "at", "lo", "hi", width=1800, keys=("key",))
    assert {(r.id, r.span) for r in got.collect()} == hit and got.count() == len(hit) > 200
    left = intervals.held_by(p, s, "at", "lo", "hi", keys=("key",), how="left")
    assert left.where("span is null").count() == len(points) - len({i for i, _ in hit}) and left.count() == len(hit) + len(points) - len({i for i, _ in hit})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.held_by(p.limit(0), s, "at", "lo", "hi", keys=("key",)).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        intervals.held_by(p, s, "at", "lo", "hi")


def bars(spark, n=120, series=("s", "t")):
    rng, day = np.random.default_rng(3), dt.date(2024, 1, 1)
    rows = []
    for s in series:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(s, day + dt.timedelta(days=k), float(close[k] * (1 + rng.normal(0, 0.002))), float(close[k] * 1.01), float(close[k] * 0.99), float(close[k]), 1) for k in range(n)]
    return spark.createDataFrame(rows, "series_id string, session date, open double, high double, low double, close double, volume int")


def plan_of(spark, b, splits=4, size=20):
    one = b.where("series_id = 's'").select("session").distinct().toPandas().sort_values("session").reset_index(drop=True)
    return labels.walk_forward(spark.createDataFrame([(k, d) for k, d in enumerate(one.session)], "position long, session date"), n_splits=splits, test_size=size)


def test_callables_decide_as_the_expressions(spark):
    b = bars(spark)
    plan = plan_of(spark, b)
    wanted = engine.baselines(labels.bias(b)).select("baseline", "series_id", "session", "side")
    for name, f in deciding.CALLABLES.items():
        got = deciding.decided(plan, b, f, window=10).select("series_id", "session", "side")
        want = wanted.where(F.col("baseline") == name).join(plan.where("role = 'test'").select("session"), "session").select("series_id", "session", "side")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name
    mixed = deciding.decided(plan, b, dict(enumerate(list(deciding.CALLABLES.values())[:4])))
    assert {(r.fold, r.side) for r in mixed.where("fold < 3").collect()} == {(0, 0), (1, 1), (2, -1)}
    out = engine.run(plan, mixed.withColumn("notional", F.lit(10_000).cast("decimal(18,2)")), engine.day_path(b))
    assert out.count() == mixed.count() == 160
    with pytest.raises(ValueError, match="folds"):
        deciding.decided(plan, b, {0: deciding.CALLABLES["no_trade"]})


def test_a_view_holds_the_past_alone(spark):
    b = bars(spark, 60)
    plan = plan_of(spark, b, 2, 10)

    def tomorrow(view):
        return deciding.Decision(1 if view.history["close"][len(view.history["close"])] > view.open else -1)

    with pytest.raises(Exception, match="out of bounds"):
        deciding.decided(plan, b, tomorrow).collect()

    def today(view):
        return deciding.Decision(1 if view.close > view.open else -1)

    with pytest.raises(Exception, match="no attribute 'close'"):
        deciding.decided(plan, b, today).collect()

    def overwrites(view):
        view.history["close"][:] = 0.0
        return deciding.Decision(0)

    # What a function does to its view stays there.
    deciding.decided(plan, b, overwrites).collect()
    with pytest.raises(Exception, match="side 3"):
        deciding.decided(plan, b, lambda view: deciding.Decision(3)).collect()
    day = str(plan.where("role = 'test'").agg(F.max("session")).first()[0])
    assert deciding.looks_ahead(plan, b, deciding.CALLABLES["momentum_5d"], day).count() == 0
    assert deciding.looks_ahead(plan, b, lambda view: deciding.Decision(int(np.sign(view.last("close") - view.open)) if view.history else 0), day).count() == 0


def test_a_walk_is_told_of_each_session_once(spark):
    """State carried along a series: a running sum of returns decides."""
    b = bars(spark, 60)
    plan = plan_of(spark, b, 2, 10)

    def step(held, row):
        held["sum"] = held.get("sum", 0.0) + row["close"] / row["open"] - 1
        held["n"] = held.get("n", 0) + 1

    walk = deciding.Walk(step, lambda held, view: deciding.Decision(1 if held["sum"] > 0 else -1, None, None) if held["n"] == len(view.history["close"]) else deciding.Decision(0))
    got = {(r.series_id, r.session): r.side for r in deciding.decided(plan, b, walk).collect()}
    pdf = b.toPandas().sort_values(["series_id", "session"])
    pdf["r"] = pdf.close / pdf.open - 1
    pdf["before"] = pdf.groupby("series_id").r.cumsum() - pdf.r
    want = {(r.series_id, r.session): 1 if r.before > 0 else -1 for r in pdf.itertuples()}
    assert len(got) == 40 and all(want[k] == v for k, v in got.items())
