"""Which sessions can be labelled, by the rule as it reads; ticks inside the hours across clock changes; the audit of entries."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, label_history, labels

KIND = "series_id string, session date, open double, high double, low double, close double"


def market(spark):
    first = dt.date(2024, 2, 26)  # over the change of clocks of 10 March
    rows = []
    for k in range(24):
        day = first + dt.timedelta(days=k)
        o = 100.0 + k
        rows.append(["SPX", day, o, o + 2, o - 2, o + 1.5])
    rows[7][2] = rows[6][5]  # a stale open
    rows[9][3] = None
    days = calendar.calendar(calendar.days_between(spark, "2024-02-01", "2024-03-31"), extra_half_days=["2024-02-28", "2024-03-08", "2024-03-13"])
    sigmas = [("SPX", r[1], 0.01 + k / 1000) for k, r in enumerate(rows) if k not in (10, 11)]
    return rows, days, sigmas


def plain(rows, days, sigmas, now):
    by, own, last, out = {d.day: d for d in days}, {s[1]: s[2] for s in sigmas}, None, {}
    for before, r in zip(rows, rows[1:], strict=False):
        d, reason, sigma = by[r[1]], None, None
        if not d.is_session:
            reason = "no_session"
        elif r[2] == before[5]:
            reason = "stale_open"
        elif None in r[3:]:
            reason = "incomplete"
        elif d.is_half_day:
            sigma = None if last is None else last * math.sqrt(d.hours / 6.5)
            reason = "no_forecast" if last is None else None
        else:
            sigma = own.get(r[1])
            reason = "no_forecast" if sigma is None else None
        if reason is None and d.close_utc > now:
            reason = "not_closed"
        if reason is None and not d.is_half_day:
            last = sigma
        out[r[1]] = (reason, None if reason else sigma)
    return out


def test_the_first_reason_counts(spark):
    rows, days, sigmas = market(spark)
    now = dt.datetime(2024, 3, 19, 12)
    got = label_history.sample(spark.createDataFrame(rows, KIND), days, spark.createDataFrame(sigmas, "series_id string, session date, sigma double"), str(now)).collect()
    want = plain(rows, days.collect(), sigmas, now)
    assert {r.session: (r.reason, r.sigma) for r in got} == {k: (a, None if b is None else pytest.approx(b)) for k, (a, b) in want.items()}
    assert {r for r, _ in want.values()} == {None, *label_history.REASONS}
    assert {r.carrier for r in got if r.reason is None} == {"previous", "forecast"}
    later = label_history.sample(spark.createDataFrame(rows, KIND), days, spark.createDataFrame(sigmas, "series_id string, session date, sigma double"), str(now), clean_from="2024-03-04")
    assert min(r.session for r in later.collect()) == dt.date(2024, 3, 4)
    counts = {r.reason: r.n for r in label_history.reason_counts(later).collect()}
    assert sum(counts.values()) == 17 and counts["no_session"] == 4


def minutes(spark, rows, days):
    """A tick every five minutes from an hour before the opening to an hour after the close."""
    by, out = {d.day: d for d in days}, []
    for r in rows:
        d = by[r[1]]
        if d.is_session:
            for k in range(-12, int(d.hours * 12) + 13):
                at = d.open_utc + dt.timedelta(minutes=5 * k)
                px = r[2] if k == 0 else r[2] + (50 if k < 0 or k > d.hours * 12 else math.sin(k))
                out.append((at, px, px + 0.01, px - 0.01))
    return spark.createDataFrame(out, "at timestamp, open double, high double, low double")


def test_ticks_of_the_hours_decide_and_entries_are_audited(spark):
    rows, days, sigmas = market(spark)
    sampled = label_history.sample(spark.createDataFrame(rows, KIND), days, spark.createDataFrame(sigmas, "series_id string, session date, sigma double"), "2024-04-01 00:00:00").cache()
    ticks = minutes(spark, rows, days.collect())
    inside = label_history.session_ticks(sampled, ticks)
    n = {r.session: r["count"] for r in inside.groupBy("session").count().collect()}
    assert n == {r.session: int(r.hours * 12) + 1 for r in sampled.where("reason is null").collect()}
    got = label_history.label_history(sampled, ticks, k=0.5)
    assert got.count() == len(n) and {r.order_source for r in got.collect()} == {"intraday"}
    whole = sampled.where("reason is null").select("session", F.col("open").alias("entry"), "high", "low", "close", "sigma", (F.col("hours") * 12).alias("expected"))
    want = labels.triple_barrier(whole, inside, 0.5)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))
    audit = label_history.entry_audit(sampled, ticks)
    assert label_history.audit_summary(audit).first()[:] == (len(n), len(n), 0.0, "ok")
    off = label_history.entry_audit(sampled, ticks.withColumn("open", F.when(F.dayofmonth("at") == 5, F.col("open") * 1.01).otherwise(F.col("open"))))
    one = off.where("not identical").collect()
    assert [r.session.day for r in one] == [5] and one[0].diff_bp == pytest.approx(10_000 * (1 - 1 / 1.01)) and label_history.audit_summary(off).first().status == "mismatch"
    assert label_history.audit_summary(label_history.entry_audit(sampled, ticks.limit(0))).first()[:] == (0, 0, None, "not_evaluable")
    sampled.unpersist()
