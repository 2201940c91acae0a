"""Operators of problems 1 and 7, batch and stream."""

import datetime as dt
import random
import time

import pytest
from conftest import ts
from pyspark.sql import functions as F

from pitloom.operators.late import k_slack, provisional_counts, released_aggregates
from pitloom.operators.orphans import blank_to_null, orphan_report, reference_status
from pitloom.session import stage
from pitloom.streaming.kslack import finals, k_slack_stream

T0 = ts("2024-03-01")
H = dt.timedelta(hours=1)
REFS = "space string, key string, child_table string, child_id long, logged_ts timestamp, _salt int"
PARENTS = "space string, key string, loaded_ts timestamp, deleted_ts timestamp, _t int"


def cases(seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(30)]
    parents = []
    for k in keys[:22]:
        for _ in range(rng.choice([1, 1, 2, 3])):
            a = T0 + rng.randrange(0, 400) * H
            parents.append(("x", k, a, a + rng.randrange(-40, 200) * H if rng.random() < 0.5 else None, 1))
    parents += parents[:5] + [("x", None, T0, None, 1), ("x", "k25", None, None, 1), ("y", "k26", T0, None, 1)]
    refs = [("x", "k0" if rng.random() < 0.4 else rng.choice(keys), "c", i, T0 + rng.randrange(-50, 500) * H, 2) for i in range(600)]
    refs += refs[:40] + [("x", None, "c", 9001, T0, 2), ("x", "", "c", 9002, T0, 2), ("x", "k0", "c", 9003, None, 2), ("x", "zz", "c", 9004, None, 2)]
    return refs, parents


def plain(refs, parents):
    out = {}
    for s, k, _, i, t, _ in refs:
        if not k:
            continue
        own = [(a, z) for ps, pk, a, z, _ in parents if (ps, pk) == (s, k)]
        sound = [(a - 24 * H, z) for a, z in own if a is not None and (z is None or z > a - 24 * H)]
        begun = [(a, z) for a, z in sound if t is not None and a <= t]
        if any(z is None or z > t for _, z in begun):
            out[i] = "ok"
        else:
            out[i] = "deleted" if begun else "late" if own else "missing"
    return out


@pytest.mark.parametrize("hot", [10, 200_000])
def test_reference_status(spark, hot):
    refs, parents = cases(hot)
    got = reference_status(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), hot=hot).collect()
    assert {r.child_id: r.status for r in got} == plain(refs, parents)
    assert len(got) == len({r.child_id for r in got})


def test_orphans_of_empty_tables(spark):
    refs, parents = cases(1)
    none = spark.createDataFrame([], REFS)
    assert reference_status(none, spark.createDataFrame(parents, PARENTS)).count() == 0
    alone = reference_status(spark.createDataFrame(refs, REFS), spark.createDataFrame([], PARENTS))
    assert {r.status for r in alone.collect()} == {"missing"}
    report = orphan_report(alone).collect()
    assert sum(r.n_missing for r in report) == sum(r.n_references for r in report) == alone.count()


def test_keys_compare_trimmed(spark):
    df = spark.createDataFrame([(" A\t",), ("a",), ("  ",), (None,)], "k string")
    assert [r.k for r in df.select(blank_to_null(F.col("k")).alias("k")).collect()] == ["a", "a", None, None]


EVENTS = "id long, event_ts timestamp, as_of_ts timestamp, late int, n int"


def arrivals(seed, days=6, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        e = T0 + dt.timedelta(seconds=rng.randrange(days * 86400)) if rng.random() > 0.3 else T0 + dt.timedelta(hours=5)
        a = e + dt.timedelta(hours=rng.choice([-1, 0, 2, 30, 71, 95, 200]), seconds=rng.randrange(3600))
        rows.append((i % (n - 40), e, a, 1, 2))
    return rows + rows[:30] + [(1, None, T0, 1, 1), (2, T0, None, 1, 1)]


@pytest.mark.parametrize("most", [20, 10**6])
def test_late_rows_and_counts(spark, monkeypatch, most):
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 10**9)
    rows = arrivals(2)
    slack = stage(k_slack(spark.createDataFrame(rows, EVENTS), "id", "event_ts", "as_of_ts", "day", 72, most))
    good, late = {}, set()
    for i, e, a, *_ in rows:
        if e is None or a is None:
            continue
        close = e.replace(hour=0, minute=0, second=0, microsecond=0) + 24 * H + 72 * H
        if a > close:
            late.add((i, e, a))
        else:
            d = e.date()
            old = good.setdefault(d, {}).get(i)
            good[d][i] = max(old, (a, e)) if old else (a, e)
    assert slack.filter("late").count() == len(late)
    got = {r.period_day: r for r in released_aggregates(slack, most).collect()}
    for d, recs in good.items():
        r = got[(d - dt.date(1970, 1, 1)).days]
        order = sorted((e, i) for i, (a, e) in recs.items())
        gaps = [(y[0] - x[0]) // dt.timedelta(microseconds=1) for x, y in zip(order, order[1:])]
        assert (r.n, r.first_id, r.last_id, r.longest_gap_us) == (len(order), order[0][1], order[-1][1], max(gaps, default=None))
    final = {r.period_day: r.n for r in provisional_counts(slack).groupBy("period_day").agg(F.max("n").alias("n")).collect()}
    assert final == {(d - dt.date(1970, 1, 1)).days: len(x) for d, x in good.items()}


def test_months_and_empty(spark):
    rows = [(1, ts("2024-02-29T23:59:59"), ts("2024-03-11"), 0, 0), (1, ts("2024-02-29T23:59:59"), ts("2024-03-11T00:00:01"), 0, 0)]
    got = k_slack(spark.createDataFrame(rows, EVENTS), "id", "event_ts", "as_of_ts", "month", 240).orderBy("as_of_us").collect()
    assert [r.late for r in got] == [False, True]
    none = k_slack(spark.createDataFrame([], EVENTS), "id", "event_ts", "as_of_ts", "day", 1)
    assert none.count() == 0 and released_aggregates(none).count() == 0 and provisional_counts(none).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_stream_releases_what_the_batch_does(spark, tmp_path, seed):
    """Arrivals are delivered out of order, by up to the slack: three hours here; a record's later arrival may come first."""
    rng = random.Random(seed)
    rows = sorted((r for r in arrivals(seed, n=200) if r[1] and r[2]), key=lambda r: r[2] + rng.random() * 71 * H)
    last = T0 + dt.timedelta(days=60)
    for k in range(6):
        part = rows[k * len(rows) // 6 : (k + 1) * len(rows) // 6]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are read in the order of their times
    spark.createDataFrame([(999, last, last, 1, 1)], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, grown = {}, []

    def take(out, batch):
        out = stage(out)
        for r in finals(out).collect():
            assert r.period_day not in got  # all buffers of a period are released in one batch
            got[r.period_day] = (r.n, r.first_id, r.last_id, r.longest_gap_us)
        late.update((r.record_id, r.event_us, r.as_of_us) for r in out.filter("kind = 'late'").collect())
        grown.append(out.filter("kind = 'provisional'").count())

    late = set()
    q = k_slack_stream(stream, "id", "event_ts", "as_of_ts", 72, buffers=3).writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    run = stage(k_slack(spark.createDataFrame(rows, EVENTS), "id", "event_ts", "as_of_ts", "day", 72))
    want = {r.period_day: (r.n, r.first_id, r.last_id, r.longest_gap_us) for r in released_aggregates(run).collect() if r.n}
    assert got == want and sum(grown) >= len(want)
    assert late == {(r.record_id, r.event_us, r.as_of_us) for r in run.filter("late").collect()} and late
