"""Operators of problems 2, 4, 5 and 6 against plain loops, and their edge cases."""

import datetime as dt
import random
from statistics import median

import pytest
from conftest import READING, ts
from pyspark.sql import functions as F

from pitloom.operators.asof import as_known_at
from pitloom.operators.grid import regular_grid
from pitloom.operators.rolling import advance, advance_in_steps, changed_days, correct, daily_amounts, latest, present, rolling_totals, versioned
from pitloom.operators.shards import TimeShards, usable_readings
from pitloom.operators.spikes import exact_median, flag_faults
from pitloom.session import stage

KEYS = ["coin", "metric", "source"]
DAY0 = ts("2024-01-01")
EPOCH_DAY0 = (DAY0.date() - dt.date(1970, 1, 1)).days


def make(seed: int, series: int = 4, days: int = 400):
    rng, rows, n = random.Random(seed), [], 0
    for s in range(series):
        for d in range(days):
            for _ in range(rng.choice([0, 1, 1, 2]) if rng.random() < 0.6 else 0):
                n += 1
                e = DAY0 + dt.timedelta(days=d, seconds=rng.randrange(86400))
                a = e + dt.timedelta(hours=rng.choice([1, 24, 24 * 90]))
                v = rng.choice([rng.gauss(100, 3), 100.0 if s == 1 else rng.gauss(100, 3)])
                if rng.random() < 0.02:
                    v *= 40
                rows.append((n, e, a, f"c{s}", "m", v, "s", "final", 7, "x"))
                if rng.random() < 0.1:
                    n += 1
                    rows.append((n, e, a + dt.timedelta(hours=rng.choice([0, 5])), f"c{s}", "m", v + 1, "s", "final", 7, "x"))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
    rows.append((n + 1, None, DAY0, "c0", "m", 1.0, "s", None, None, None))
    rows.append((n + 2, DAY0, None, "c0", "m", 1.0, "s", None, None, None))
    rows.append((n + 3, DAY0, DAY0, "c0", "m", None, "s", None, None, None))
    rows.append((n + 4, DAY0, DAY0, "c0", "m", float("nan"), "s", None, None, None))
    rows.append((n + 5, DAY0 + dt.timedelta(days=3), DAY0, None, None, 5.0, None, None, None, None))
    rng.shuffle(rows)
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and r[2] is not None and r[5] is not None and r[5] == r[5]]


def current(rows):
    best = {}
    for r in usable(rows):
        k = (r[3], r[4], r[6], r[1])
        if k not in best or (r[2], r[0]) > (best[k][2], best[k][0]):
            best[k] = r
    out = {}
    for k, r in best.items():
        out.setdefault(k[:3], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    return make(3)


@pytest.fixture(scope="module")
def readings(spark, rows):
    return usable_readings(spark.createDataFrame(rows, READING))


SHARDS = [(7, 10**6), (128, 10**6), (400, 20)]


@pytest.mark.parametrize(("width", "most"), SHARDS)
def test_grid_is_a_plain_fill(readings, rows, monkeypatch, width, most):
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 10**9)
    got = {(r.coin, r.metric, r.source, r.day): (r.n_readings, r.missing, r.value, r.value_day) for r in regular_grid(readings, KEYS, shard_days=width, most=most).collect()}
    want = {}
    for k, rs in current(rows).items():
        by = {}
        for r in rs:
            by.setdefault((r[1] - ts("1970-01-01")).days, []).append(r)
        last = None
        for d in range(min(by), max(by) + 1):
            if d in by:
                last = (by[d][-1][5], d)
            want[(*k, d)] = (len(by.get(d, [])), d not in by, *last)
    assert got == want


@pytest.mark.parametrize(("width", "most"), [(7, 10**6), (128, 10**6), (128, 20)])
def test_rolling_totals_are_window_sums(readings, rows, monkeypatch, width, most):
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 10**9)
    got = {(r.coin, r.metric, r.source, r.day): r for r in rolling_totals(daily_amounts(readings, KEYS, shard_days=width, most=most), KEYS).collect()}
    n = 0
    for k, rs in current(rows).items():
        days = [((r[1] - ts("1970-01-01")).days, r[5]) for r in rs]
        for d in range(days[0][0], days[-1][0] + 1):
            n += 1
            for w in (7, 30):
                x = [v for e, v in days if d - w < e <= d]
                g = got[(*k, d)]
                assert g[f"n_{w}"] == len(x)
                assert abs(float(g[f"sum_{w}"]) - sum(x)) < 1e-6
                assert (g[f"mean_{w}"] is None) == (not x)
    assert n == len(got)


def totals(df):
    return sorted((r.coin or "", r.day, r.n_7, r.n_30, r.sum_7, r.sum_30) for r in present(df, KEYS).collect())


@pytest.fixture(scope="module")
def daily(readings):
    return stage(daily_amounts(readings, KEYS))


def test_steps_give_the_full_state(daily):
    lo, hi = daily.agg(F.min("day"), F.max("day")).first()
    assert totals(advance_in_steps(daily, KEYS, [lo - 5, lo + 40, lo + 41, hi + 3], keep=stage)) == totals(advance(daily, KEYS))
    rest = daily.filter("coin != 'c0' OR day % 97 < 30")  # long pauses, in which all amounts expire
    assert totals(advance_in_steps(rest, KEYS, [lo + 90, lo + 95], keep=stage)) == totals(advance(rest, KEYS))


def test_amounts_of_nine_places_expire_whole(spark):
    day = lambda d: DAY0 + dt.timedelta(days=d)
    rows = [(i, day(d), day(d), "c", "m", v, "s", "", 0, "") for i, (d, v) in enumerate([(0, 11.926499967), (3, 0.000000001), (9, 1.5), (40, -2.25)])]
    got = {r.day - EPOCH_DAY0: (f"{r.sum_7:.9f}", f"{r.sum_30:.9f}") for r in rolling_totals(daily_amounts(spark.createDataFrame(rows, READING), KEYS), KEYS).collect()}
    assert got[3] == ("11.926499968", "11.926499968") and got[7] == ("0.000000001", "11.926499968") and got[9] == ("1.500000001", "13.426499968") and got[10] == ("1.500000000", "13.426499968")
    assert got[30] == ("0.000000000", "1.500000001") and got[40] == ("-2.250000000", "-2.250000000")


@pytest.mark.parametrize(("keep_old", "keep_new"), [("day % 5 != 0", "day % 7 != 3"), ("coin != 'c0'", "coin != 'c1' AND coin IS NOT NULL"), ("day % 400 < 200", "day % 400 > 150"), ("day % 100 > 30", "day % 300 < 200")])
def test_corrections_equal_a_rebuild(daily, keep_old, keep_new):
    old, new = daily.filter(keep_old), daily.filter(keep_new)
    state = stage(versioned(advance(old, KEYS), 1))
    fixed = stage(correct(state, new, stage(changed_days(old, new, KEYS)), KEYS, 2))
    assert totals(latest(fixed, KEYS)) == totals(advance(new, KEYS))
    assert fixed.filter("version = 1").count() == state.count()


def test_amounts_that_do_not_fit(spark):
    rows = [(1, DAY0, DAY0, "a", "m", 1e30, "s", None, None, None), (2, DAY0 + dt.timedelta(days=8), DAY0, "a", "m", 2.0, "s", None, None, None), (3, DAY0 + dt.timedelta(days=9), DAY0, "a", "m", float("inf"), "s", None, None, None)]
    got = {r.day - EPOCH_DAY0: (r.n_7, r.sum_7, r.n_30) for r in rolling_totals(daily_amounts(usable_readings(spark.createDataFrame(rows, READING)), KEYS), KEYS).collect()}
    assert got[0] == (1, None, 1) and got[7] == (0, 0.0, 1) and got[8] == (1, 2.0, 2) and got[9] == (2, None, 3)


CATALOG = "metric string, min_valid double, max_valid double, may_repeat boolean"


def faults(rows):
    bad = set()
    for rs in current(rows).values():
        v = [r[5] for r in rs]
        n = len(v)
        dist = [abs(v[i] - median(v[i - 5 : i])) for i in range(5, n)]
        usual = median(dist) if dist else None
        for i, r in enumerate(rs):
            if r[4] == "m" and (v[i] < 0 or v[i] > 1000):
                bad.add(r[0])
            if 5 <= i < n - 5 and abs(v[i] - median(v[i - 5 : i])) > 8 * usual and abs(v[i] - median(v[i + 1 : i + 6])) > 8 * usual:
                bad.add(r[0])
            a = b = i
            while a and v[a - 1] == v[i]:
                a -= 1
            while b + 1 < n and v[b + 1] == v[i]:
                b += 1
            if b - a + 1 >= 6 and r[4] == "m":
                bad.add(r[0])
    return bad


@pytest.mark.parametrize(("width", "most"), [(3, 10**6), (20, 10**6), (256, 15)])
@pytest.mark.parametrize("factor_rounds", [1, 3])
def test_faults_are_the_exact_rule(spark, readings, rows, monkeypatch, width, most, factor_rounds):
    if (width, factor_rounds) == (3, 3):
        pytest.skip("two of the three widths suffice")
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 10**9)
    if most == 15:  # the way that many series take
        monkeypatch.setattr("pitloom.operators.spikes.fits", lambda df: False)
    catalog = spark.createDataFrame([("m", 0.0, 1000.0, False), ("m", 0.0, 1000.0, False), ("other", None, None, True)], CATALOG)
    out = flag_faults(readings, catalog, KEYS, rounds=factor_rounds, shard_days=width, most=most).collect()
    assert {r.reading_id for r in out if r.impossible or r.stuck or r.spike} == faults(rows)
    assert all(r.candidate for r in out if r.spike)
    assert len(out) == sum(len(v) for v in current(rows).values())


@pytest.mark.parametrize("most", [20, 10**6])
def test_exact_median(spark, most):
    rng = random.Random(1)
    data = {"even": [rng.expovariate(1) for _ in range(400)], "odd": [rng.gauss(0, 1) ** 2 for _ in range(301)], "zeros": [0.0] * 7 + [3.0], "two": [1.0, 50.0], "one": [5.0], "ties": [2.0] * 60 + [2.05] * 60 + [9.0] * 3}
    df = spark.createDataFrame([(k, x) for k, v in data.items() for x in v] + [("none", None), ("one", None)], "k string, x double")
    assert {r.k: r.median for r in exact_median(df, ["k"], "x", most).collect()} == pytest.approx({k: median(v) for k, v in data.items()})


REQUEST = "request_id long, coin string, metric string, source string, request_ts timestamp, value double, _c int"


@pytest.mark.parametrize(("width", "most"), SHARDS)
def test_as_known(spark, readings, rows, monkeypatch, width, most):
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 10**9)
    rng = random.Random(5)
    asked = [(i, f"c{rng.randrange(5)}", "m", "s", DAY0 + dt.timedelta(days=rng.uniform(-5, 500)), 0.5, 1) for i in range(300)]
    asked += [(900, "c0", "m", "s", None, None, None), (901, None, "m", "s", DAY0, None, None)]
    asked += [(1000 + i, r[3], r[4], r[6], max(r[1], r[2]), None, None) for i, r in enumerate(usable(rows)[:50]) if r[3]]
    got = {r.request_id: (r.reading_id, r.value) for r in as_known_at(spark.createDataFrame(asked, REQUEST), readings, KEYS, ["value", "status"], shard_days=width, most=most).collect()}
    want = {}
    for q in asked:
        seen = [r for r in usable(rows) if q[4] is not None and (r[3], r[4], r[6]) == q[1:4] and r[1] <= q[4] and r[2] <= q[4]]
        if seen and q[1]:
            best = max(seen, key=lambda r: (r[1], r[2], r[0]))
            want[q[0]] = (best[0], best[5])
    assert got == want


def test_shards_of_a_dense_month_are_even(spark, monkeypatch):
    """A series with half of all rows within one month: no shard holds above twice the median of those it is cut into."""
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 50)
    day = 86_400_000_000
    dense = spark.range(50_000).select(F.lit("hot").alias("k"), (F.lit(19_700 * day) + F.col("id") * 30 * day / 50_000).cast("long").alias("us"))
    rest = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id") % 97).alias("k"), (F.lit(18_000 * day) + F.col("id") * 1000 * day / 50_000).cast("long").alias("us"))
    rows = dense.unionByName(rest).unionByName(spark.range(3).select(F.lit(None).cast("string").alias("k"), F.lit(5).cast("long").alias("us")))
    shards = TimeShards([(rows, F.col("us"))], ["k"], 128, 100)
    out = stage(shards.add(rows, F.col("us")))
    sizes = sorted(r["count"] for r in out.filter("k = 'hot'").groupBy("_shard").count().collect())
    assert out.count() == 100_003 and len(sizes) >= 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    w = out.groupBy("k", "_shard").agg(F.min("us").alias("a"), F.max("us").alias("b")).orderBy("k", "_shard").collect()
    assert all(x.b < y.a for x, y in zip(w, w[1:]) if x.k == y.k)


def test_empty_tables(spark):
    none = usable_readings(spark.createDataFrame([], READING))
    assert regular_grid(none, KEYS).count() == 0
    assert rolling_totals(daily_amounts(none, KEYS), KEYS).count() == 0
    assert flag_faults(none, spark.createDataFrame([], CATALOG), KEYS).count() == 0
    assert as_known_at(spark.createDataFrame([], REQUEST), none, KEYS, ["value"]).count() == 0
