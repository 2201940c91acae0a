"""Keys that hold most rows are worked on in several parts, with the same results."""

import random
from statistics import NormalDist

import pytest
from conftest import ts
from pyspark.sql import functions as F

from pitloom.functions.derived import derive
from pitloom.functions.folds import expanding_quantile
from pitloom.functions.indicators import commodity_channel, directional, macd, money_flow, stochastic
from pitloom.functions.stats import normal_cdf, purged_splits, two_weights
from pitloom.functions.windows import Series
from pitloom.operators.pit import asof_backward, wide_as_of
from pitloom.operators.ticks import fast_buckets, volume_buckets
from pitloom.sources.stores import METRICS, read_store, tag_symbols, upsert, without_tags


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr("pitloom.operators.shards.HOT_SHARE", 10**9)


def test_asof_of_a_hot_key(spark, hot):
    rng = random.Random(2)
    left = [(i, rng.choice("aaab") if i % 50 else None, rng.randrange(0, 400)) for i in range(500)]
    right = [(rng.choice("aaab"), rng.randrange(100, 400), i, None if i % 7 == 0 else f"v{i}") for i in range(300)] + [(None, 150, 999, "null")]
    l = spark.createDataFrame(left, "id int, k string, t int")
    r = spark.createDataFrame(right, "k string, at int, o int, v string")
    parts, whole = ({x.id: x.v for x in asof_backward(l, r, ["k"], "t", "at", ["o"], ["v"], most=m).collect()} for m in (15, 10**6))
    assert parts == whole and len(parts) == 500
    for i, k, t in left:
        seen = [x for x in right if x[0] == k and x[1] <= t]
        assert parts[i] == (max(seen, key=lambda x: (x[1], x[2]))[3] if seen else None)


def test_wide_frame_of_a_hot_key(spark, hot):
    rng = random.Random(3)
    rows = [("c", rng.choice("mn"), float(i), ts("2024-01-01"), i, i * 1000 + 1_704_067_200) for i in range(200)]
    df = spark.createDataFrame(rows, "coin string, metric string, value double, event_ts timestamp, reading_id long, s long").withColumn("as_of_ts", F.timestamp_seconds("s"))
    dates = F.expr("sequence(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-04', INTERVAL 5 HOURS)")
    a, b = (sorted(map(tuple, wide_as_of(df, dates, ["coin"], ["m", "n"], "as_of_ts", ["reading_id"], most=m).collect())) for m in (20, 10**6))
    assert a == b and len(a) == 15 and any(x[2] is not None for x in a)


def test_buckets_of_a_hot_key(spark, hot):
    rng = random.Random(4)
    df = spark.createDataFrame([("s", i // 3, float(rng.randrange(1, 9)), float(rng.randrange(0, 9)), rng.random() < 0.5) for i in range(400)], "k string, t int, p double, q double, m boolean")
    a, b = (sorted(map(tuple, volume_buckets(df, ["k"], "t", "p", "q", "m", 25.0, most=m).collect())) for m in (30, 10**6))
    assert a == b and len(a) > 10
    a, b = (fast_buckets(df, ["k"], "t", "q", "m", 10, most=m).collect()[0].vpin for m in (30, 10**6))
    assert a == pytest.approx(b)


def test_expanding_quantile(spark):
    xs = [3.0, None, 1.0, 2.0, 9.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [("b", 0, 1.0)], "k string, t int, x double")
    got = {(r.k, r.t): r.q for r in expanding_quantile(df, ["k"], "t", "x", 0.5, 2, "q").collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("a", 2): None, ("a", 3): 2.0, ("a", 4): 2.0, ("b", 0): None}
    assert expanding_quantile(df.limit(0), ["k"], "t", "x", 0.5, 2).count() == 0


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -7.0710678, -3.0, -1e-9, 0.0, 0.3, 2.5, 7.08, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    for r in rows:
        if r.x is None or r.x != r.x:
            assert r.p is None
        else:
            assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=1e-14)


def test_splits_with_little_to_train_on_are_left_out(spark):
    every, some = purged_splits(spark, 43, 4, 2, 3), purged_splits(spark, 43, 4, 2, 3, 15)
    train = {r.split: r.n for r in every.filter("role = 'train'").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert {r.split for r in some.select("split").distinct().collect()} == {s for s, n in train.items() if n >= 15} != set(train)


def test_weights_are_held_and_defined(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.04, 0.01, 0.0), (0.1, -0.5, 0.04, 0.01, 0.0), (0.1, 0.1, 0.04, 0.04, 0.04)], "m double, n double, a double, b double, c double")
    got = [tuple(r) for r in df.select(*two_weights(*map(F.col, "mnabc"))).collect()]
    assert got[0] == pytest.approx((1 / 9, 0.2)) and got[1][0] == 0.0 and got[2] == (0.5, 0.5)


def test_derived_columns_need_their_inputs(spark):
    names = ["stable_usdt_supply", "stable_usdc_supply", "stable_usdt_eth_supply", "stable_usdc_eth_supply", "SplyExNtv", "SplyCur", "IssTotUSD", "tvl_op-mainnet"]
    rows = [("c", i, *[float((k + 2) * (i + 1)) for k in range(len(names))]) for i in range(70)]
    df = spark.createDataFrame(rows, ["k", "d", *names])
    out = derive(df, Series(("k",), ("d",)))
    new = set(out.columns) - set(df.columns)
    assert new == {"stable_total_supply", "stable_total_chg_7d", "stable_total_chg_30d", "usdt_dominance", "usdt_eth_share", "stable_eth_chain_supply", "stable_eth_chain_chg_7d", "ex_supply_ratio", "ex_supply_ratio_chg_30d", "puell_multiple", "tvl_op-mainnet_chg_7d"}
    last = out.filter("d = 69").collect()[0]
    assert last["stable_total_supply"] == 350.0 and last["usdt_dominance"] == pytest.approx(0.4) and last["tvl_op-mainnet_chg_7d"] == pytest.approx(70 / 63 - 1) and last["ex_supply_ratio_chg_30d"] == pytest.approx(0.0)
    assert last["puell_multiple"] == pytest.approx(70 / 35.5) and out.filter("d = 58").collect()[0]["puell_multiple"] is None


def test_indicators_of_few_bars(spark):
    bars = "symbol string, date int, open double, high double, low double, close double, volume double"
    flat = spark.createDataFrame([("s", i, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(30)], bars)
    assert {tuple(r)[2:] for r in macd(flat).collect()} == {(0.0, 0.0, 0.0)}
    assert {tuple(r)[2:] for r in directional(flat).collect()} == {(0.0, 0.0, 0.0)}
    assert {tuple(r)[2:] for r in stochastic(flat).collect()} == {(50.0, 50.0, 50.0)}
    assert {r.cci for r in commodity_channel(flat).collect()} == {None} == {r.mfi for r in money_flow(flat).collect()}
    rising = spark.createDataFrame([("s", i, 1.0, 2.0 + i, 1.0 + i, 1.5 + i, 1.0) for i in range(30)], bars)
    assert max(r.mfi for r in money_flow(rising).collect() if r.mfi) == 100.0 and directional(rising).orderBy(F.desc("date")).first().mdi == 0.0
    for f in (macd, directional, stochastic, commodity_channel, money_flow):
        assert f(flat.limit(0)).count() == 0


def test_tags_and_markup(spark):
    terms = {"B": ["bitcoin", "btc"], "S": ["solana", "=sol"]}
    df = spark.createDataFrame([("BTC and sol",), ("solar",), (None,), ("<b>x</b> y<br/>z ",)], "t string")
    assert [r[0] for r in df.select(tag_symbols(F.col("t"), terms, "B")).collect()] == ["B,S", "B", "B", "B"]
    assert [r[0] for r in df.select(without_tags("t")).collect()] == ["BTC and sol", "solar", "", "x yz"]


def test_a_failed_upsert_leaves_the_store(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    row = lambda day, v: (ts(day), ts(day), "b", "m", v, "s", "final")
    keys = ["event_ts", "coin"]
    upsert(spark, spark.createDataFrame([row("2024-01-05", 1.0), row("2024-02-05", 2.0)], METRICS), root, METRICS, keys, "event_ts")

    def fail(df):
        return df.withColumn("value", F.raise_error(F.lit("broken")).cast("double"))

    with pytest.raises(Exception):
        upsert(spark, spark.createDataFrame([row("2024-01-05", 9.0)], METRICS), root, METRICS, keys, "event_ts", fail)
    assert sorted(r.value for r in read_store(spark, root, METRICS).collect()) == [1.0, 2.0]
    (tmp_path / "store" / "year=2024" / "month=2" / "part-broken.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # a broken store is an error, not an empty one
        upsert(spark, spark.createDataFrame([row("2024-02-05", 9.0)], METRICS), root, METRICS, keys, "event_ts")
    assert upsert(spark, spark.createDataFrame([row("2024-01-05", 3.0)], METRICS), root, METRICS, keys, "event_ts") == 1
