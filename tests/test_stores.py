"""Stores, logs and exports on files; bitemporal helpers; folds."""

import datetime as dt
import json
import os
import time

import pytest
from conftest import ts
from pyspark.sql import functions as F

from pitloom.functions.folds import exponential_mean, smooth_labels
from pitloom.functions.stats import block_bootstrap, change_points, expected_maximum, normal_cdf, permutation_null, purged_splits, run_length_posterior
from pitloom.functions.windows import Series, pct_change, rolling_mean, zscore
from pitloom.operators.pit import asof_backward, calendar_gaps, drop_head_of_runs, has_token, known_at, newest
from pitloom.operators.ticks import fast_buckets, order_imbalance, volume_buckets
from pitloom.session import shared_folder, small, stage
from pitloom.sources.stores import METRICS, SEQ, conform, epoch_to_ts, export_csv, long_metrics, read_csv, read_jsonl, read_newest, read_store, replace_family, stable_id, stage_by, strip_tags, upsert
from pitloom.streaming.kslack import into_store

KEYS = ["event_ts", "as_of_ts", "coin", "metric", "source"]


def fact(day, value, seq=0, coin="btc", as_of=None):
    return (ts(day), ts(as_of or day), coin, "m", value, "s", "final", seq)


SEQ_METRICS = METRICS + f", {SEQ} long"


def test_missing_store_is_typed_and_empty(spark, tmp_path):
    df = read_store(spark, str(tmp_path / "none"), METRICS)
    assert df.count() == 0 and df.dtypes[0] == ("event_ts", "timestamp")


def test_upsert_replaces_and_keeps(spark, tmp_path):
    root = str(tmp_path / "store")
    first = spark.createDataFrame([fact("2024-01-31", 1.0), fact("2024-02-01", 2.0), fact("2024-02-02", 3.0), fact("2024-02-02", 4.0, 1)], SEQ_METRICS)
    assert upsert(spark, first, root, METRICS, KEYS, "event_ts") == 3
    assert upsert(spark, first, root, METRICS, KEYS, "event_ts") == 3
    before = os.stat(next((tmp_path / "store" / "year=2024" / "month=1").glob("*.parquet"))).st_mtime_ns
    time.sleep(0.02)
    again = spark.createDataFrame([fact("2024-02-02", 9.0), fact("2024-02-03", 5.0), fact("2024-02-02", 7.0, as_of="2024-03-01")], SEQ_METRICS)
    assert upsert(spark, again, root, METRICS, KEYS, "event_ts") == 4
    rows = {(r.event_ts.day, r.event_ts.month, r.as_of_ts.month): r.value for r in read_store(spark, root, METRICS).collect()}
    assert rows == {(31, 1, 1): 1.0, (1, 2, 2): 2.0, (2, 2, 2): 9.0, (2, 2, 3): 7.0, (3, 2, 2): 5.0}
    assert os.stat(next((tmp_path / "store" / "year=2024" / "month=1").glob("*.parquet"))).st_mtime_ns == before
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]


def test_conform(spark):
    df = spark.createDataFrame([(1, "x", "2024-01-01")], "extra int, coin string, event_ts string")
    assert conform(df, "event_ts timestamp, coin string").columns == ["event_ts", "coin"]
    with pytest.raises(ValueError, match="metric"):
        conform(df, METRICS)


def test_stream_upserts_equal_the_batch(spark, tmp_path):
    rows = [fact(f"2024-0{1 + i % 3}-1{i % 9}", float(i), i) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], SEQ_METRICS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(SEQ_METRICS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = into_store(stream, str(tmp_path / "cp"), lambda df, _id: upsert(spark, df, str(tmp_path / "out"), METRICS, KEYS, "event_ts"))
        q.awaitTermination(120)
    want = {}
    for r in rows:
        want[r[0]] = r[4]
    assert {r.event_ts.replace(tzinfo=dt.timezone.utc): r.value for r in read_store(spark, str(tmp_path / "out"), METRICS).collect()} == want


def test_json_logs(spark, tmp_path):
    lines = [json.dumps({"asof": "2024-01-02", "x": 1}), '{"asof": "2024-01-01", "x": 2}', '{"asof": "2024-13-01"}', "{broken", '{"x": 3}', ""]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows, counts = read_jsonl(spark, str(tmp_path / "log.jsonl"), "asof string, x int", "asof")
    assert [(r.asof, r.x) for r in rows.collect()] == [("2024-01-01", 2), ("2024-01-02", 1)]
    assert tuple(counts.collect()[0]) == (2, 3)
    folder = tmp_path / "logs"
    folder.mkdir()
    for i, name in enumerate(("b.jsonl", "a.jsonl")):
        (folder / name).write_text(json.dumps({"step": name}) + "\n{cut")
        os.utime(folder / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [r.step for r in read_newest(spark, str(folder), "step string").collect()] == ["a.jsonl"]


def test_csv_and_layouts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 7), (2, None, 14)], "id int, x double, horizon int")
    assert export_csv(df, str(tmp_path / "out")) == 2
    assert export_csv(df.limit(0), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), "id int, x double, horizon int").collect())) == [(1, 2.5, 7), (2, None, 14)]
    (tmp_path / "bad.csv").write_text("id,x\n1,2.0\nzz,1\n3,4\n")
    assert [r.id for r in read_csv(spark, str(tmp_path / "bad.csv"), "id int, x double").collect()] == [1, 3]
    stage_by(df, "horizon", str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"horizon=7", "horizon=14"}


def test_column_families(spark):
    base = spark.createDataFrame([(1, 5, 1.0, 9.0), (2, 6, 2.0, 9.0)], "d int, keep int, oi_a double, oi_b double")
    fresh = spark.createDataFrame([(2, 7.0), (3, 8.0)], "d int, oi_c double")
    assert sorted(map(tuple, replace_family(base, fresh, "d", "oi_").collect())) == [(1, 5, None), (2, 6, 7.0), (3, None, 8.0)]


def test_ingest_expressions(spark):
    df = spark.createDataFrame([("u", "t", "<p>a&nbsp;<b>x</b>\n y</p>", 1_700_000_000_123, "1.5", "", "2024-01-01")], "u string, t string, h string, e long, a string, b string, d string")
    r = df.select(stable_id("u", "t").alias("i"), strip_tags("h").alias("h"), F.unix_micros(epoch_to_ts("e")).alias("ms"), F.unix_micros(epoch_to_ts(F.col("e") * 1000)).alias("us")).collect()[0]
    assert r.i == int(__import__("hashlib").sha1(b"u|t").hexdigest()[:15], 16) and r.h == "a&nbsp; x y" and r.ms == r.us == 1_700_000_000_123_000
    long = long_metrics(df.withColumn("d", F.to_timestamp("d")), ["u"], ["a", "b"], "d", ["a"]).collect()
    assert [(x.metric, x.value, x.as_of_ts.day) for x in long] == [("a", 1.5, 8)]


def test_bitemporal_helpers(spark):
    df = spark.createDataFrame([fact("2024-01-01", 1.0), fact("2024-01-02", 2.0, as_of="2024-02-01"), (None, None, "btc", "m", 3.0, "s", None, 0)], SEQ_METRICS)
    assert [r.value for r in known_at(df, ts("2024-01-15")).collect()] == [1.0]
    assert [r.value for r in newest(df.dropna(subset=["event_ts"]), ["coin"], [F.desc("event_ts")]).collect()] == [2.0]
    s = spark.createDataFrame([("WBTCUSD, ETHUSD",), (" BTCUSD ,X",), (None,), ("",)], "s string")
    assert [r.x for r in s.select(has_token("s", "BTCUSD").alias("x")).collect()] == [False, True, None, False]


def test_asof_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 1, "x"), ("a", 5, 1, "y"), ("a", 5, 2, "z"), ("c", 1, 1, "w")], "k string, at int, o int, v string")
    assert {r.id: r.v for r in asof_backward(left, right, ["k"], "t", "at", ["o"], ["v"]).collect()} == {1: "z", 2: None, 3: None, 4: "z"}
    days = spark.sql("SELECT explode(array(DATE '2024-01-01', DATE '2024-01-04')) AS d, 1 AS k")
    assert [r.day.day for r in calendar_gaps(days, ["k"], "d").orderBy("day").collect()] == [2, 3]
    runs = spark.createDataFrame([(1, i) for i in (1, 2, 3, 7, 8, 20)], "k int, i int")
    assert sorted(r.i for r in drop_head_of_runs(runs, ["k"], "i", 1).collect()) == [2, 3, 8]


def test_windows_need_enough_rows(spark):
    s = Series(("k",), ("t",))
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, None, 3.0, 0.0, 0.0])], "k int, t int, x double")
    rows = df.select(rolling_mean("x", s, 2).alias("m"), rolling_mean("x", s, 3, 1).alias("m1"), zscore("x", s, 2).alias("z"), pct_change("x", s).alias("c")).collect()
    assert [r.m for r in rows] == [None, None, None, 1.5, 0.0] and [r.m1 for r in rows] == [1.0, 1.0, 2.0, 1.5, 1.0]
    assert rows[4].z is None and rows[4].c is None and rows[3].c == -1.0


def test_folds(spark):
    xs = [5.0, None, 7.0, 1.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [("b", 0, 2.0)], "k string, t int, x double")
    got = {(r.k, r.t): r.ema for r in exponential_mean(df, ["k"], "t", "x", 0.5).collect()}
    assert got == {("a", 0): 5.0, ("a", 1): 5.0, ("a", 2): 6.0, ("a", 3): 3.5, ("b", 0): 2.0}
    labels = list("AABABBBCAA")
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "k int, t int, x string")
    assert "".join(r.smooth for r in smooth_labels(df, ["k"], "t", "x", 2).orderBy("t").collect()) == "AAAAABBBBA"


def test_volume_buckets(spark):
    rows = [("s", i, 10.0, q, m) for i, (q, m) in enumerate([(4.0, True), (0.0, True), (11.0, False), (1.0, True), (3.0, False)])]
    df = spark.createDataFrame(rows, "k string, t int, p double, q double, m boolean")
    out = volume_buckets(df, ["k"], "t", "p", "q", "m", 5.0).orderBy("bucket").collect()
    assert [(r.bucket, r.volume, r.buy, r.sell) for r in out] == [(0, 5.0, 1.0, 4.0), (1, 5.0, 5.0, 0.0), (2, 5.0, 5.0, 0.0), (3, 4.0, 3.0, 1.0)]
    assert order_imbalance(volume_buckets(df, ["k"], "t", "p", "q", "m", 5.0), ["k"], 5.0).collect()[0].n_buckets == 4
    one = spark.createDataFrame([("s", i, 1.0, 1.0, i % 2 == 0) for i in range(100)], "k string, t int, p double, q double, m boolean")
    assert fast_buckets(one, ["k"], "t", "q", "m", 10).collect()[0].vpin < 0.2
    assert fast_buckets(one.withColumn("m", F.lit(True)), ["k"], "t", "q", "m", 10).collect()[0].vpin > 0.9
    assert volume_buckets(df.limit(0), ["k"], "t", "p", "q", "m", 5.0).count() == 0


def test_statistics(spark):
    assert expected_maximum(1, 1.0) == 0.0 and 1.5 < expected_maximum(10, 1.0) < 1.6
    r = spark.createDataFrame([(0.0,), (None,)], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()
    assert r[0].p == 0.5 and r[1].p is None
    rows = purged_splits(spark, 83, 8, 2, 3)
    assert rows.select("split").distinct().count() == 28 and rows.count() == 28 * 83
    first = {x.row: x.role for x in rows.filter("split = 0").collect()}
    assert [first[i] for i in (0, 19, 20, 22, 23, 82)] == ["test", "test", "embargo", "embargo", "train", "train"]
    q = spark.createDataFrame([(1, i, 0.01 * (-1) ** i) for i in range(40)] + [(2, 0, 0.1)], "k int, t int, r double")
    a, b = (sorted(map(tuple, block_bootstrap(q, ["k"], "t", "r", 5, 4, 1).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == 10 and all(x[2] is None for x in a if x[0] == 2)


def test_stage_and_small(spark):
    df = spark.range(50).withColumn("s", F.lit("x"))
    assert stage(df).count() == 50 and shared_folder(spark)
    assert "ResolvedHint" in small(df)._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in small(df, 10)._jdf.queryExecution().analyzed().toString()


def test_run_lengths_find_the_change(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(8, 1, 60)])
    run = run_length_posterior(x, 0.01)
    assert run[79] >= 75 and run[-1] in range(57, 63)
    assert list(run_length_posterior(np.zeros(0), 0.1)) == [] and len(run_length_posterior(np.zeros(5), 0.1)) == 5
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, None)], "k int, t int, v double")
    out = change_points(df, ["k"], "t", "v").collect()
    assert len(out) == 140 and max(r.t for r in out) == 139


def test_permutations_keep_the_observed(spark):
    df = spark.createDataFrame([(1, i, (-1.0) ** i, 0.1 * (-1.0) ** i) for i in range(30)], "k int, t int, s double, r double")
    out = {r.draw: r["mean"] for r in permutation_null(df, ["k"], "t", "s", "r", 50, 3).collect()}
    assert abs(out[-1] - 0.1) < 1e-12 and all(out[-1] >= v - 1e-12 for v in out.values()) and len(out) == 51


def test_wide_frame_and_folds(spark):
    from pitloom.operators.pit import walk_forward_folds, wide_as_of

    rows = [("c", "a", 1.0, ts("2024-01-05"), 1), ("c", "a", 2.0, ts("2024-02-05"), 1), ("c", "b", None, ts("2024-01-06"), 1), ("c", "a", 9.0, ts("2024-02-05"), 2)]
    df = spark.createDataFrame(rows, "k string, metric string, value double, at timestamp, o int")
    dates = F.array(*[F.lit(ts(x)) for x in ("2024-01-01", "2024-01-05", "2024-03-01")])
    out = wide_as_of(df, dates, ["k"], ["a", "b", "never"], "at", ["o"]).orderBy("date").collect()
    assert [(r.a, r.b, r.never) for r in out] == [(None, None, None), (1.0, None, None), (9.0, None, None)]
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-31')) AS day")
    folds = {r.fold_date.isoformat(): r.n_train for r in walk_forward_folds(days, "day", 10, 5, 7, 20).collect()}
    assert folds["2024-01-21"] == 14 and folds["2024-03-01"] == 20 and "2024-01-11" not in folds
