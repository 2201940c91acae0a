"""Further queries of the reference's operators: files, streams, indicators, significance."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.folds import exponential_mean
from ..functions.stats import change_points, expected_maximum, normal_cdf, permutation_null, sharpe
from ..functions.windows import Series, log_change, rolling_mean, zscore
from ..session import scratch, small
from ..sources.stores import UNLOCKS, export_csv, read_csv, read_jsonl, read_store, stage_by, upsert
from ..streaming.kslack import into_store
from .registry import Registry
from .views import BARS, RETURNS, TICKS, bars, returns, table, ticks

R = Registry()
add = R.add
S = Series(("symbol",), ("date",))
W = "w AS (PARTITION BY symbol ORDER BY date)"


def folder(spark, name: str) -> str:
    return scratch(spark, name)


@add("SRC03_csv", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def src03(spark, d):
    path = folder(spark, "orders")
    export_csv(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    rows = read_csv(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@add("SRC04_json_lines", "SELECT count(*) FILTER (regexp_matches(cycle_id, '^\\d{4}-\\d{2}-\\d{2}$')) AS n_rows, count(*) FILTER (NOT regexp_matches(cycle_id, '^\\d{4}-\\d{2}-\\d{2}$')) AS n_malformed FROM cycles WHERE cycle_id IS NOT NULL")
def src04(spark, d):
    path = folder(spark, "log")
    lines = table(spark, d, "cycles").filter("cycle_id IS NOT NULL").select(F.to_json(F.struct(F.col("cycle_id").alias("asof"), "n_trades")).alias("value"))
    lines.write.text(path)
    return read_jsonl(spark, path, "asof string, n_trades int", "asof")[1]


@add("SNK08_latest_by_key", "SELECT id, arg_max(status, (epoch_us(loaded_ts), status)) AS status FROM trades WHERE loaded_ts IS NOT NULL GROUP BY 1")
def snk08(spark, d):
    return table(spark, d, "trades").filter("loaded_ts IS NOT NULL").groupBy("id").agg(F.max_by("status", F.struct("loaded_ts", "status")).alias("status"))


@add("SNK10_by_horizon", "SELECT horizon, count(*) AS n, round(sum(pred_value), 2) AS total FROM predictions WHERE horizon IS NOT NULL GROUP BY 1")
def snk10(spark, d):
    path = folder(spark, "preds")
    stage_by(table(spark, d, "predictions").filter("horizon IS NOT NULL").select("id", "horizon", "pred_value"), "horizon", path)
    return spark.read.parquet(path).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pred_value"), 2).alias("total"))


@add("STM02_stream_upsert", "SELECT coin, source, recipient_category, count(*) AS n FROM (SELECT DISTINCT epoch_us(unlock_date) AS u, epoch_us(as_of_ts) AS a, coin, recipient_category, source FROM unlocks WHERE unlock_date IS NOT NULL AND as_of_ts IS NOT NULL) GROUP BY ALL")
def stm02(spark, d):
    incoming, root, state = folder(spark, "in"), folder(spark, "unlocks"), folder(spark, "checkpoint")
    rows = table(spark, d, "unlocks").select("unlock_date", "as_of_ts", "coin", "amount_tokens", "pct_circulating_supply", "recipient_category", "source").dropna(subset=["unlock_date", "as_of_ts"])
    rows.repartition(3).write.parquet(incoming)
    keys = ["unlock_date", "as_of_ts", "coin", "recipient_category", "source"]
    stream = spark.readStream.schema(UNLOCKS).option("maxFilesPerTrigger", 1).parquet(incoming)
    into_store(stream, state, lambda batch, _id: upsert(batch.sparkSession, batch, root, UNLOCKS, keys, "unlock_date")).awaitTermination()
    return read_store(spark, root, UNLOCKS).groupBy("coin", "source", "recipient_category").agg(F.count(F.lit(1)).alias("n"))


@add("STM04_stream_distinct", "SELECT DISTINCT id, epoch_us(as_of_ts) AS a FROM news WHERE as_of_ts IS NOT NULL")
def stm04(spark, d):
    incoming, out, state = folder(spark, "in"), folder(spark, "out"), folder(spark, "checkpoint")
    table(spark, d, "news").select("id", "as_of_ts").filter("as_of_ts IS NOT NULL").write.parquet(incoming)
    stream = spark.readStream.schema("id long, as_of_ts timestamp").parquet(incoming)
    once = stream.withWatermark("as_of_ts", "30 days").dropDuplicatesWithinWatermark(["id", "as_of_ts"])
    once.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("id", F.unix_micros("as_of_ts").alias("a"))


@add("base_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 6 HOUR, max(ts)) FROM events) GROUP BY ALL")
def base_stream(spark, d):
    incoming, out, state = folder(spark, "in"), folder(spark, "out"), folder(spark, "checkpoint")
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("t"), "event_type").write.parquet(incoming)
    stream = spark.readStream.schema("t timestamp, event_type string").parquet(incoming)
    n = stream.withWatermark("t", "0 seconds").groupBy(F.window("t", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    n.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@add("FLT10_csv_text_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def flt10(spark, d):
    lines = table(spark, d, "orders").select(F.concat_ws(",", "o_orderkey", F.col("o_orderdate").cast("date")).alias("line"))
    parsed = lines.select(F.from_csv("line", "o_orderkey long, day date").alias("r")).select("r.*")
    return parsed.filter("day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")


@add("FLT11_closed_bars", f"WITH {BARS} SELECT symbol, max(date) AS last, count(*) AS n FROM bars WHERE date < (SELECT max(date) FROM bars) GROUP BY 1")
def flt11(spark, d):
    b = bars(spark, d)
    now = b.agg(F.max("date").alias("now"))
    return b.join(F.broadcast(now), F.col("date") < F.col("now")).groupBy("symbol").agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))  # one row


_G = f"{BARS}, g AS (SELECT symbol, date, close, high, low, lag(close) OVER w AS p, row_number() OVER w AS i FROM bars WINDOW {W})"


@add("WIN23_wilder_rsi", f"""WITH RECURSIVE {_G}, f AS (SELECT symbol, i, date, greatest(close - p, 0) AS u, greatest(p - close, 0) AS v FROM g WHERE i = 2
UNION ALL SELECT g.symbol, g.i, g.date, f.u + (greatest(g.close - g.p, 0) - f.u) / 14, f.v + (greatest(g.p - g.close, 0) - f.v) / 14 FROM f JOIN g ON g.symbol = f.symbol AND g.i = f.i + 1) SELECT symbol, date, round(100 * u / nullif(u + v, 0), 3) AS rsi FROM f""")
def wilder_rsi(spark, d):
    g = bars(spark, d).select("symbol", "date", (F.col("close") - F.lag("close").over(S.w)).alias("x")).filter("x IS NOT NULL")
    up = exponential_mean(g.withColumn("u", F.greatest("x", F.lit(0.0))), ["symbol"], "date", "u", 1 / 14, "eu")
    down = exponential_mean(g.withColumn("v", F.greatest(-F.col("x"), F.lit(0.0))), ["symbol"], "date", "v", 1 / 14, "ev")
    both = up.join(down, ["symbol", "date"])
    return both.select("symbol", "date", F.round(100 * F.try_divide("eu", F.nullif(F.col("eu") + F.col("ev"), F.lit(0.0))), 3).alias("rsi"))


@add("WIN23_average_range", f"""WITH RECURSIVE {_G}, t AS (SELECT symbol, date, i, greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS x FROM g), f AS (SELECT symbol, i, date, x AS a FROM t WHERE i = 1
UNION ALL SELECT t.symbol, t.i, t.date, f.a + (t.x - f.a) / 14 FROM f JOIN t ON t.symbol = f.symbol AND t.i = f.i + 1) SELECT symbol, date, round(a, 3) AS atr FROM f""")
def average_range(spark, d):
    p = F.lag("close").over(S.w)
    t = bars(spark, d).select("symbol", "date", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)).alias("x"))
    return exponential_mean(t, ["symbol"], "date", "x", 1 / 14, "a").select("symbol", "date", F.round("a", 3).alias("atr"))


@add("MET02_position_changes", f"WITH {BARS}, s AS (SELECT symbol, date, sign(close - lag(close) OVER w) AS x FROM bars WINDOW {W}) SELECT symbol, count(*) FILTER (abs(x - y) > 1e-9) AS n FROM (SELECT symbol, x, lag(x) OVER w AS y FROM s WINDOW {W}) GROUP BY 1")
def met02(spark, d):
    s = bars(spark, d).select("symbol", "date", F.signum(F.col("close") - F.lag("close").over(S.w)).alias("x"))
    return s.select("symbol", F.abs(F.col("x") - F.lag("x").over(S.w)).alias("c")).groupBy("symbol").agg(F.count_if(F.col("c") > 1e-9).alias("n"))


@add("MET15_probabilistic_sharpe")
def met15(spark, d):
    q = returns(spark, d).groupBy("symbol").agg((sharpe(F.col("ret"), 1)).alias("sr"), F.count("ret").alias("n"))
    best = expected_maximum(12, 1e-4)
    z = (F.col("sr") - best) * F.sqrt(F.col("n") - 1) / F.sqrt(1 + F.col("sr") * F.col("sr") / 2)
    return q.select("symbol", F.round("sr", 6).alias("sr"), normal_cdf(z).alias("p"))


@add("MET16_standard_error", f"WITH {RETURNS} SELECT symbol, round(sqrt((1 + pow(avg(ret) / stddev_samp(ret), 2) / 2) / count(*)) * sqrt(252), 6) AS se FROM returns GROUP BY 1")
def met16(spark, d):
    sr = sharpe(F.col("ret"), 1)
    return returns(spark, d).groupBy("symbol").agg(F.round(F.sqrt((1 + sr * sr / 2) / F.count("ret")) * math.sqrt(252), 6).alias("se"))


@add("MET19_permutation")
def met19(spark, d):
    rows = returns(spark, d).select("symbol", "date", "ret", F.coalesce(F.signum(F.lag("ret").over(S.w)), F.lit(0.0)).alias("sig"))
    null = permutation_null(rows, ["symbol"], "date", "sig", "ret", 200, 11)
    seen = null.groupBy("symbol").agg(F.max(F.when(F.col("draw") == -1, F.col("mean"))).alias("observed"), F.collect_list(F.when(F.col("draw") >= 0, F.col("mean"))).alias("m"))
    return seen.select("symbol", "observed", (F.size(F.filter("m", lambda x: x >= F.col("observed"))) / F.size("m")).alias("p"))


@add("MET25_run_lengths")
def met25(spark, d):
    return change_points(returns(spark, d), ["symbol"], "date", "ret")


@add("TIC06_daily_block", f"WITH {TICKS}, d AS (SELECT symbol, date, avg(price) AS f, sum(qty) AS oi FROM ticks GROUP BY ALL) SELECT symbol, date, round((f - CASE WHEN count(f) OVER w10 >= 10 THEN avg(f) OVER w10 END) / nullif(CASE WHEN count(f) OVER w10 >= 10 THEN stddev_samp(f) OVER w10 END, 0), 5) AS z, round(f - CASE WHEN count(f) OVER w7 >= 7 THEN avg(f) OVER w7 END, 5) AS slope, round(CASE WHEN oi > 0 AND lag(oi) OVER w > 0 THEN ln(oi) - ln(lag(oi) OVER w) END, 5) AS change FROM d WINDOW {W}, w10 AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), w7 AS (PARTITION BY symbol ORDER BY date ROWS 6 PRECEDING)")
def tic06(spark, d):
    daily = ticks(spark, d).groupBy("symbol", "date").agg(F.avg("price").alias("f"), F.sum("qty").alias("oi"))
    return daily.select("symbol", "date", F.round(zscore("f", S, 10), 5).alias("z"), F.round(F.col("f") - rolling_mean("f", S, 7), 5).alias("slope"), F.round(log_change("oi", S), 5).alias("change"))


@add("SCL08_summary_lines", f"WITH {BARS}, l AS (SELECT symbol, date, volume, lag(volume, 7) OVER w AS v7 FROM bars WINDOW {W}) SELECT '- **' || symbol || '**: ' || CAST(CAST(arg_max(volume, date) AS BIGINT) AS VARCHAR) || ', ' || CASE WHEN arg_max(volume, date) >= arg_max(v7, date) THEN 'up' ELSE 'down' END || ' over 7 bars' AS line FROM l GROUP BY symbol")
def scl08(spark, d):
    last = bars(spark, d).select("symbol", "date", "volume", F.lag("volume", 7).over(S.w).alias("v7")).groupBy("symbol").agg(F.max_by("volume", "date").alias("v"), F.max_by("v7", "date").alias("v7"))
    way = F.when(F.col("v") >= F.col("v7"), "up").otherwise("down")
    return last.select(F.concat(F.lit("- **"), "symbol", F.lit("**: "), F.col("v").cast("long").cast("string"), F.lit(", "), way, F.lit(" over 7 bars")).alias("line"))


@add("SCL14_symbol_names", "SELECT t.id, t.coin, coalesce(m.short, upper(t.coin)) AS symbol FROM (SELECT DISTINCT id, coin FROM trades) t LEFT JOIN (VALUES ('bitcoin', 'BTC'), ('ethereum', 'ETH'), ('solana', 'SOL')) m(name, short) ON m.name = t.coin")
def scl14(spark, d):
    names = spark.createDataFrame([("bitcoin", "BTC"), ("ethereum", "ETH"), ("solana", "SOL")], "coin string, short string")
    return table(spark, d, "trades").select("id", "coin").distinct().join(small(names), "coin", "left").select("id", "coin", F.coalesce("short", F.upper("coin")).alias("symbol"))


@add("MET26_modes", "SELECT m.mode, count(*) AS n, round(sum(CASE m.mode WHEN 'plain' THEN base_size WHEN 'confident' THEN base_size * confidence WHEN 'capped' THEN least(base_size, 0.02) END), 4) AS total FROM sizing, (VALUES ('plain'), ('confident'), ('capped')) m(mode) GROUP BY 1")
def met26(spark, d):
    b, c = F.col("base_size"), F.col("confidence")
    modes = {"plain": b, "confident": b * c, "capped": F.when(b.isNotNull(), F.least(b, F.lit(0.02))).otherwise(F.lit(0.02))}
    rows = table(spark, d, "sizing").select(F.inline(F.array(*[F.struct(F.lit(k).alias("mode"), v.alias("x")) for k, v in modes.items()])))
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))
