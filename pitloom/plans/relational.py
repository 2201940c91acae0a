"""Queries of the stores, joins, aggregations, sorts and set operations (SRC, FLT, PRJ, JON, AGG, ORD, SET, base)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import Series, backward_fill, forward_fill
from ..operators.pit import asof_backward, calendar_gaps, drop_head_of_runs, has_token, known_at, newest
from ..operators.shards import clean_name
from ..sources.stores import conform, epoch_to_ts, keep_last, long_metrics, stable_id, strip_tags, METRICS
from .registry import Registry
from .views import BARS, TICKS, bars, table, ticks

R = Registry()
add = R.add
_T = "TIMESTAMP '2024-06-30 00:00:00'"
E = "make_timestamp(epoch_us({0}))"


def us(c):
    return F.unix_micros(c)


def as_of():
    return F.expr(_T)


def exact(c):
    """A number as a decimal, whose sums do not depend on the order of rows."""
    return F.col(c).cast("decimal(38,9)")


# --- sources and projections


@add("SRC01_scan", "SELECT coin, metric, count(*) AS n, count(*) FILTER (isfinite(value)) AS n_usable, sum(CASE WHEN isfinite(value) THEN CAST(CAST(value AS VARCHAR) AS DECIMAL(38,9)) END) AS total FROM onchain GROUP BY ALL")
def src01(spark, d):
    usable = F.expr("abs(value) < double('Infinity') AND NOT isnan(value)")
    rows = conform(table(spark, d, "onchain"), METRICS)
    return rows.groupBy("coin", "metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("n_usable"), F.sum(F.when(usable, F.col("value")).cast("decimal(38,9)")).alias("total"))


@add("SRC09_long_metrics", "WITH m AS (SELECT o_orderkey, o_orderdate, 'status' AS metric, TRY_CAST(o_orderstatus AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 'price', CAST(o_totalprice AS DOUBLE) FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 'priority', TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) FROM orders) SELECT o_orderkey, metric, value, epoch_us(o_orderdate + CASE WHEN metric = 'priority' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END) AS known_us FROM m WHERE value IS NOT NULL")
def src09(spark, d):
    wide = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("string").alias("price"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    return long_metrics(wide, ["o_orderkey"], ["status", "price", "priority"], "t", ["priority"]).select("o_orderkey", "metric", "value", us("as_of_ts").alias("known_us"))


@add("SRC11_news_ids", "SELECT DISTINCT id, CAST(('0x' || left(sha1(url || '|' || coalesce(headline, '')), 15)) AS BIGINT) AS stable_id, trim(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS plain FROM news WHERE url IS NOT NULL")
def src11(spark, d):
    rows = table(spark, d, "news").filter("url IS NOT NULL").withColumn("h", F.coalesce("headline", F.lit("")))
    return rows.select("id", stable_id("url", "h").alias("stable_id"), strip_tags(F.coalesce("content", F.lit(""))).alias("plain")).distinct()


@add("SRC07_epoch_units", "SELECT event_id, epoch_us(ts) AS us FROM events")
def src07(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    raw = e.select("event_id", F.when(F.pmod(us("t"), F.lit(1000)) == 0, F.unix_millis("t")).otherwise(us("t")).alias("raw"))
    return raw.select("event_id", us(epoch_to_ts("raw")).alias("us"))


@add("PRJ02_column_groups", "SELECT CASE WHEN metric LIKE 'Flow%' OR metric LIKE 'NetFlow%' THEN 'flow' WHEN metric LIKE 'Adr%' OR metric LIKE 'Tx%' THEN 'activity' WHEN metric LIKE 'Sply%' THEN 'supply' ELSE 'other' END AS family, count(*) AS n FROM onchain GROUP BY ALL")
def prj02(spark, d):
    m, family = F.col("metric"), F.lit("other")
    for prefixes, name in ((("Sply",), "supply"), (("Adr", "Tx"), "activity"), (("Flow", "NetFlow"), "flow")):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | m.startswith(p)
        family = F.when(hit, name).otherwise(family)
    return table(spark, d, "onchain").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@add("PRJ03_align_columns", "SELECT id, coalesce(realized_vol, 0) AS realized_vol, coalesce(kelly, 0) AS kelly, 0.0::DOUBLE AS absent FROM sizing")
def prj03(spark, d):
    rows = table(spark, d, "sizing")
    return rows.select("id", *[(F.coalesce(c, F.lit(0.0)) if c in rows.columns else F.lit(0.0)).alias(c) for c in ("realized_vol", "kelly", "absent")])


@add("PRJ05_no_nan", "SELECT reading_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value FROM onchain")
def prj05(spark, d):
    v = F.col("value")
    return table(spark, d, "onchain").select("reading_id", F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v).alias("value"))


# --- filters


@add("FLT01_pit_range", f"SELECT coin, metric, source, reading_id, epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, CASE WHEN NOT isnan(value) THEN value END AS value FROM onchain WHERE {E.format('event_ts')} BETWEEN TIMESTAMP '2023-06-01' AND {_T} AND {E.format('as_of_ts')} <= {_T} AND metric IN ('PriceUSD', 'TxCnt')")
def flt01(spark, d):
    seen = known_at(table(spark, d, "onchain"), as_of(), F.expr("TIMESTAMP '2023-06-01'"), as_of()).filter(F.col("metric").isin("PriceUSD", "TxCnt"))
    return seen.select("coin", "metric", "source", "reading_id", us("event_ts").alias("e"), us("as_of_ts").alias("a"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


@add("FLT02_pit_news", f"SELECT id, epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a FROM (SELECT DISTINCT id, event_ts, as_of_ts, symbols FROM news) WHERE {E.format('as_of_ts')} <= {_T} AND {E.format('event_ts')} >= TIMESTAMP '2023-01-01' AND {E.format('event_ts')} <= {_T} AND list_contains(list_transform(string_split(symbols, ','), lambda x: trim(x)), 'BTCUSD') ORDER BY e DESC, a DESC, id LIMIT 50")
def flt02(spark, d):
    rows = table(spark, d, "news").select("id", "event_ts", "as_of_ts", "symbols").distinct()
    seen = known_at(rows, as_of(), F.expr("TIMESTAMP '2023-01-01'"), as_of()).filter(has_token("symbols", "BTCUSD"))
    return seen.select("id", us("event_ts").alias("e"), us("as_of_ts").alias("a")).orderBy(F.desc("e"), F.desc("a"), "id").limit(50)


@add("FLT03_lookback", f"SELECT DISTINCT epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, value FROM fng WHERE {E.format('event_ts')} BETWEEN {_T} - INTERVAL 30 DAY AND {_T} AND {E.format('as_of_ts')} <= {_T}")
def flt03(spark, d):
    return known_at(table(spark, d, "fng"), as_of(), F.expr(f"{_T} - INTERVAL 30 DAYS"), as_of()).select(us("event_ts").alias("e"), us("as_of_ts").alias("a"), "value").distinct()


@add("FLT04_future_window", f"SELECT DISTINCT unlock_id, epoch_us(unlock_date) AS e, amount_tokens FROM unlocks WHERE {E.format('unlock_date')} BETWEEN {_T} AND {_T} + INTERVAL 90 DAY AND {E.format('as_of_ts')} <= {_T} AND recipient_category IN ('team', 'investor', 'treasury')")
def flt04(spark, d):
    seen = known_at(table(spark, d, "unlocks"), as_of(), as_of(), F.expr(f"{_T} + INTERVAL 90 DAYS"), event_ts="unlock_date")
    return seen.filter(F.col("recipient_category").isin("team", "investor", "treasury")).select("unlock_id", us("unlock_date").alias("e"), "amount_tokens").distinct()


@add("FLT06_optional_filters", "SELECT coin, side, count(*) AS n FROM trades WHERE side = 'SELL' AND epoch_us(loaded_ts) >= 1704067200000000 GROUP BY ALL")
def flt06(spark, d):
    wanted = {"side": "SELL", "coin": None, "since": F.expr("TIMESTAMP '2024-01-01'")}
    rows = table(spark, d, "trades")
    for name in ("side", "coin"):
        if wanted[name] is not None:
            rows = rows.filter(F.col(name) == wanted[name])
    if wanted["since"] is not None:
        rows = rows.filter(F.col("loaded_ts") >= wanted["since"])
    return rows.groupBy("coin", "side").agg(F.count(F.lit(1)).alias("n"))


@add("FLT07_fill_both_ways", f"WITH {BARS}, holes AS (SELECT symbol, date, CASE WHEN day(date) % 5 > 1 THEN close END AS close FROM bars) SELECT symbol, date, coalesce(last_value(close IGNORE NULLS) OVER w, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM holes WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")
def flt07(spark, d):
    s = Series(("symbol",), ("date",))
    holes = bars(spark, d).select("symbol", "date", F.when(F.dayofmonth("date") % 5 > 1, F.col("close")).alias("close"))
    return holes.select("symbol", "date", F.coalesce(forward_fill("close", s), backward_fill("close", s)).alias("close"))


@add("FLT09_nested_filter", f"SELECT unlock_id, list_sort(list_distinct(list(epoch_us(as_of_ts)) FILTER ({E.format('as_of_ts')} <= {_T}))) AS seen FROM unlocks GROUP BY unlock_id HAVING count(*) FILTER ({E.format('as_of_ts')} <= {_T}) > 0")
def flt09(spark, d):
    lists = table(spark, d, "unlocks").groupBy("unlock_id").agg(F.collect_set(us("as_of_ts")).alias("all"))
    limit = F.unix_micros(as_of())
    return lists.select("unlock_id", F.array_sort(F.filter("all", lambda x: x <= limit)).alias("seen")).filter(F.size("seen") > 0)


@add("FLT12_embargo", f"WITH {BARS}, gaps AS (SELECT symbol, date, date - DATE '1970-01-01' AS i FROM bars WHERE day(date) < 20), runs AS (SELECT *, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS r FROM gaps), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, r ORDER BY i) AS n FROM runs) SELECT symbol, date FROM k WHERE n > 3")
def flt12(spark, d):
    rows = bars(spark, d).filter(F.dayofmonth("date") < 20).select("symbol", "date", F.unix_date("date").alias("i"))
    return drop_head_of_runs(rows, ["symbol"], "i", 3).select("symbol", "date")


# --- joins


@add("JON01_asof_backward", """WITH r AS (SELECT DISTINCT lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin, metric, source, epoch_us(as_of_ts) AS a, epoch_us(event_ts) AS e, reading_id, value FROM onchain WHERE as_of_ts IS NOT NULL AND event_ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT request_id, lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin, metric, source, epoch_us(request_ts) AS t FROM asof_requests)
SELECT request_id, arg_max(reading_id, (a, e, reading_id)) AS reading_id FROM q LEFT JOIN r ON q.coin = r.coin AND q.metric = r.metric AND q.source = r.source AND a <= t GROUP BY request_id""")
def jon01(spark, d):
    keys = ["coin", "metric", "source"]
    right = table(spark, d, "onchain").dropna(subset=["as_of_ts", "event_ts", "value"]).filter(~F.isnan("value")).withColumn("coin", clean_name("coin"))
    left = table(spark, d, "asof_requests").withColumn("coin", clean_name("coin"))
    return asof_backward(left, right, keys, "request_ts", "as_of_ts", ["event_ts", "reading_id"], ["reading_id"]).select("request_id", "reading_id")


_DAYS = "days AS (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS DATE) AS date)"


def _days(spark):
    return spark.sql("SELECT explode(sequence(DATE '2023-01-01', DATE '2025-12-31')) AS date")


_F = "f AS (SELECT CAST(make_timestamp(epoch_us(event_ts)) AS DATE) AS date, arg_max(value, (epoch_us(event_ts), epoch_us(as_of_ts), value)) AS value FROM fng WHERE value IS NOT NULL AND event_ts IS NOT NULL AND as_of_ts IS NOT NULL GROUP BY 1)"


def _fng_daily(spark, d):
    rows = table(spark, d, "fng").dropna(subset=["event_ts", "as_of_ts", "value"])
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("event_ts") / 86400).cast("int"))
    return rows.groupBy(day.alias("date")).agg(F.max_by("value", F.struct("event_ts", "as_of_ts", "value")).alias("value"))


@add("JON02_reindex_forward", f"WITH {_DAYS}, {_F} SELECT days.date, f.value FROM days ASOF LEFT JOIN f ON days.date >= f.date")
def jon02(spark, d):
    left = _days(spark).withColumn("k", F.lit(0))
    right = _fng_daily(spark, d).select(F.lit(0).alias("k"), F.col("date").alias("at"), "value")
    return asof_backward(left, right, ["k"], "date", "at", [], ["value"]).drop("k")


@add("JON03_exact_then_fill", f"WITH {_DAYS}, {_F} SELECT days.date, last_value(f.value IGNORE NULLS) OVER (ORDER BY days.date ROWS UNBOUNDED PRECEDING) AS value FROM days LEFT JOIN f ON days.date = f.date")
def jon03(spark, d):
    joined = _days(spark).join(_fng_daily(spark, d), "date", "left")
    return joined.select("date", F.last("value", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("value"))


_P = "p AS (SELECT lower(trim(cycle_id)) AS cycle_id, coin, horizon, max(pred_value) AS v FROM predictions WHERE trim(cycle_id) <> '' GROUP BY ALL)"


def _preds(spark, d):
    rows = table(spark, d, "predictions").filter(F.trim("cycle_id") != "")
    return rows.groupBy(F.lower(F.trim("cycle_id")).alias("cycle_id"), "coin", "horizon").agg(F.max("pred_value").alias("v"))


@add("JON04_inner", f"WITH {_P} SELECT a.cycle_id, a.coin, a.v AS h7, b.v AS h14 FROM p a JOIN p b ON a.cycle_id = b.cycle_id AND a.coin = b.coin WHERE a.horizon = 7 AND b.horizon = 14")
def jon04(spark, d):
    p = _preds(spark, d)
    side = lambda h: p.filter(F.col("horizon") == h).select("cycle_id", "coin", F.col("v").alias(f"h{h}"))
    return side(7).join(side(14), ["cycle_id", "coin"])


@add("JON05_horizon_pivot", f"WITH {_P} SELECT cycle_id, coin, max(v) FILTER (horizon = 7) AS h7, max(v) FILTER (horizon = 14) AS h14 FROM p GROUP BY ALL HAVING count(*) FILTER (horizon IN (7, 14)) > 0")
def jon05(spark, d):
    return _preds(spark, d).filter("horizon IN (7, 14)").groupBy("cycle_id", "coin").pivot("horizon", [7, 14]).agg(F.max("v")).withColumnsRenamed({"7": "h7", "14": "h14"})


@add("JON06_full_outer_chain", "WITH a AS (SELECT lower(trim(cycle_id)) AS k, count(*) AS n_pred FROM predictions WHERE trim(cycle_id) <> '' GROUP BY 1), b AS (SELECT lower(trim(cycle_id)) AS k, count(*) AS n_size FROM sizing WHERE trim(cycle_id) <> '' GROUP BY 1), c AS (SELECT lower(trim(cycle_id)) AS k, count(*) AS n_trade FROM trades WHERE trim(cycle_id) <> '' GROUP BY 1) SELECT k, n_pred, n_size, n_trade FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)")
def jon06(spark, d):
    out = None
    for name, col in (("predictions", "n_pred"), ("sizing", "n_size"), ("trades", "n_trade")):
        part = table(spark, d, name).filter(F.trim("cycle_id") != "").groupBy(F.lower(F.trim("cycle_id")).alias("k")).agg(F.count(F.lit(1)).alias(col))
        out = part if out is None else out.join(part, "k", "full")
    return out


@add("JON07_left_fill_zero", f"WITH {BARS}, {_F} SELECT symbol, date, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS value FROM (SELECT symbol, bars.date + 9125 AS date, value FROM bars LEFT JOIN f ON bars.date + 9125 = f.date)")
def jon07(spark, d):
    s = Series(("symbol",), ("date",))
    b = bars(spark, d).select("symbol", F.date_add("date", 9125).alias("date"))
    return b.join(_fng_daily(spark, d), "date", "left").select("symbol", "date", F.coalesce(forward_fill("value", s), F.lit(0)).alias("value"))


@add("JON08_lagged_self", f"WITH {BARS} SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars")
def jon08(spark, d):
    return bars(spark, d).select("symbol", "date", "close", F.lag("close").over(Series(("symbol",), ("date",)).w).alias("prev"))


@add("JON09_common_dates", f"WITH {BARS} SELECT date FROM bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)")
def jon09(spark, d):
    b = bars(spark, d)
    n = b.select(F.count_distinct("symbol").alias("n"))
    return b.groupBy("date").agg(F.count_distinct("symbol").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("date")  # n is one row


@add("JON11_broadcast_series", f"WITH {BARS}, x AS (SELECT date, close AS ref FROM bars WHERE symbol = 'N') SELECT symbol, bars.date, close, ref FROM bars LEFT JOIN x ON bars.date = x.date")
def jon11(spark, d):
    from ..session import small

    b = bars(spark, d)
    return b.select("symbol", "date", "close").join(small(b.filter("symbol = 'N'").select("date", F.col("close").alias("ref"))), "date", "left")


@add("JON13_calendar_gaps", f"WITH {BARS}, span AS (SELECT symbol, min(date) a, max(date) b FROM bars GROUP BY 1), days AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span) SELECT symbol, day FROM days ANTI JOIN bars ON days.symbol = bars.symbol AND days.day = bars.date")
def jon13(spark, d):
    return calendar_gaps(bars(spark, d), ["symbol"], "date")


@add("JON14_semi", "SELECT id, coin FROM predictions p WHERE EXISTS (SELECT 1 FROM trades t WHERE t.coin = p.coin AND t.status = 'FAILED')")
def jon14(spark, d):
    failed = table(spark, d, "trades").filter("status = 'FAILED'").select("coin").distinct()
    return table(spark, d, "predictions").select("id", "coin").join(failed, "coin", "left_semi")


@add("JON15_first_of_duplicates", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS rn FROM orders) SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN o ON c_custkey = o_custkey AND rn = 1")
def jon15(spark, d):
    first = newest(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")])
    return table(spark, d, "customer").select("c_custkey").join(first.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", "left")


# --- aggregations

_TR = "t AS (SELECT DISTINCT * FROM trades)"


def _trades(spark, d):
    return table(spark, d, "trades").distinct()


@add("AGG01_signed_sum", f"WITH {_TR} SELECT coin, round(coalesce(sum(CASE WHEN side = 'SELL' THEN qty * entry_price END), 0) - coalesce(sum(CASE WHEN side = 'BUY' THEN qty * entry_price END), 0), 2) AS net FROM t WHERE status = 'EXECUTED' GROUP BY coin")
def agg01(spark, d):
    x = F.col("qty") * F.col("entry_price")
    part = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, x)), F.lit(0.0))
    return _trades(spark, d).filter("status = 'EXECUTED'").groupBy("coin").agg(F.round(part("SELL") - part("BUY"), 2).alias("net"))


@add("AGG02_conditional_counts", f"WITH {_TR} SELECT coin, count(*) AS n, count(*) FILTER (side = 'SELL') AS n_sell, count(*) - count(*) FILTER (side = 'SELL') AS n_other FROM t GROUP BY coin")
def agg02(spark, d):
    sells = F.count_if(F.col("side") == "SELL")
    return _trades(spark, d).groupBy("coin").agg(F.count(F.lit(1)).alias("n"), sells.alias("n_sell"), (F.count(F.lit(1)) - sells).alias("n_other"))


@add("AGG03_scalars", f"WITH {_TR} SELECT count(*) AS n, max(pnl) AS best, min(pnl) AS worst, count(pnl) AS closed FROM t")
def agg03(spark, d):
    return _trades(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.count("pnl").alias("closed"))


@add("AGG04_group_count", "SELECT coin, metric, count(*) AS n FROM onchain GROUP BY ALL")
def agg04(spark, d):
    return table(spark, d, "onchain").groupBy("coin", "metric").agg(F.count(F.lit(1)).alias("n"))


@add("AGG05_resample", f"WITH {TICKS}, d AS (SELECT symbol, date, round(avg(qty), 6) AS mean, arg_max(price, ts) AS last FROM ticks GROUP BY ALL), b AS (SELECT symbol, min(date) AS x, max(date) AS y FROM d GROUP BY symbol), s AS (SELECT symbol, CAST(unnest(generate_series(x, y, INTERVAL 1 DAY)) AS DATE) AS date FROM b) SELECT symbol, date, mean, last FROM s LEFT JOIN d USING (symbol, date)")
def agg05(spark, d):
    daily = ticks(spark, d).groupBy("symbol", "date").agg(F.round(F.avg("qty"), 6).alias("mean"), F.max_by("price", "ts").alias("last"))
    spine = daily.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("symbol", F.explode(F.sequence("a", "b")).alias("date"))
    return spine.join(daily, ["symbol", "date"], "left")


@add("AGG06_pivot_difference", "WITH l AS (SELECT lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin, source, metric, epoch_us(event_ts) AS e, arg_max(value, (epoch_us(as_of_ts), reading_id)) AS v FROM onchain WHERE metric IN ('FlowInExUSD', 'FlowOutExUSD') AND value IS NOT NULL AND NOT isnan(value) AND as_of_ts IS NOT NULL AND event_ts IS NOT NULL GROUP BY ALL), p AS (SELECT coin, source, e, coalesce(max(v) FILTER (metric = 'FlowInExUSD'), 0) - coalesce(max(v) FILTER (metric = 'FlowOutExUSD'), 0) AS net FROM l GROUP BY ALL) SELECT coin, source, count(*) AS n, round(sum(net) / 1e6, 2) AS net_musd FROM p GROUP BY ALL")
def agg06(spark, d):
    rows = table(spark, d, "onchain").filter("metric IN ('FlowInExUSD', 'FlowOutExUSD') AND NOT isnan(value)").dropna(subset=["value", "as_of_ts", "event_ts"]).withColumn("coin", clean_name("coin"))
    latest = rows.groupBy("coin", "source", "metric", "event_ts").agg(F.max_by("value", F.struct("as_of_ts", "reading_id")).alias("v"))
    wide = latest.groupBy("coin", "source", "event_ts").pivot("metric", ["FlowInExUSD", "FlowOutExUSD"]).agg(F.max("v"))
    net = F.coalesce("FlowInExUSD", F.lit(0.0)) - F.coalesce("FlowOutExUSD", F.lit(0.0))
    return wide.groupBy("coin", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(net) / 1e6, 2).alias("net_musd"))


@add("AGG07_edge", f"WITH {_TR} SELECT coin, count(pnl) AS n, round(avg(pnl), 6) AS mean, round(stddev_pop(pnl), 6) AS sd FROM t WHERE pnl IS NOT NULL GROUP BY coin HAVING count(pnl) >= 10")
def agg07(spark, d):
    rows = _trades(spark, d).filter("pnl IS NOT NULL").groupBy("coin").agg(F.count("pnl").alias("n"), F.round(F.avg("pnl"), 6).alias("mean"), F.round(F.stddev_pop("pnl"), 6).alias("sd"))
    return rows.filter("n >= 10")


@add("AGG08_latest_known", f"SELECT coin, arg_min(unlock_id, (epoch_us(unlock_date), unlock_id)) AS unlock_id FROM unlocks WHERE {E.format('as_of_ts')} <= {_T} AND {E.format('unlock_date')} > {_T} GROUP BY coin")
def agg08(spark, d):
    seen = table(spark, d, "unlocks").filter((F.col("as_of_ts") <= as_of()) & (F.col("unlock_date") > as_of()))
    return seen.groupBy("coin").agg(F.min_by("unlock_id", F.struct("unlock_date", "unlock_id")).alias("unlock_id"))


@add("AGG09_last_row", "SELECT coin, arg_max(id, (epoch_us(logged_ts), id)) AS id FROM sizing GROUP BY coin")
def agg09(spark, d):
    return keep_last(table(spark, d, "sizing"), ["coin"], [F.col("logged_ts"), F.col("id")]).select("coin", "id")


@add("AGG10_complete_pivot", f"WITH {_P} SELECT cycle_id, coin, max(v) FILTER (horizon = 7) AS h7, max(v) FILTER (horizon = 14) AS h14 FROM p GROUP BY ALL HAVING h7 IS NOT NULL AND h14 IS NOT NULL")
def agg10(spark, d):
    return jon05(spark, d).dropna(subset=["h7", "h14"])


@add("AGG11_ledger", f"WITH {_TR} SELECT coin, sum(CAST(CAST(pnl AS VARCHAR) AS DECIMAL(38,9))) AS pnl, sum(CAST(CAST(fees AS VARCHAR) AS DECIMAL(38,9))) AS fees, round(count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pnl <> 0), 0), 4) AS win_rate FROM t GROUP BY coin")
def agg11(spark, d):
    return _trades(spark, d).groupBy("coin").agg(F.sum(exact("pnl")).alias("pnl"), F.sum(exact("fees")).alias("fees"), F.round(F.try_divide(F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") != 0)), 4).alias("win_rate"))


@add("AGG12_slippage", f"WITH {_TR} SELECT round(avg(slippage), 9) AS mean, max(slippage) AS worst, count(slippage) AS n FROM t")
def agg12(spark, d):
    return _trades(spark, d).agg(F.round(F.avg("slippage"), 9).alias("mean"), F.max("slippage").alias("worst"), F.count("slippage").alias("n"))


@add("AGG13_weekly", f"WITH {_TR} SELECT CAST(date_trunc('week', {E.format('loaded_ts')}) AS DATE) AS week, count(*) AS n, count(exit_price) AS closed, round(avg((exit_price / entry_price - 1) * CASE side WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 END), 6) AS mean_ret FROM t WHERE loaded_ts IS NOT NULL AND entry_price > 0 GROUP BY 1")
def agg13(spark, d):
    sign = F.create_map(F.lit("BUY"), F.lit(1), F.lit("SELL"), F.lit(-1))
    rows = _trades(spark, d).filter("loaded_ts IS NOT NULL AND entry_price > 0")
    return rows.groupBy(F.date_trunc("week", "loaded_ts").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count("exit_price").alias("closed"), F.round(F.avg((F.col("exit_price") / F.col("entry_price") - 1) * F.try_element_at(sign, F.col("side"))), 6).alias("mean_ret"))


@add("AGG14_positional_pairs", f"WITH {_TR}, r AS (SELECT coin, side, id, entry_price AS p, row_number() OVER (PARTITION BY coin, side ORDER BY id, loaded_ts) AS k FROM t WHERE side IN ('BUY', 'SELL')) SELECT b.coin, count(*) AS pairs, count(*) FILTER (s.p > b.p) AS wins FROM r b JOIN r s ON b.coin = s.coin AND b.k = s.k WHERE b.side = 'BUY' AND s.side = 'SELL' GROUP BY b.coin")
def agg14(spark, d):
    w = Window.partitionBy("coin", "side").orderBy("id", "loaded_ts")
    ranked = _trades(spark, d).filter("side IN ('BUY', 'SELL')").select("coin", "side", F.col("entry_price").alias("p"), F.row_number().over(w).alias("k"))
    buy = ranked.filter("side = 'BUY'").select("coin", "k", F.col("p").alias("b"))
    sell = ranked.filter("side = 'SELL'").select("coin", "k", F.col("p").alias("s"))
    return buy.join(sell, ["coin", "k"]).groupBy("coin").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("s") > F.col("b")).alias("wins"))


@add("AGG15_top_groups", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 20")
def agg15(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(20)


@add("AGG16_with_total", f"WITH {_TR} SELECT coalesce(coin, '__all__') AS coin, count(*) AS n, sum(CAST(CAST(fees AS VARCHAR) AS DECIMAL(38,9))) AS fees FROM t GROUP BY ROLLUP (coin)")
def agg16(spark, d):
    return _trades(spark, d).rollup("coin").agg(F.count(F.lit(1)).alias("n"), F.sum(exact("fees")).alias("fees")).select(F.coalesce("coin", F.lit("__all__")).alias("coin"), "n", "fees")


@add("AGG17_correlation", f"WITH {BARS} SELECT round(corr(a.close, b.close), 6) AS corr, round(covar_samp(a.close, b.close), 2) AS cov FROM bars a JOIN bars b ON a.date = b.date WHERE a.symbol = 'N' AND b.symbol = 'R'")
def agg17(spark, d):
    b = bars(spark, d)
    wide = b.filter("symbol = 'N'").select("date", F.col("close").alias("x")).join(b.filter("symbol = 'R'").select("date", F.col("close").alias("y")), "date")
    return wide.agg(F.round(F.corr("x", "y"), 6).alias("corr"), F.round(F.covar_samp("x", "y"), 2).alias("cov"))


@add("AGG18_value_counts", "SELECT classification, count(*) AS n FROM fng GROUP BY 1")
def agg18(spark, d):
    return table(spark, d, "fng").groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@add("AGG19_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.025), 4) AS q025, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.975), 4) AS q975 FROM orders GROUP BY 1")
def agg19(spark, d):
    q = F.percentile("o_totalprice", [0.025, 0.5, 0.975])
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(q.alias("q")).select("o_orderstatus", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q025", "q50", "q975"))])


@add("AGG20_keep_last", "SELECT unlock_id, arg_max(amount_tokens, (epoch_us(as_of_ts), amount_tokens)) AS amount_tokens FROM unlocks WHERE as_of_ts IS NOT NULL GROUP BY 1")
def agg20(spark, d):
    return keep_last(table(spark, d, "unlocks").filter("as_of_ts IS NOT NULL"), ["unlock_id"], [F.col("as_of_ts"), F.col("amount_tokens")]).select("unlock_id", "amount_tokens")


@add("AGG21_first_seen_title", "SELECT headline, min(epoch_us(as_of_ts)) AS first_us FROM news WHERE headline IS NOT NULL GROUP BY 1 ORDER BY first_us DESC, headline LIMIT 30")
def agg21(spark, d):
    return table(spark, d, "news").filter("headline IS NOT NULL").groupBy("headline").agg(F.min(us("as_of_ts")).alias("first_us")).orderBy(F.desc("first_us"), "headline").limit(30)


@add("AGG22_grid_pivot", "SELECT l_returnflag, max(s) FILTER (l_linestatus = 'F') AS F, max(s) FILTER (l_linestatus = 'O') AS O FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s FROM lineitem GROUP BY ALL) GROUP BY 1")
def agg22(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@add("AGG23_cross_section", f"WITH {BARS}, l AS (SELECT symbol, arg_max(close, date) AS v FROM bars GROUP BY 1) SELECT symbol, round((v - avg(v) OVER ()) / nullif(stddev_samp(v) OVER (), 0), 6) AS z FROM l")
def agg23(spark, d):
    latest = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("v"))
    moments = latest.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return latest.join(F.broadcast(moments)).select("symbol", F.round(F.try_divide(F.col("v") - F.col("m"), F.nullif("sd", F.lit(0.0))), 6).alias("z"))  # one row


@add("AGG25_ensemble_mean", f"SELECT lower(trim(cycle_id)) AS cycle_id, coin, horizon, round(avg(pred_value), 6) AS pred FROM predictions WHERE trim(cycle_id) <> '' GROUP BY ALL")
def agg25(spark, d):
    return table(spark, d, "predictions").filter(F.trim("cycle_id") != "").groupBy(F.lower(F.trim("cycle_id")).alias("cycle_id"), "coin", "horizon").agg(F.round(F.avg("pred_value"), 6).alias("pred"))


# --- journal queries, sorts and sets


@add("ORD01_newest", "SELECT cycle_id, epoch_us(loaded_ts) AS us FROM (SELECT DISTINCT cycle_id, loaded_ts FROM cycles) WHERE loaded_ts IS NOT NULL ORDER BY us DESC, cycle_id LIMIT 200")
def ord01(spark, d):
    return table(spark, d, "cycles").filter("loaded_ts IS NOT NULL").select("cycle_id", us("loaded_ts").alias("us")).distinct().orderBy(F.desc("us"), "cycle_id").limit(200)


@add("ORD02_drill_down", "WITH c AS (SELECT DISTINCT lower(trim(cycle_id)) AS k FROM cycles) SELECT k, (SELECT count(*) FROM predictions p WHERE lower(trim(p.cycle_id)) = k) AS n_pred, (SELECT count(*) FROM sizing s WHERE lower(trim(s.cycle_id)) = k) AS n_size, (SELECT count(*) FROM trades t WHERE lower(trim(t.cycle_id)) = k) AS n_trade FROM c")
def ord02(spark, d):
    out = table(spark, d, "cycles").select(F.lower(F.trim("cycle_id")).alias("k")).distinct()
    for name, col in (("predictions", "n_pred"), ("sizing", "n_size"), ("trades", "n_trade")):
        n = table(spark, d, name).groupBy(F.lower(F.trim("cycle_id")).alias("k")).agg(F.count(F.lit(1)).alias(col))
        out = out.join(n, "k", "left").withColumn(col, F.coalesce(col, F.lit(0)))
    return out


@add("ORD03_ordered_scan", "SELECT DISTINCT id, coin, epoch_us(loaded_ts) AS us FROM trades ORDER BY id DESC, us DESC")
def ord03(spark, d):
    return table(spark, d, "trades").select("id", "coin", us("loaded_ts").alias("us")).distinct().orderBy(F.desc("id"), F.desc("us"))


@add("ORD04_stale", f"SELECT coin, max(epoch_us(as_of_ts)) AS last_us, (epoch_us({_T}) - max(epoch_us(as_of_ts))) / 3600000000 > 36 AS stale FROM unlocks WHERE {E.format('as_of_ts')} <= {_T} GROUP BY 1")
def ord04(spark, d):
    last = table(spark, d, "unlocks").filter(F.col("as_of_ts") <= as_of()).groupBy("coin").agg(F.max(us("as_of_ts")).alias("last_us"))
    return last.withColumn("stale", (F.unix_micros(as_of()) - F.col("last_us")) / 3_600_000_000 > 36)


@add("SET01_union", "SELECT coin FROM predictions UNION SELECT coin FROM sizing")
def set01(spark, d):
    return table(spark, d, "predictions").select("coin").union(table(spark, d, "sizing").select("coin")).distinct()


@add("SET02_intersect_except", "SELECT 'both' AS part, coin FROM (SELECT coin FROM predictions INTERSECT SELECT coin FROM unlocks) UNION ALL SELECT 'left', coin FROM (SELECT coin FROM predictions EXCEPT SELECT coin FROM unlocks)")
def set02(spark, d):
    a, b = table(spark, d, "predictions").select("coin"), table(spark, d, "unlocks").select("coin")
    return a.intersect(b).select(F.lit("both").alias("part"), "coin").union(a.subtract(b).select(F.lit("left").alias("part"), "coin"))


@add("SET03_union_all", "SELECT src, count(*) AS n FROM (SELECT 'p' AS src FROM predictions UNION ALL SELECT 's' FROM sizing) GROUP BY 1")
def set03(spark, d):
    both = table(spark, d, "predictions").select(F.lit("p").alias("src")).unionByName(table(spark, d, "sizing").select(F.lit("s").alias("src")))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


# --- engine baseline


@add("base_join_kinds", "SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'anti', count(*) FROM customer ANTI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'semi', count(*) FROM customer SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def base_joins(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    out = None
    for kind, how in (("inner", "inner"), ("anti", "left_anti"), ("semi", "left_semi"), ("full", "full")):
        n = c.join(o, F.col("c_custkey") == F.col("o_custkey"), how).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@add("base_grouping_sets", "SELECT coalesce(l_returnflag, '*') AS f, coalesce(l_linestatus, '*') AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def base_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("f"), F.coalesce("l_linestatus", F.lit("*")).alias("s"), "n")


@add("base_ranks", "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
def base_ranks(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    q = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(q).alias("q"))


@add("base_distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def base_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


@add("base_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def base_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(us("w.start").alias("start_us"), "event_type", "n")


@add("base_sessions", "WITH g AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, u, sum(f) OVER (PARTITION BY user_id ORDER BY u) AS k FROM g) SELECT user_id, min(u) AS start_us, count(*) AS n FROM s GROUP BY user_id, k")
def base_sessions(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", us("w.start").alias("start_us"), "n")


@add("base_top_customers", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def base_star(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
