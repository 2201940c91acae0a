"""Queries of the windows, statistics, ticks and text operators (WIN, MET, TIC, SCL)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.folds import expanding_quantile, exponential_mean, smooth_labels
from ..functions.stats import annualised, block_bootstrap, central_moment, profit_factor, purged_splits, sharpe, sharpe_variance, total_return, win_rate
from ..functions.windows import Series, compounded, drawdown, forward_fill, log_change, pct_change, persisted, rolling_mean, rolling_std, rolling_sum, zscore
from ..operators.shards import clean_name
from ..operators.ticks import fast_buckets, order_imbalance, volume_buckets
from ..sources.stores import keep_last
from .registry import Registry
from .views import BARS, RETURNS, TICKS, bars, returns, table, ticks

R = Registry()
add = R.add
S = Series(("symbol",), ("date",))
W = "w AS (PARTITION BY symbol ORDER BY date)"


def frame(n: int, name: str | None = None) -> str:
    return f"{name or 'w' + str(n)} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def mean(x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {least or n} THEN avg({x}) OVER w{n} END"


def std(x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {max(2, least or n)} THEN stddev_samp({x}) OVER w{n} END"


def r(c, n=6):
    return F.round(c, n)


#: Added before rounding on both sides where many values are exact halves, whose sums differ in their last bits.
OFF = 1.23e-8


@add("WIN01_latest_snapshot", "WITH v AS (SELECT lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin, metric, source, reading_id, value, row_number() OVER (PARTITION BY lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')), metric, source ORDER BY epoch_us(event_ts) DESC, epoch_us(as_of_ts) DESC, reading_id DESC) AS rn FROM onchain WHERE epoch_us(as_of_ts) <= 1719705600000000 AND event_ts IS NOT NULL) SELECT coin, metric, source, reading_id, value FROM v WHERE rn = 1")
def win01(spark, d):
    seen = table(spark, d, "onchain").filter((F.unix_micros("as_of_ts") <= 1719705600000000) & F.col("event_ts").isNotNull()).withColumn("coin", clean_name("coin"))
    return keep_last(seen, ["coin", "metric", "source"], [F.col("event_ts"), F.col("as_of_ts"), F.col("reading_id")]).select("coin", "metric", "source", "reading_id", "value")


@add("WIN02_lags_leads", f"WITH {BARS} SELECT symbol, date, lag(close, 1) OVER w AS l1, lag(close, 7) OVER w AS l7, lead(close, 7) OVER w AS h7, lead(close, 14) OVER w AS h14 FROM bars WINDOW {W}")
def win02(spark, d):
    return bars(spark, d).select("symbol", "date", F.lag("close", 1).over(S.w).alias("l1"), F.lag("close", 7).over(S.w).alias("l7"), F.lead("close", 7).over(S.w).alias("h7"), F.lead("close", 14).over(S.w).alias("h14"))


@add("WIN03_shifted_rows", f"WITH {BARS}, s AS (SELECT symbol, date, lag(close) OVER w AS close, lag(volume) OVER w AS volume, lead(close, 6) OVER w AS target, row_number() OVER w AS i FROM bars WINDOW {W}) SELECT symbol, date, coalesce(close, 0) AS close, coalesce(volume, 0) AS volume, target FROM s WHERE i > 1")
def win03(spark, d):
    s = bars(spark, d).select("symbol", "date", F.lag("close").over(S.w).alias("close"), F.lag("volume").over(S.w).alias("volume"), F.lead("close", 6).over(S.w).alias("target"), F.row_number().over(S.w).alias("i")).filter("i > 1")
    return s.select("symbol", "date", *[F.coalesce(forward_fill(c, S), F.lit(0.0)).alias(c) for c in ("close", "volume")], "target")


@add("WIN04_changes", f"WITH {BARS} SELECT symbol, date, round(close / lag(close, 1) OVER w - 1, 6) AS c1, round(close / lag(close, 7) OVER w - 1, 6) AS c7, round(close / lag(close, 30) OVER w - 1, 6) AS c30 FROM bars WINDOW {W}")
def win04(spark, d):
    return bars(spark, d).select("symbol", "date", *[r(pct_change("close", S, n)).alias(f"c{n}") for n in (1, 7, 30)])


@add("WIN05_log_changes", f"WITH {BARS} SELECT symbol, date, round(ln(close) - lag(ln(close), 1) OVER w, 6) AS d1, round(ln(close) - lag(ln(close), 7) OVER w, 6) AS d7 FROM bars WINDOW {W}")
def win05(spark, d):
    return bars(spark, d).select("symbol", "date", *[r(log_change("close", S, n)).alias(f"d{n}") for n in (1, 7)])


@add("WIN06_rolling", f"WITH {BARS} SELECT symbol, date, round({mean('close', 7)} + {OFF}, 4) AS m7, round({std('close', 7)}, 4) AS s7, round({mean('close', 30)} + {OFF}, 4) AS m30, round({mean('volume', 30)} + {OFF}, 4) AS v30 FROM bars WINDOW {frame(7)}, {frame(30)}")
def win06(spark, d):
    return bars(spark, d).select("symbol", "date", r(rolling_mean("close", S, 7) + OFF, 4).alias("m7"), r(rolling_std("close", S, 7), 4).alias("s7"), r(rolling_mean("close", S, 30) + OFF, 4).alias("m30"), r(rolling_mean("volume", S, 30) + OFF, 4).alias("v30"))


@add("WIN07_zscore", f"WITH {BARS} SELECT symbol, date, round((close - {mean('close', 365, 60)}) / nullif({std('close', 365, 60)}, 0), 6) AS z365, round((close - {mean('close', 30, 5)}) / nullif({std('close', 30, 5)}, 0), 6) AS z30 FROM bars WINDOW {frame(365)}, {frame(30)}")
def win07(spark, d):
    return bars(spark, d).select("symbol", "date", r(zscore("close", S, 365, 60)).alias("z365"), r(zscore("close", S, 30, 5)).alias("z30"))


@add("WIN08_z_and_slope", f"WITH {BARS} SELECT symbol, date, round((volume - {mean('volume', 30)}) / nullif({std('volume', 30)}, 0), 6) AS z, round(volume - {mean('volume', 7)}, 4) AS slope FROM bars WINDOW {frame(30)}, {frame(7)}")
def win08(spark, d):
    return bars(spark, d).select("symbol", "date", r(zscore("volume", S, 30)).alias("z"), r(F.col("volume") - rolling_mean("volume", S, 7), 4).alias("slope"))


@add("WIN09_ratio_of_sums", f"WITH {BARS}, s AS (SELECT *, sign(close - open) * volume AS sv FROM bars) SELECT symbol, date, round(CASE WHEN count(sv) OVER w7 >= 7 THEN sum(sv) OVER w7 END / nullif(CASE WHEN count(volume) OVER w7 >= 7 THEN sum(volume) OVER w7 END, 0), 6) AS ofi FROM s WINDOW {frame(7)}")
def win09(spark, d):
    signed = bars(spark, d).withColumn("sv", F.signum(F.col("close") - F.col("open")) * F.col("volume"))
    return signed.select("symbol", "date", r(F.try_divide(rolling_sum("sv", S, 7), F.nullif(rolling_sum("volume", S, 7), F.lit(0.0)))).alias("ofi"))


@add("WIN10_multiple_of_mean", f"WITH {BARS} SELECT symbol, date, round(volume / nullif({mean('volume', 365, 60)}, 0), 6) AS m FROM bars WINDOW {frame(365)}")
def win10(spark, d):
    return bars(spark, d).select("symbol", "date", r(F.try_divide(F.col("volume"), F.nullif(rolling_mean("volume", S, 365, 60), F.lit(0.0)))).alias("m"))


@add("WIN11_below_peak", f"WITH {BARS} SELECT symbol, date, round(close / max(close) OVER w365 - 1, 6) AS below FROM bars WINDOW {frame(365)}")
def win11(spark, d):
    return bars(spark, d).select("symbol", "date", r(F.col("close") / F.max("close").over(S.last(365)) - 1).alias("below"))


@add("WIN12_forward_label", f"WITH {RETURNS} SELECT symbol, date, CASE WHEN count(ret) OVER f = 7 THEN sum(ln(1 + ret)) OVER f > 0 END AS up FROM returns WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)")
def win12(spark, d):
    f = S.w.rowsBetween(1, 7)
    return returns(spark, d).select("symbol", "date", F.when(F.count("ret").over(f) == 7, F.sum(F.log1p("ret")).over(f) > 0).alias("up"))


@add("WIN13_realised_vol", f"WITH {BARS}, l AS (SELECT symbol, date, ln(close) - lag(ln(close)) OVER w AS g, row_number() OVER w AS i FROM bars WINDOW {W}) SELECT symbol, date, round(CASE WHEN i > 30 THEN stddev_samp(g) OVER w30 END * sqrt(252), 6) AS vol FROM l WINDOW {frame(30)}")
def win13(spark, d):
    g = bars(spark, d).select("symbol", "date", log_change("close", S).alias("g"))
    return g.select("symbol", "date", r(rolling_std("g", S, 30) * math.sqrt(252)).alias("vol"))


@add("WIN14_expanding_quantile", f"WITH {BARS} SELECT symbol, date, round(CASE WHEN count(close) OVER b >= 20 THEN quantile_cont(close, 0.8) OVER b END, 6) AS q FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win14(spark, d):
    return expanding_quantile(bars(spark, d), ["symbol"], "date", "close", 0.8, 20, "q").select("symbol", "date", r("q").alias("q"))


@add("WIN15_drawdown", f"WITH {BARS} SELECT symbol, date, round((close - max(close) OVER w) / max(close) OVER w, 6) AS dd FROM bars WINDOW {W}")
def win15(spark, d):
    return bars(spark, d).select("symbol", "date", r(drawdown("close", S)).alias("dd"))


@add("WIN16_compounded", f"WITH {RETURNS} SELECT symbol, date, round(ln(product(1 + ret) OVER w), 6) AS nav FROM returns WINDOW {W}")
def win16(spark, d):
    return returns(spark, d).select("symbol", "date", r(F.ln(compounded("ret", S))).alias("nav"))


@add("WIN17_rolling_sharpe", f"WITH {RETURNS} SELECT symbol, date, round({mean('ret', 30)} / nullif({std('ret', 30)}, 0) * sqrt(365), 4) AS sharpe FROM returns WINDOW {frame(30)}")
def win17(spark, d):
    return returns(spark, d).select("symbol", "date", r(F.try_divide(rolling_mean("ret", S, 30), F.nullif(rolling_std("ret", S, 30), F.lit(0.0))) * math.sqrt(365), 4).alias("sharpe"))


@add("WIN19_causal", f"WITH {BARS} SELECT symbol, date, coalesce(lag(close) OVER w, close) AS p FROM bars WINDOW {W}")
def win19(spark, d):
    return bars(spark, d).select("symbol", "date", F.coalesce(F.lag("close").over(S.w), F.col("close")).alias("p"))


@add("WIN20_level_features", f"WITH {BARS}, l AS (SELECT symbol, date, ln(close) - lag(ln(close)) OVER w AS g FROM bars WINDOW {W}), f AS (SELECT symbol, date, round({mean('g', 20)}, 6) AS m, round({std('g', 30)} * sqrt(252), 6) AS v, round({mean('abs(g)', 20)}, 6) AS a FROM l WINDOW {frame(20)}, {frame(30)}) SELECT * FROM f WHERE m IS NOT NULL AND v IS NOT NULL AND a IS NOT NULL")
def win20(spark, d):
    g = bars(spark, d).select("symbol", "date", log_change("close", S).alias("g")).withColumn("ag", F.abs("g"))
    return g.select("symbol", "date", r(rolling_mean("g", S, 20)).alias("m"), r(rolling_std("g", S, 30) * math.sqrt(252)).alias("v"), r(rolling_mean("ag", S, 20)).alias("a")).dropna(subset=["m", "v", "a"])


@add("WIN21_change_point", f"WITH {RETURNS} SELECT symbol, date, coalesce(abs(ret - avg(ret) OVER b) / nullif(stddev_samp(ret) OVER b, 0) > 2.5, false) AS jump FROM returns WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def win21(spark, d):
    b = S.w.rowsBetween(-20, -1)
    z = F.try_divide(F.abs(F.col("ret") - F.avg("ret").over(b)), F.nullif(F.stddev_samp("ret").over(b), F.lit(0.0)))
    return returns(spark, d).select("symbol", "date", F.coalesce(z > 2.5, F.lit(False)).alias("jump"))


_LABELS = f"""{BARS}, g AS (SELECT symbol, date, CASE WHEN close > lag(close) OVER w THEN 'up' ELSE 'down' END AS x, row_number() OVER w AS i FROM bars WINDOW {W})"""


@add("WIN22_smooth_labels", f"""WITH RECURSIVE {_LABELS}, f AS (SELECT symbol, i, date, x AS now, CAST(NULL AS VARCHAR) AS nxt, 0 AS n FROM g WHERE i = 1
UNION ALL SELECT g.symbol, g.i, g.date,
  CASE WHEN g.x <> f.now AND (CASE WHEN g.x = f.nxt THEN f.n + 1 ELSE 1 END) >= 3 THEN g.x ELSE f.now END,
  CASE WHEN g.x = f.now OR (CASE WHEN g.x = f.nxt THEN f.n + 1 ELSE 1 END) >= 3 THEN NULL ELSE g.x END,
  CASE WHEN g.x = f.now OR (CASE WHEN g.x = f.nxt THEN f.n + 1 ELSE 1 END) >= 3 THEN 0 WHEN g.x = f.nxt THEN f.n + 1 ELSE 1 END
  FROM f JOIN g ON g.symbol = f.symbol AND g.i = f.i + 1) SELECT symbol, date, now AS label FROM f""")
def win22(spark, d):
    g = bars(spark, d).select("symbol", "date", F.when(F.col("close") > F.lag("close").over(S.w), "up").otherwise("down").alias("x"))
    return smooth_labels(g, ["symbol"], "date", "x", 3, "label").select("symbol", "date", "label")


@add("WIN23_ema", f"""WITH RECURSIVE {BARS}, g AS (SELECT symbol, date, close, row_number() OVER w AS i FROM bars WINDOW {W}), f AS (SELECT symbol, i, date, close AS e FROM g WHERE i = 1
UNION ALL SELECT g.symbol, g.i, g.date, f.e + 2.0 / 13 * (g.close - f.e) FROM f JOIN g ON g.symbol = f.symbol AND g.i = f.i + 1) SELECT symbol, date, round(e, 4) AS ema12 FROM f""")
def win23(spark, d):
    return exponential_mean(bars(spark, d).select("symbol", "date", "close"), ["symbol"], "date", "close", 2 / 13, "e").select("symbol", "date", r("e", 4).alias("ema12"))


@add("WIN23_bands", f"WITH {BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars) SELECT symbol, date, round({mean('close', 20)} + {OFF}, 4) AS mid, round({mean('close', 20)} + 2 * {std('close', 20)}, 4) AS upper, round(CASE WHEN count(high) OVER w14 >= 14 THEN (max(high) OVER w14 - close) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) * -100 END, 4) AS wr14, round(CASE WHEN count(tp) OVER w14 >= 14 THEN sum(tp * volume) OVER w14 / nullif(sum(volume) OVER w14, 0) END, 4) AS vwma14 FROM t WINDOW {frame(20)}, {frame(14)}")
def win23b(spark, d):
    t = bars(spark, d).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("tv", F.col("tp") * F.col("volume"))
    f = S.last(14)
    hi, lo, full = F.max("high").over(f), F.min("low").over(f), F.count("high").over(f) >= 14
    return t.select(
        "symbol", "date", r(rolling_mean("close", S, 20) + OFF, 4).alias("mid"), r(rolling_mean("close", S, 20) + 2 * rolling_std("close", S, 20), 4).alias("upper"),
        r(F.when(full, F.try_divide(hi - F.col("close"), F.nullif(hi - lo, F.lit(0.0))) * -100), 4).alias("wr14"), r(F.try_divide(rolling_sum("tv", S, 14), F.nullif(rolling_sum("volume", S, 14), F.lit(0.0))), 4).alias("vwma14"),
    )


@add("WIN24_simple_rsi", f"WITH {BARS}, c AS (SELECT symbol, date, close - lag(close) OVER w AS x FROM bars WINDOW {W}), s AS (SELECT symbol, date, CASE WHEN count(x) OVER w14 >= 14 THEN sum(greatest(x, 0)) OVER w14 END AS g, CASE WHEN count(x) OVER w14 >= 14 THEN sum(greatest(-x, 0)) OVER w14 END AS l FROM c WINDOW {frame(14)}) SELECT symbol, date, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM s")
def win24(spark, d):
    c = bars(spark, d).select("symbol", "date", (F.col("close") - F.lag("close").over(S.w)).alias("x"))
    c = c.withColumn("up", F.when(F.col("x").isNotNull(), F.greatest("x", F.lit(0.0)))).withColumn("dn", F.when(F.col("x").isNotNull(), F.greatest(-F.col("x"), F.lit(0.0))))
    s = c.select("symbol", "date", rolling_sum("up", S, 14).alias("g"), rolling_sum("dn", S, 14).alias("l"))
    return s.select("symbol", "date", r(F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("g", "l"))), 4).alias("rsi"))


@add("WIN25_calendar_lookup", f"WITH {BARS}, b AS (SELECT symbol, max(date) AS m FROM bars GROUP BY 1), s AS (SELECT symbol, CAST(unnest(generate_series(m - INTERVAL 30 DAY, m, INTERVAL 1 DAY)) AS DATE) AS date FROM b) SELECT symbol, date, coalesce(CAST(CAST(volume AS BIGINT) AS VARCHAR), 'N/A') AS v FROM s LEFT JOIN bars USING (symbol, date)")
def win25(spark, d):
    b = bars(spark, d)
    spine = b.groupBy("symbol").agg(F.max("date").alias("m")).select("symbol", F.explode(F.sequence(F.date_sub("m", 30), "m")).alias("date"))
    return spine.join(b, ["symbol", "date"], "left").select("symbol", "date", F.coalesce(F.col("volume").cast("long").cast("string"), F.lit("N/A")).alias("v"))


@add("WIN26_calendar", f"WITH {BARS} SELECT symbol, date, day(date) AS d, month(date) AS m, year(date) AS y, CAST(day(date) = 1 AS INTEGER) AS day_1, CAST(day(date) = 31 AS INTEGER) AS day_31 FROM bars")
def win26(spark, d):
    day = F.dayofmonth("date")
    return bars(spark, d).select("symbol", "date", day.alias("d"), F.month("date").alias("m"), F.year("date").alias("y"), (day == 1).cast("int").alias("day_1"), (day == 31).cast("int").alias("day_31"))


@add("WIN27_mean_min_periods", f"WITH {BARS} SELECT symbol, date, round({mean('volume', 7, 3)}, 4) AS m FROM bars WINDOW {frame(7)}")
def win27(spark, d):
    return bars(spark, d).select("symbol", "date", r(rolling_mean("volume", S, 7, 3), 4).alias("m"))


@add("WIN28_mean_zero_filled", f"WITH {BARS} SELECT symbol, date, round(coalesce({mean('volume', 7)}, 0), 4) AS m FROM bars WINDOW {frame(7)}")
def win28(spark, d):
    return bars(spark, d).select("symbol", "date", r(F.coalesce(rolling_mean("volume", S, 7), F.lit(0.0)), 4).alias("m"))


@add("STR20_persistence", f"WITH {_LABELS} SELECT symbol, date, CASE WHEN count(x) OVER w3 = 3 AND min(x) OVER w3 = max(x) OVER w3 THEN x END AS x FROM g WINDOW {frame(3)}")
def str20(spark, d):
    g = bars(spark, d).select("symbol", "date", F.when(F.col("close") > F.lag("close").over(S.w), "up").otherwise("down").alias("x"))
    return g.select("symbol", "date", persisted("x", S, 3).alias("x"))


# --- statistics


@add("MET01_series_metrics", f"WITH {RETURNS} SELECT symbol, round((avg(ret) - (pow(1.045, 1.0 / 252) - 1)) / stddev_samp(ret) * sqrt(252), 4) AS sharpe, round(count(*) FILTER (ret > 0) / count(*) FILTER (ret <> 0), 6) AS win_rate, round(sum(greatest(ret, 0)) / -sum(least(ret, 0)), 6) AS profit_factor, round(ln(product(1 + ret)), 6) AS log_total FROM returns GROUP BY 1")
def met01(spark, d):
    x = F.col("ret")
    return returns(spark, d).groupBy("symbol").agg(r(sharpe(x, 252, 0.045), 4).alias("sharpe"), r(win_rate(x)).alias("win_rate"), r(profit_factor(x)).alias("profit_factor"), r(F.ln(1 + total_return(x))).alias("log_total"))


@add("MET03_365_day_metrics", f"WITH {RETURNS} SELECT symbol, round(avg(ret) / stddev_samp(ret) * sqrt(365), 4) AS sharpe, round(pow(product(1 + ret), 365.0 / count(*)) - 1, 4) AS annual FROM returns GROUP BY 1")
def met03(spark, d):
    x = F.col("ret")
    return returns(spark, d).groupBy("symbol").agg(r(sharpe(x, 365), 4).alias("sharpe"), r(annualised(x, 365), 4).alias("annual"))


@add("MET04_worst_drawdown", f"WITH {RETURNS}, n AS (SELECT symbol, date, product(1 + ret) OVER w AS v FROM returns WINDOW {W}), k AS (SELECT symbol, v / max(v) OVER w - 1 AS dd FROM n WINDOW {W}) SELECT symbol, round(min(dd), 6) AS worst FROM k GROUP BY 1")
def met04(spark, d):
    n = returns(spark, d).select("symbol", "date", compounded("ret", S).alias("v"))
    return n.select("symbol", drawdown("v", S).alias("dd")).groupBy("symbol").agg(r(F.min("dd")).alias("worst"))


@add("MET05_population_sharpe", f"WITH {RETURNS} SELECT symbol, round(avg(ret) / stddev_pop(ret) * sqrt(252), 4) AS sharpe FROM returns GROUP BY 1")
def met05(spark, d):
    return returns(spark, d).groupBy("symbol").agg(r(sharpe(F.col("ret"), 252, population=True), 4).alias("sharpe"))


@add("MET07_daily_from_journal", "WITH c AS (SELECT DISTINCT left(cycle_id, 10) AS day, n_trades, loaded_ts FROM cycles WHERE regexp_matches(cycle_id, '^\\d{4}-\\d{2}-\\d{2}')) SELECT day, arg_max(n_trades, (epoch_us(loaded_ts), n_trades)) AS last FROM c WHERE n_trades IS NOT NULL AND loaded_ts IS NOT NULL GROUP BY 1")
def met07(spark, d):
    c = table(spark, d, "cycles").filter(F.col("cycle_id").rlike(r"^\d{4}-\d{2}-\d{2}") & F.col("n_trades").isNotNull() & F.col("loaded_ts").isNotNull())
    return c.groupBy(F.substring("cycle_id", 1, 10).alias("day")).agg(F.max_by("n_trades", F.struct("loaded_ts", "n_trades")).alias("last"))


_ERR = "e AS (SELECT horizon, pred_value AS p, ref_price AS y FROM predictions WHERE pred_value IS NOT NULL AND ref_price IS NOT NULL AND ref_price <> 0)"


@add("MET11_regression", f"WITH {_ERR}, m AS (SELECT *, avg(y) OVER (PARTITION BY horizon) AS my FROM e) SELECT horizon, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(abs((p - y) / y)), 6) AS mape, round(1 - sum((p - y) * (p - y)) / sum((y - my) * (y - my)), 6) AS r2 FROM m GROUP BY 1")
def met11(spark, d):
    e = table(spark, d, "predictions").select("horizon", F.col("pred_value").alias("p"), F.col("ref_price").alias("y")).filter("p IS NOT NULL AND y IS NOT NULL AND y <> 0")
    g = e.groupBy("horizon").agg(F.avg("y").alias("my"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("mse"), F.avg(F.abs((F.col("p") - F.col("y")) / F.col("y"))).alias("mape"), F.var_pop("y").alias("vy"))
    return g.select("horizon", r("mae", 4).alias("mae"), r(F.sqrt("mse"), 3).alias("rmse"), r("mape").alias("mape"), r(1 - F.col("mse") / F.col("vy")).alias("r2"))


@add("MET12_direction", f"WITH {BARS}, l AS (SELECT symbol, CASE WHEN close > p1 THEN 1 ELSE -1 END AS a, CASE WHEN open > p1 THEN 1 ELSE -1 END AS b FROM (SELECT symbol, close, open, lag(close) OVER w AS p1 FROM bars WINDOW {W}) WHERE p1 > 0) SELECT symbol, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS hit FROM l GROUP BY 1")
def met12(spark, d):
    way = lambda c: F.when(F.col(c) > F.col("p1"), 1).otherwise(-1)
    rows = bars(spark, d).select("symbol", "open", "close", F.lag("close").over(S.w).alias("p1")).filter("p1 > 0")
    return rows.groupBy("symbol").agg(r(F.avg((way("close") == way("open")).cast("double"))).alias("hit"))


@add("MET13_weighted_mean", f"WITH {RETURNS} SELECT date, round(sum(ret * w) / sum(w), 9) AS ret FROM returns JOIN (VALUES ('A', 0.5), ('N', 0.3), ('R', 0.2)) v(symbol, w) USING (symbol) GROUP BY 1")
def met13(spark, d):
    w = spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "symbol string, w double")
    return returns(spark, d).join(F.broadcast(w), "symbol").groupBy("date").agg(r(F.sum(F.col("ret") * F.col("w")) / F.sum("w"), 9).alias("ret"))  # three rows


@add("MET14_sharpe_variance", f"WITH {RETURNS}, m AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM returns), k AS (SELECT symbol, any_value(mu) / any_value(sd) AS sr, avg(pow(ret - mu, 3)) / pow(any_value(sd), 3) AS s, avg(pow(ret - mu, 4)) / pow(any_value(sd), 4) AS k, count(*) AS n FROM m GROUP BY 1) SELECT symbol, round((1 - s * sr + (k - 1) / 4 * sr * sr) / (n - 1) * 1e6, 3) AS v FROM k")
def met14(spark, d):
    g = Window.partitionBy("symbol")
    m = returns(spark, d).withColumn("mu", F.avg("ret").over(g)).withColumn("sd", F.stddev_samp("ret").over(g))
    x, mu, sd = F.col("ret"), F.col("mu"), F.max("sd")
    k = m.groupBy("symbol").agg((F.max("mu") / sd).alias("sr"), (central_moment(x, mu, 3) / F.pow(sd, F.lit(3.0))).alias("s"), (central_moment(x, mu, 4) / F.pow(sd, F.lit(4.0))).alias("k"), F.count(F.lit(1)).alias("n"))
    return k.select("symbol", r(sharpe_variance(F.col("sr"), F.col("s"), F.col("k"), F.col("n")) * 1e6, 3).alias("v"))


@add("MET17_bootstrap")
def met17(spark, d):
    draws = block_bootstrap(returns(spark, d), ["symbol"], "date", "ret", 200, 10, 7)
    return draws.groupBy("symbol").agg(F.count("sharpe").alias("n"), F.percentile("sharpe", [0.025, 0.5, 0.975]).alias("q"))


@add("MET20_purged_splits", f"""WITH {RETURNS}, c AS (SELECT CAST(count(DISTINCT date) AS INTEGER) AS n FROM returns), g AS (SELECT CAST(i AS INTEGER) AS g, CAST(i * (n // 8) AS INTEGER) AS lo, CAST(CASE WHEN i = 7 THEN n ELSE (i + 1) * (n // 8) END AS INTEGER) AS hi, n FROM c, range(8) x(i)),
s AS (SELECT CAST(row_number() OVER (ORDER BY x.g, y.g) - 1 AS INTEGER) AS split, x.lo AS l1, x.hi AS h1, y.lo AS l2, y.hi AS h2, x.n FROM g x, g y WHERE x.g < y.g),
k AS (SELECT split, CAST(row AS INTEGER) AS row, n, row >= l1 AND row < h1 OR row >= l2 AND row < h2 AS t, row >= l1 - 5 AND row < h1 + 5 OR row >= l2 - 5 AND row < h2 + 5 AS e FROM s, range((SELECT n FROM c)) r(row)),
f AS (SELECT *, count(*) FILTER (NOT t AND NOT e) OVER (PARTITION BY split) AS train FROM k)
SELECT split, row, CASE WHEN t THEN 'test' WHEN e THEN 'embargo' ELSE 'train' END AS role FROM f WHERE train >= n * 3 // 4 - 15""")
def met20(spark, d):
    """Rows are the days with a return; splits that train on less than three quarters of them less 15 are left out."""
    n = returns(spark, d).select("date").distinct().count()
    return purged_splits(spark, n, 8, 2, 5, max(0, n * 3 // 4 - 15))


@add("MET21_quarter_blocks", f"WITH {RETURNS}, i AS (SELECT symbol, date, ret, (row_number() OVER w - 1) // 63 AS q FROM returns WINDOW {W}) SELECT symbol, q, count(*) AS n, round(sum(ret), 6) AS total FROM i GROUP BY ALL HAVING count(*) >= 31")
def met21(spark, d):
    i = returns(spark, d).withColumn("q", F.floor((F.row_number().over(S.w) - 1) / 63))
    return i.groupBy("symbol", "q").agg(F.count(F.lit(1)).alias("n"), r(F.sum("ret")).alias("total")).filter("n >= 31")


@add("MET22_quarter_summary", f"WITH {RETURNS}, i AS (SELECT symbol, ret, (row_number() OVER w - 1) // 63 AS q FROM returns WINDOW {W}), b AS (SELECT symbol, q, sum(ret) AS t FROM i GROUP BY ALL HAVING count(*) >= 31) SELECT symbol, count(*) AS n, round(quantile_cont(t, 0.25), 6) AS q1, round(quantile_cont(t, 0.75), 6) AS q3, round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM b GROUP BY 1")
def met22(spark, d):
    b = returns(spark, d).withColumn("q", F.floor((F.row_number().over(S.w) - 1) / 63)).groupBy("symbol", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("t")).filter("n >= 31")
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.percentile("t", F.lit(0.25))).alias("q1"), r(F.percentile("t", F.lit(0.75))).alias("q3"), r(F.avg((F.col("t") > 0).cast("double"))).alias("positive"))


@add("MET23_minimum_variance", f"WITH {RETURNS}, x AS (SELECT a.ret AS u, b.ret AS v FROM returns a JOIN returns b USING (date) WHERE a.symbol = 'A' AND b.symbol = 'N') SELECT round((var_samp(v) - covar_samp(u, v)) / (var_samp(u) + var_samp(v) - 2 * covar_samp(u, v)), 6) AS weight FROM x")
def met23(spark, d):
    q = returns(spark, d)
    x = q.filter("symbol = 'A'").select("date", F.col("ret").alias("u")).join(q.filter("symbol = 'N'").select("date", F.col("ret").alias("v")), "date")
    c = F.covar_samp("u", "v")
    return x.agg(r(F.try_divide(F.var_samp("v") - c, F.var_samp("u") + F.var_samp("v") - 2 * c)).alias("weight"))


@add("MET24_hurst", f"WITH {BARS}, l AS (SELECT symbol, k, ln(close) - lag(ln(close), CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k ORDER BY date) AS x FROM bars, range(2, 50) g(k)), s AS (SELECT symbol, k, stddev_pop(x) AS t FROM l GROUP BY ALL) SELECT symbol, round(regr_slope(ln(t), ln(k)), 6) AS h FROM s WHERE t > 0 GROUP BY 1".replace("lag(ln(close), CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k ORDER BY date)", "first_value(ln(close)) OVER (PARTITION BY symbol, k ORDER BY i RANGE BETWEEN k PRECEDING AND k PRECEDING)").replace("FROM bars, range(2, 50) g(k))", "FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars) b, range(2, 50) g(k))"))
def met24(spark, d):
    b = bars(spark, d).withColumn("g", F.ln("close"))
    lags = b.select("symbol", *[(F.col("g") - F.lag("g", k).over(S.w)).alias(f"x{k}") for k in range(2, 50)])
    lags = lags.select("symbol", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x")) for k in range(2, 50)])))
    t = lags.groupBy("symbol", "k").agg(F.stddev_pop("x").alias("t")).filter("t > 0")
    return t.groupBy("symbol").agg(r(F.regr_slope(F.ln("t"), F.ln("k"))).alias("h"))


# --- ticks

_SIZE = 500.0
_BUCKETS = f"""{TICKS}, c AS (SELECT symbol, date, price, qty, sell, sum(qty) OVER (PARTITION BY symbol, date ORDER BY ts) AS b FROM ticks), k AS (SELECT *, b - qty AS a FROM c WHERE qty > 0),
x AS (SELECT symbol, date, price, sell, a, b, unnest(generate_series(CAST(floor(a / {_SIZE}) AS BIGINT), greatest(CAST(floor(a / {_SIZE}) AS BIGINT), CAST(ceil(b / {_SIZE}) AS BIGINT) - 1))) AS bucket FROM k),
o AS (SELECT *, greatest(0.0, least(b, (bucket + 1) * {_SIZE}) - greatest(a, bucket * {_SIZE})) AS v FROM x),
g AS (SELECT symbol, date, bucket, sum(v) AS volume, sum(CASE WHEN sell THEN 0 ELSE v END) AS buy, sum(CASE WHEN sell THEN v ELSE 0 END) AS sell, sum(v * price) AS notional FROM o GROUP BY ALL HAVING sum(v) >= {_SIZE} / 2)"""


def _buckets(spark, d):
    return volume_buckets(ticks(spark, d), ["symbol", "date"], "ts", "price", "qty", "sell", _SIZE)


@add("TIC01_volume_buckets", f"WITH {_BUCKETS} SELECT symbol, date, bucket, round(volume, 4) AS volume, round(buy, 4) AS buy, round(sell, 4) AS sell, round(notional, 2) AS notional FROM g")
def tic01(spark, d):
    return _buckets(spark, d).select("symbol", "date", "bucket", r("volume", 4).alias("volume"), r("buy", 4).alias("buy"), r("sell", 4).alias("sell"), r("notional", 2).alias("notional"))


@add("TIC02_imbalance", f"WITH {_BUCKETS} SELECT symbol, date, count(*) AS n_buckets, round(avg(abs(buy - sell)) / {_SIZE} + {OFF}, 6) AS vpin FROM g GROUP BY ALL")
def tic02(spark, d):
    return order_imbalance(_buckets(spark, d), ["symbol", "date"], _SIZE).select("symbol", "date", "n_buckets", r(F.col("vpin") + OFF).alias("vpin"))


@add("TIC03_fast_imbalance", f"WITH {TICKS}, c AS (SELECT symbol, date, CASE WHEN sell THEN -qty ELSE qty END AS q, sum(qty) OVER (PARTITION BY symbol, date ORDER BY ts) AS b, sum(qty) OVER (PARTITION BY symbol, date) / 20 AS z FROM ticks), g AS (SELECT symbol, date, z, floor(round(b / z, 9)) AS k, abs(sum(q)) AS x FROM c WHERE z > 0 GROUP BY ALL) SELECT symbol, date, round(sum(x) / (max(k) + 1) / max(z), 6) AS vpin FROM g GROUP BY symbol, date")
def tic03(spark, d):
    return fast_buckets(ticks(spark, d), ["symbol", "date"], "ts", "qty", "sell", 20).select("symbol", "date", r("vpin").alias("vpin"))


@add("TIC04_daily_flow", f"WITH {TICKS} SELECT symbol, date, round(sum(CASE WHEN sell THEN -qty ELSE qty END) / nullif(sum(qty), 0), 6) AS ofi, round(sum(CASE WHEN sell THEN 0 ELSE qty END) / nullif(sum(qty), 0), 6) AS buyers FROM ticks GROUP BY ALL")
def tic04(spark, d):
    total = F.nullif(F.sum("qty"), F.lit(0.0))
    return ticks(spark, d).groupBy("symbol", "date").agg(r(F.try_divide(F.sum(F.when(F.col("sell"), -F.col("qty")).otherwise(F.col("qty"))), total)).alias("ofi"), r(F.try_divide(F.sum(F.when(F.col("sell"), 0.0).otherwise(F.col("qty"))), total)).alias("buyers"))


@add("TIC05_range_dispersion", f"WITH {BARS} SELECT symbol, date, round((high - low) / nullif(close, 0), 6) AS spread, CAST(sign(close - open) AS INTEGER) AS side FROM bars")
def tic05(spark, d):
    return bars(spark, d).select("symbol", "date", r(F.try_divide(F.col("high") - F.col("low"), F.nullif("close", F.lit(0.0)))).alias("spread"), F.signum(F.col("close") - F.col("open")).cast("int").alias("side"))


# --- texts

_TOK = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL)"
_Q = [("flow", "exchange flow stress"), ("risk", "risk budgets and unlock schedules"), ("fees", "fee revenue of lending desks")]
_BM25 = f"""{_TOK}, q AS (SELECT query, unnest(list_distinct(regexp_extract_all(lower(txt), '[a-z0-9_]+'))) AS term FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _Q)}) v(query, txt)),
c AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t), tf AS (SELECT doc_id, l, term, count(*) AS f FROM c GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), df AS (SELECT term, count(*) AS k FROM tf GROUP BY 1),
s AS (SELECT query, doc_id AS doc, sum(ln(1 + (n - k + 0.5) / (k + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM q JOIN df USING (term) JOIN tf USING (term), n GROUP BY ALL),
ranked AS (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM s)"""


def _scores(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    asked = spark.createDataFrame(_Q, "query string, txt string")
    return X.bm25(docs, asked, "doc_id", "text", "query", "txt").select("query", "doc", r("score").alias("score"))


@add("SCL01_tokens", f"WITH {_TOK} SELECT doc_id, len(w) AS n, w[1] AS first FROM t")
def scl01(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first"))


@add("SCL02_bm25_top", f"WITH {_BM25} SELECT query, doc, score, rank FROM ranked WHERE rank <= 10")
def scl02(spark, d):
    return X.top_k(_scores(spark, d), "query", "score", "doc", 10)


@add("SCL03_dense_top", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_inner_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 5")
def scl03(spark, d):
    from ..session import small

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("e"))
    asked = v.filter("doc % 100 = 0").select(F.col("doc").alias("query"), F.col("e").alias("q"))
    scored = v.join(small(asked, 100_000), F.col("query") != F.col("doc")).select("query", "doc", r(X.dot("q", "e")).alias("score"))
    return X.top_k(scored, "query", "score", "doc", 5)


@add("SCL04_fused_ranks", f"WITH {_BM25}, two AS (SELECT query, doc, rank FROM ranked WHERE rank <= 50 UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) FROM ranked WHERE rank <= 50) SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM two GROUP BY ALL")
def scl04(spark, d):
    first = X.top_k(_scores(spark, d), "query", "score", "doc", 50).select("query", "doc", "rank")
    second = first.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy("doc")).alias("rank"))
    return X.fuse_ranks(first.unionByName(second), "query", "doc", "rank").select("query", "doc", r("score", 9).alias("score"))


@add("SCL05_extract_number", "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE) AS pct FROM documents")
def scl05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr("try_cast(nullif(regexp_extract(text, '(\\\\d+(?:\\\\.\\\\d+)?)%', 1), '') AS DOUBLE)").alias("pct"))


@add("SCL07_human_numbers", "SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('%.2f', v / 1e6) || 'M' WHEN v >= 1e3 THEN printf('%.2f', v / 1e3) || 'K' ELSE printf('%.2f', v) END AS text FROM (SELECT o_orderkey, CAST(o_orderkey % 5000 * 400 AS DOUBLE) AS v FROM orders)")
def scl07(spark, d):
    v = (F.col("o_orderkey") % 5000 * 400).cast("double")
    return table(spark, d, "orders").select("o_orderkey", X.human(v).alias("text"))


@add("SCL09_map_keys", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1")
def scl09(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("user_id", F.array_sort(F.map_keys("m")).alias("kinds"))


@add("SCL11_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scl11(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@add("SCL12_stable_hash", "SELECT event_id, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS h FROM events")
def scl12(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "user_id"), 256).alias("h"))


@add("SCL13_flexible_times", "SELECT DISTINCT cycle_id, start_ts, epoch_us(coalesce(TRY_CAST(replace(start_ts, 'Z', '+00:00') AS TIMESTAMPTZ), TRY_CAST(start_ts || '+00:00' AS TIMESTAMPTZ))) AS us FROM cycles")
def scl13(spark, d):
    return table(spark, d, "cycles").select("cycle_id", "start_ts", F.unix_micros(F.expr("try_cast(start_ts AS TIMESTAMP)")).alias("us")).distinct()


@add("SCL15_to_number", "SELECT o_orderkey, coalesce(TRY_CAST(trim(o_orderpriority) AS DOUBLE), 0) AS x FROM orders")
def scl15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.to_number("o_orderpriority").alias("x"))


@add("SCL16_sigmoid", "SELECT id, round(1 / (1 + exp(-3 * confidence)), 6) AS s, round(exp(-2 * confidence), 6) AS damp FROM sizing")
def scl16(spark, d):
    c = F.col("confidence")
    return table(spark, d, "sizing").select("id", r(1 / (1 + F.exp(-3 * c))).alias("s"), r(F.exp(-2 * c)).alias("damp"))
