"""Queries that put several operators together: upserts, wide point-in-time frames, folds, comparisons and reports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import sharpe
from ..functions.windows import Series, forward_fill, pct_change
from ..operators.pit import walk_forward_folds, wide_as_of
from ..operators.shards import clean_name, usable_readings
from ..session import scratch
from ..sources.stores import INDEX, METRICS, NEWS, SEQ, read_store, replace_family, upsert
from .registry import Registry
from .views import BARS, RETURNS, bars, returns, table

R = Registry()
add = R.add
S = Series(("symbol",), ("date",))
COIN = "lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g'))"


def us(c):
    return F.unix_micros(c)


def _store(spark, name: str) -> str:
    return scratch(spark, name)


@add("SNK01_upsert_metrics", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_ts, as_of_ts, coin, metric, source ORDER BY status = 'final' DESC, reading_id DESC) AS rn FROM onchain WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND status IN ('flash', 'final')) SELECT coin, metric, source, epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, status FROM k WHERE rn = 1")
def snk01(spark, d):
    root = _store(spark, "metrics")
    rows = table(spark, d, "onchain").filter("event_ts IS NOT NULL AND as_of_ts IS NOT NULL").withColumn(SEQ, F.col("reading_id"))
    for status in ("flash", "final"):
        upsert(spark, rows.filter(F.col("status") == status), root, METRICS, ["event_ts", "as_of_ts", "coin", "metric", "source"], "event_ts")
    return read_store(spark, root, METRICS).select("coin", "metric", "source", us("event_ts").alias("e"), us("as_of_ts").alias("a"), "status")


@add("SNK02_upsert_news", "SELECT DISTINCT id, epoch_us(as_of_ts) AS a FROM news WHERE event_ts IS NOT NULL")
def snk02(spark, d):
    root = _store(spark, "news")
    rows = table(spark, d, "news").filter("event_ts IS NOT NULL")
    for _ in range(2):  # the second time changes nothing
        upsert(spark, rows, root, NEWS, ["id", "as_of_ts"], "event_ts")
    return read_store(spark, root, NEWS).select("id", us("as_of_ts").alias("a"))


@add("SNK03_upsert_index", "SELECT epoch_us(event_ts) AS e, arg_max(value, (epoch_us(as_of_ts), coalesce(value, -1))) FILTER (value IS NOT NULL) AS value FROM (SELECT *, rank() OVER (PARTITION BY event_ts ORDER BY as_of_ts DESC, coalesce(value, -1) DESC) AS r FROM fng WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL) WHERE r = 1 GROUP BY 1")
def snk03(spark, d):
    root = _store(spark, "index")
    rows = table(spark, d, "fng").dropna(subset=["event_ts", "as_of_ts"])
    rows = rows.withColumn(SEQ, us("as_of_ts") * 200 + F.coalesce("value", F.lit(-1)))
    upsert(spark, rows, root, INDEX, ["event_ts"], "event_ts")
    return read_store(spark, root, INDEX).select(us("event_ts").alias("e"), "value")


@add("SNK06_replace_family", f"WITH {BARS}, v AS (SELECT date, sum(volume) AS vol_sum FROM bars GROUP BY 1), c AS (SELECT date, max(close) AS px FROM bars WHERE symbol IN ('A', 'N') GROUP BY 1) SELECT date, px, vol_sum FROM c FULL JOIN v USING (date)")
def snk06(spark, d):
    b = bars(spark, d)
    base = b.filter("symbol IN ('A', 'N')").groupBy("date").agg(F.max("close").alias("px"), F.max("volume").alias("vol_old"))
    return replace_family(base, b.groupBy("date").agg(F.sum("volume").alias("vol_sum")), "date", "vol_")


_PIT = f"""r AS (SELECT {COIN} AS coin, source, metric, epoch_us(as_of_ts) AS a, epoch_us(event_ts) AS e, reading_id, value FROM onchain WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND metric IN ('FlowInExUSD', 'FlowOutExUSD', 'PriceUSD')),
days AS (SELECT epoch_us(unnest(generate_series(TIMESTAMP '2023-02-01', TIMESTAMP '2025-12-01', INTERVAL 1 MONTH))) AS t), k AS (SELECT DISTINCT coin, source FROM r),
h AS (SELECT coin, source, t, metric, arg_max(value, (a, e, reading_id)) AS v FROM k JOIN days ON true JOIN r USING (coin, source) WHERE a <= t GROUP BY ALL),
wide AS (SELECT k.coin, k.source, days.t, max(v) FILTER (metric = 'FlowInExUSD') AS FlowInExUSD, max(v) FILTER (metric = 'FlowOutExUSD') AS FlowOutExUSD, max(v) FILTER (metric = 'PriceUSD') AS PriceUSD FROM k JOIN days ON true LEFT JOIN h ON h.coin = k.coin AND h.source = k.source AND h.t = days.t GROUP BY ALL)"""


def _wide(spark, d):
    rows = usable_readings(table(spark, d, "onchain")).withColumn("coin", clean_name("coin"))
    dates = F.expr("sequence(TIMESTAMP '2023-02-01', TIMESTAMP '2025-12-01', INTERVAL 1 MONTH)")
    return wide_as_of(rows, dates, ["coin", "source"], ["FlowInExUSD", "FlowOutExUSD", "PriceUSD"], "as_of_ts", ["event_ts", "reading_id"])


@add("FEA01_wide_frame", f"WITH {_PIT} SELECT coin, source, t, FlowInExUSD, FlowOutExUSD, PriceUSD FROM wide")
def fea01(spark, d):
    return _wide(spark, d).select("coin", "source", us("date").alias("t"), "FlowInExUSD", "FlowOutExUSD", "PriceUSD")


@add("FEA02_derived", f"WITH {_PIT} SELECT coin, source, t, round((FlowInExUSD - FlowOutExUSD) / 1e3, 3) AS net, round(PriceUSD / nullif(lag(PriceUSD) OVER (PARTITION BY coin, source ORDER BY t), 0) - 1, 6) AS growth FROM wide")
def fea02(spark, d):
    s = Series(("coin", "source"), ("t",))
    have = fea01(spark, d)
    derived = {"net": F.round((F.col("FlowInExUSD") - F.col("FlowOutExUSD")) / 1e3, 3), "growth": F.round(F.try_divide("PriceUSD", F.nullif(F.lag("PriceUSD").over(s.w), F.lit(0.0))) - 1, 6)}
    return have.select("coin", "source", "t", *[c.alias(n) for n, c in derived.items()])


@add("FEA07_serving_row", f"WITH {BARS}, f AS (SELECT symbol, date, close / lag(close, 7) OVER (PARTITION BY symbol ORDER BY date) - 1 AS c7 FROM bars) SELECT symbol, max(date) AS date, round(arg_max(c7, date), 6) AS c7 FROM f WHERE date <= DATE '2000-06-30' GROUP BY 1")
def fea07(spark, d):
    f = bars(spark, d).filter("date <= DATE '2000-06-30'").select("symbol", "date", pct_change("close", S, 7).alias("c7"))
    return f.groupBy("symbol").agg(F.max("date").alias("date"), F.round(F.max_by("c7", "date"), 6).alias("c7"))


@add("MOD01_fold_sizes", f"WITH {BARS}, b AS (SELECT min(date) AS a FROM bars), f AS (SELECT DISTINCT date AS fold_date FROM bars, b WHERE (date - a) % 30 = 0) SELECT fold_date, CAST(count(*) AS BIGINT) AS n_train FROM f JOIN bars ON date <= fold_date - 14 AND date > fold_date - 14 - 365 GROUP BY 1 HAVING count(*) >= 200")
def mod01(spark, d):
    return walk_forward_folds(bars(spark, d), "date", 30, 200, 14, 365)


@add("AGG26_by_year", f"WITH {RETURNS} SELECT symbol, year(date) AS y, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 4) AS sharpe FROM returns GROUP BY ALL")
def agg26(spark, d):
    return returns(spark, d).groupBy("symbol", F.year("date").alias("y")).agg(F.round(sharpe(F.col("ret"), 252), 4).alias("sharpe"))


@add("AGG24_union_of_parts", f"WITH {BARS} SELECT symbol, count(*) AS n, min(date) AS a, max(date) AS b FROM bars GROUP BY 1")
def agg24(spark, d):
    b = bars(spark, d)
    parts = b.filter("symbol = 'A'").select("symbol", "date").unionByName(b.filter("symbol <> 'A'").drop("open"), allowMissingColumns=True)
    return parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))


@add("JON10_overlap", f"WITH {BARS} SELECT count(*) AS n, min(date) AS a, max(date) AS b FROM (SELECT date FROM bars WHERE symbol = 'A' INTERSECT SELECT date FROM bars WHERE symbol = 'N')")
def jon10(spark, d):
    b = bars(spark, d)
    both = b.filter("symbol = 'A'").select("date").intersect(b.filter("symbol = 'N'").select("date"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))


@add("JON12_shared_series", f"WITH {BARS}, g AS (SELECT date, sum(volume) AS gv FROM bars GROUP BY 1) SELECT symbol, bars.date, round(volume / gv, 6) AS part FROM bars JOIN g ON g.date = bars.date")
def jon12(spark, d):
    b = bars(spark, d)
    w = Window.partitionBy("date")
    return b.select("symbol", "date", F.round(F.col("volume") / F.sum("volume").over(w), 6).alias("part"))


@add("FLT05_guard", f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars WHERE date <= DATE '1999-12-31' GROUP BY 1")
def flt05(spark, d):
    return bars(spark, d).filter(F.col("date") <= F.lit("1999-12-31").cast("date")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@add("FLT08_columns_by_date", "WITH q AS (SELECT CAST(o_custkey AS BIGINT) AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT k, max(y) AS last_year, count(*) AS n FROM q WHERE y <= 1999 GROUP BY 1")
def flt08(spark, d):
    years = list(range(1995, 2003))
    wide = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).groupBy(F.col("o_custkey").alias("k")).pivot("y", years).agg(F.sum("o_totalprice"))
    kept = [c for c in wide.columns if c == "k" or int(c) <= 1999]
    long = wide.select(kept).unpivot(["k"], kept[1:], "y", "v").filter("v IS NOT NULL")
    return long.groupBy("k").agg(F.max(F.col("y").cast("long")).alias("last_year"), F.count(F.lit(1)).alias("n"))


@add("PRJ01_rename_cast", f"WITH {BARS} SELECT symbol AS coin_id, date, close AS prices, CAST(volume AS FLOAT) AS volume, round(high - low, 6) AS spread FROM bars")
def prj01(spark, d):
    b = bars(spark, d).withColumnsRenamed({"symbol": "coin_id", "close": "prices"})
    return b.select("coin_id", "date", "prices", F.col("volume").cast("float").alias("volume"), F.round(F.col("high") - F.col("low"), 6).alias("spread"))


@add("PRJ04_shift_and_fill", f"WITH {BARS}, s AS (SELECT symbol, date, lag(CASE WHEN day(date) % 7 = 0 THEN NULL ELSE close END) OVER (PARTITION BY symbol ORDER BY date) AS x FROM bars) SELECT symbol, date, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS x FROM s")
def prj04(spark, d):
    holes = bars(spark, d).select("symbol", "date", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")).alias("c"))
    s = holes.select("symbol", "date", F.lag("c").over(S.w).alias("x"))
    return s.select("symbol", "date", F.coalesce(forward_fill("x", S), F.lit(0.0)).alias("x"))


_TWO = f"{RETURNS}, j AS (SELECT date, a.ret AS x, b.ret AS y FROM returns a JOIN returns b USING (date) WHERE a.symbol = 'A' AND b.symbol = 'N')"


def _two(spark, d):
    q = returns(spark, d)
    return q.filter("symbol = 'A'").select("date", F.col("ret").alias("x")).join(q.filter("symbol = 'N'").select("date", F.col("ret").alias("y")), "date")


@add("MET09_two_books", f"WITH {_TWO} SELECT count(*) AS n, round(avg(x) / stddev_samp(x) * sqrt(252) - avg(y) / stddev_samp(y) * sqrt(252), 4) AS sharpe_gap, round(sum(ln(1 + x)) - sum(ln(1 + y)), 6) AS log_gap FROM j")
def met09(spark, d):
    x, y = F.col("x"), F.col("y")
    return _two(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(sharpe(x, 252) - sharpe(y, 252), 4).alias("sharpe_gap"), F.round(F.sum(F.log1p("x")) - F.sum(F.log1p("y")), 6).alias("log_gap"))


@add("MET10_parity", f"WITH {_TWO} SELECT round(corr(x, y), 6) AS corr, round(avg(abs(x - y)), 6) AS mae, CASE WHEN count(*) < 10 THEN 'short' WHEN corr(x, y) >= 0.8 THEN 'pass' WHEN corr(x, y) >= 0.5 THEN 'warn' ELSE 'fail' END AS verdict FROM j")
def met10(spark, d):
    c = F.corr("x", "y")
    verdict = F.when(F.count(F.lit(1)) < 10, "short").when(c >= 0.8, "pass").when(c >= 0.5, "warn").otherwise("fail")
    return _two(spark, d).agg(F.round(c, 6).alias("corr"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mae"), verdict.alias("verdict"))


@add("MET06_calmar", f"WITH {RETURNS}, n AS (SELECT symbol, date, ret, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date) AS v FROM returns), k AS (SELECT symbol, ret, v / max(v) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM n) SELECT symbol, round((pow(product(1 + ret), 252.0 / count(*)) - 1) / nullif(-min(dd), 0), 4) AS calmar FROM k GROUP BY 1")
def met06(spark, d):
    from ..functions.stats import annualised
    from ..functions.windows import compounded, drawdown

    n = returns(spark, d).select("symbol", "date", "ret", compounded("ret", S).alias("v"))
    k = n.select("symbol", "ret", drawdown("v", S).alias("dd"))
    return k.groupBy("symbol").agg(F.round(F.try_divide(annualised(F.col("ret"), 252), F.nullif(-F.min("dd"), F.lit(0.0))), 4).alias("calmar"))


@add("MET08_from_peak", f"WITH {BARS}, e AS (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol ORDER BY date) AS p, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS l FROM bars) SELECT symbol, round(arg_max((close - l) / l, date), 6) AS today, round(arg_max((p - close) / p, date), 6) AS below FROM e GROUP BY 1")
def met08(spark, d):
    e = bars(spark, d).select("symbol", "date", "close", F.max("close").over(S.so_far).alias("p"), F.lag("close").over(S.w).alias("l"))
    return e.groupBy("symbol").agg(F.round(F.max_by((F.col("close") - F.col("l")) / F.col("l"), "date"), 6).alias("today"), F.round(F.max_by((F.col("p") - F.col("close")) / F.col("p"), "date"), 6).alias("below"))


@add("MET18_strided_bootstrap", f"""WITH {RETURNS}, i AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, ret, count(*) OVER () AS n FROM returns WHERE symbol = 'A'), n AS (SELECT max(n) AS n FROM i),
g AS (SELECT b.k, s.j, ((b.k * 2654435761 + (s.j // 5) * 40503) % n.n + s.j % 5) % n.n AS at FROM range(50) b(k), n, range(n.n) s(j)) SELECT k, round(avg(ret) / stddev_pop(ret) * sqrt(252), 4) AS sharpe FROM g JOIN i ON i.i = g.at GROUP BY 1""")
def met18(spark, d):
    rows = returns(spark, d).filter("symbol = 'A'").select((F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("i"), "ret")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(50).select(F.col("id").alias("k")).crossJoin(F.broadcast(n)).select("k", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))  # n is one row
    at = ((F.col("k") * 2654435761 + F.floor(F.col("j") / 5) * 40503) % F.col("n") + F.col("j") % 5) % F.col("n")
    return draws.select("k", at.alias("i")).join(rows, "i").groupBy("k").agg(F.round(F.avg("ret") / F.stddev_pop("ret") * math.sqrt(252), 4).alias("sharpe"))


@add("MET27_grid", f"WITH {RETURNS}, g AS (SELECT c.c AS cut, s.s AS span FROM (VALUES (0.0), (0.001), (0.002)) c(c), (VALUES (5), (20)) s(s)), m AS (SELECT symbol, date, ret, avg(ret) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS m5, avg(ret) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS m20 FROM returns) SELECT symbol, CAST(cut AS DOUBLE) AS cut, span, count(*) FILTER (CASE span WHEN 5 THEN m5 ELSE m20 END > cut) AS n FROM m, g GROUP BY ALL")
def met27(spark, d):
    means = {n: F.avg("ret").over(S.last(n)).alias(f"m{n}") for n in (5, 20)}
    m = returns(spark, d).select("symbol", *means.values())
    grid = [F.struct(F.lit(c).alias("cut"), F.lit(n).alias("span"), (F.col(f"m{n}") > c).alias("hit")) for c in (0.0, 0.001, 0.002) for n in (5, 20)]
    return m.select("symbol", F.inline(F.array(*grid))).groupBy("symbol", "cut", "span").agg(F.count_if("hit").alias("n"))


@add("SCL06_bands", "SELECT reading_id, CASE WHEN value < 1 THEN 'low' WHEN value < 2.5 THEN 'middle' WHEN value < 4 THEN 'high' ELSE 'extreme' END AS band FROM onchain WHERE metric = 'CapMVRVCur' AND value IS NOT NULL AND NOT isnan(value)")
def scl06(spark, d):
    v, band = F.col("value"), F.lit("extreme")
    for bound, name in ((4, "high"), (2.5, "middle"), (1, "low")):
        band = F.when(v < bound, name).otherwise(band)
    return table(spark, d, "onchain").filter("metric = 'CapMVRVCur' AND value IS NOT NULL AND NOT isnan(value)").select("reading_id", band.alias("band"))


@add("SCL10_freshness", f"SELECT {COIN} AS coin, source, (1767225600000000 - max(epoch_us(as_of_ts))) // 3600000000 AS hours FROM onchain WHERE as_of_ts IS NOT NULL GROUP BY ALL")
def scl10(spark, d):
    rows = table(spark, d, "onchain").filter("as_of_ts IS NOT NULL").groupBy(clean_name("coin").alias("coin"), "source").agg(F.max(us("as_of_ts")).alias("t"))
    return rows.select("coin", "source", F.expr("(1767225600000000L - t) div 3600000000L").alias("hours"))


@add("ORD05_exploded_map", "SELECT user_id, event_type, round(sum(CAST(json_extract(props, '$.k') AS BIGINT) * value), 2) AS total FROM events GROUP BY ALL")
def ord05(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "k")).filter("name = 'k'")
    return e.groupBy("user_id", "event_type").agg(F.round(F.sum(F.col("k") * F.col("value")), 2).alias("total"))


@add("TOL01_first_to_last", f"WITH {BARS} SELECT symbol, round(100 * (arg_max(close, date) / arg_min(close, date) - 1), 4) AS change, round(avg(close), 2) AS mean FROM bars GROUP BY 1")
def tol01(spark, d):
    return bars(spark, d).groupBy("symbol").agg(F.round(100 * (F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1), 4).alias("change"), F.round(F.avg("close"), 2).alias("mean"))


@add("TOL03_article_fields", "SELECT DISTINCT id, coalesce(nullif(trim(headline), ''), 'No title') AS title, coalesce(nullif(trim(summary), ''), left(trim(content), 80)) AS lead FROM news WHERE content NOT LIKE '%\t%' OR content IS NULL")
def tol03(spark, d):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = table(spark, d, "news").filter("content NOT LIKE '%\t%' OR content IS NULL")
    return rows.select("id", F.coalesce(blank("headline"), F.lit("No title")).alias("title"), F.coalesce(blank("summary"), F.left(F.trim("content"), F.lit(80))).alias("lead")).distinct()


@add("TOL15_panel", f"WITH {BARS}, s AS (SELECT symbol, CAST(unnest(generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT symbol FROM bars)) SELECT symbol, date, CASE WHEN close > open THEN 'UP' WHEN close < open THEN 'DOWN' ELSE 'HOLD' END AS x FROM s LEFT JOIN bars USING (symbol, date)")
def tol15(spark, d):
    b = bars(spark, d)
    spine = b.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit("1999-01-01").cast("date"), F.lit("1999-12-31").cast("date"))).alias("date"))
    x = F.when(F.col("close") > F.col("open"), "UP").when(F.col("close") < F.col("open"), "DOWN").otherwise("HOLD")
    return spine.join(b, ["symbol", "date"], "left").select("symbol", "date", x.alias("x"))


@add("TOL17_per_order", "SELECT order_id, round(sum(abs(fees)), 6) AS fees, round(sum(pnl), 6) AS pnl FROM (SELECT DISTINCT * FROM trades) WHERE order_id IS NOT NULL GROUP BY 1")
def tol17(spark, d):
    t = table(spark, d, "trades").distinct().filter("order_id IS NOT NULL")
    return t.groupBy("order_id").agg(F.round(F.sum(F.abs("fees")), 6).alias("fees"), F.round(F.sum("pnl"), 6).alias("pnl"))


@add("TOL18_shortened", "SELECT DISTINCT id, CASE WHEN length(market_report) > 60 THEN left(market_report, 60) || '...' ELSE market_report END AS report FROM analyst_reports")
def tol18(spark, d):
    text = F.col("market_report")
    return table(spark, d, "analyst_reports").select("id", F.when(F.length(text) > 60, F.concat(F.left(text, F.lit(60)), F.lit("..."))).otherwise(text).alias("report")).distinct()
