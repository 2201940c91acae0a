"""Queries of indicators, derived columns, tests of significance, stores and journal look-ups."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.derived import derive
from ..functions.folds import exponential_mean
from ..functions.stats import central_moment, expected_maximum, normal_cdf, normal_cdf_sql, sharpe, shortest_length, two_weights
from ..functions.windows import Series, forward_fill, log_change, pct_change, rolling_mean, rolling_std
from ..operators.shards import clean_name, day_number, day_text, usable_readings
from ..session import scratch, stage
from ..sources.stores import SEQ, export_csv, keep_last, read_csv, read_newest, read_store, tag_symbols, upsert, without_tags
from ..streaming.kslack import into_store
from .registry import Registry
from .views import BARS, RETURNS, TICKS, bars, returns, table, ticks

R = Registry()
add = R.add
S = Series(("symbol",), ("date",))
W = "w AS (PARTITION BY symbol ORDER BY date)"
_N = f"{BARS}, n AS (SELECT *, row_number() OVER w AS i, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM bars WINDOW {W})"


def r(c, n=4):
    return F.round(c, n)


def frame(n: int) -> str:
    return f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


# --- indicators


@add("WIN23_macd", f"""WITH RECURSIVE {_N}, f AS (SELECT symbol, i, date, close AS a, close AS b, 0.0::DOUBLE AS m FROM n WHERE i = 1
UNION ALL SELECT n.symbol, n.i, n.date, f.a + (n.close - f.a) * 2 / 13.0, f.b + (n.close - f.b) * 2 / 27.0, f.m + ((f.a + (n.close - f.a) * 2 / 13.0) - (f.b + (n.close - f.b) * 2 / 27.0) - f.m) * 2 / 10.0 FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
SELECT symbol, date, round(a - b, 4) AS macd, round(m, 4) AS macds, round(a - b - m, 4) AS macdh FROM f""")
def macd(spark, d):
    return I.macd(bars(spark, d)).select("symbol", "date", *[r(c).alias(c) for c in ("macd", "macds", "macdh")])


@add("WIN23_directional", f"""WITH RECURSIVE {_N}, v AS (SELECT symbol, i, date, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS u, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS d, greatest(high - low, abs(high - pc), abs(low - pc)) AS t FROM n WHERE i > 1),
f AS (SELECT symbol, i, date, u / 14 AS u, d / 14 AS d, t / 14 AS t, coalesce(100 * abs(u - d) / nullif(u + d, 0), 0) / 14 AS a FROM v WHERE i = 2
UNION ALL SELECT v.symbol, v.i, v.date, f.u + (v.u - f.u) / 14, f.d + (v.d - f.d) / 14, f.t + (v.t - f.t) / 14, f.a + (coalesce(100 * abs((f.u + (v.u - f.u) / 14) - (f.d + (v.d - f.d) / 14)) / nullif((f.u + (v.u - f.u) / 14) + (f.d + (v.d - f.d) / 14), 0), 0) - f.a) / 14 FROM f JOIN v ON v.symbol = f.symbol AND v.i = f.i + 1)
SELECT symbol, date, round(coalesce(100 * u / nullif(t, 0), 0), 4) AS pdi, round(coalesce(100 * d / nullif(t, 0), 0), 4) AS mdi, round(a, 4) AS adx FROM f""")
def directional(spark, d):
    return I.directional(bars(spark, d)).select("symbol", "date", *[r(c).alias(c) for c in ("pdi", "mdi", "adx")])


@add("WIN23_stochastic", f"""WITH RECURSIVE {_N}, v AS (SELECT symbol, i, date, coalesce(100 * (close - min(low) OVER w9) / nullif(max(high) OVER w9 - min(low) OVER w9, 0), 50) AS x FROM n WINDOW {frame(9)}),
f AS (SELECT symbol, i, date, 50 + (x - 50) / 3 AS k, 50 + (x - 50) / 9 AS d FROM v WHERE i = 1
UNION ALL SELECT v.symbol, v.i, v.date, f.k + (v.x - f.k) / 3, f.d + (f.k + (v.x - f.k) / 3 - f.d) / 3 FROM f JOIN v ON v.symbol = f.symbol AND v.i = f.i + 1)
SELECT symbol, date, round(k, 4) AS kdjk, round(d, 4) AS kdjd, round(3 * k - 2 * d, 4) AS kdjj FROM f""")
def stochastic(spark, d):
    return I.stochastic(bars(spark, d)).select("symbol", "date", *[r(c).alias(c) for c in ("kdjk", "kdjd", "kdjj")])


@add("WIN23_channel", f"""WITH {BARS}, t AS (SELECT symbol, date, (high + low + close) / 3 AS t FROM bars), l AS (SELECT symbol, date, t, CASE WHEN count(t) OVER w20 >= 20 THEN avg(t) OVER w20 END AS m, list(t) OVER w20 AS l FROM t WINDOW {frame(20)}),
s AS (SELECT *, list_sum(list_transform(l, lambda x: abs(x - m))) / 20 AS s FROM l) SELECT symbol, date, round(CASE WHEN s > 1e-9 THEN (t - m) / (0.015 * s) END, 3) AS cci FROM s""")
def channel(spark, d):
    return I.commodity_channel(bars(spark, d)).select("symbol", "date", r("cci", 3).alias("cci"))


@add("WIN23_money_flow", f"""WITH {BARS}, t AS (SELECT symbol, date, volume, (high + low + close) / 3 AS t FROM bars), c AS (SELECT *, t - lag(t) OVER w AS c FROM t WINDOW {W}), u AS (SELECT symbol, date, CASE WHEN c > 0 THEN t * volume ELSE 0 END AS u, CASE WHEN c < 0 THEN t * volume ELSE 0 END AS v FROM c WHERE c IS NOT NULL),
s AS (SELECT symbol, date, CASE WHEN count(*) OVER w14 >= 14 THEN sum(u) OVER w14 END AS u, CASE WHEN count(*) OVER w14 >= 14 THEN sum(v) OVER w14 END AS v FROM u WINDOW {frame(14)}) SELECT symbol, date, round(100 * u / nullif(u + v, 0), 4) AS mfi FROM s""")
def money_flow(spark, d):
    return I.money_flow(bars(spark, d)).select("symbol", "date", r("mfi").alias("mfi"))


@add("WIN23_long_means", f"""WITH {BARS} SELECT symbol, date, round(CASE WHEN count(close) OVER w20 >= 20 THEN avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20 END, 4) AS lower, round(CASE WHEN count(close) OVER w50 >= 50 THEN avg(close) OVER w50 END, 4) AS sma50, round(CASE WHEN count(close) OVER w200 >= 200 THEN avg(close) OVER w200 END, 4) AS sma200 FROM bars WINDOW {frame(20)}, {frame(50)}, {frame(200)}""")
def long_means(spark, d):
    return bars(spark, d).select("symbol", "date", r(rolling_mean("close", S, 20) - 2 * rolling_std("close", S, 20)).alias("lower"), r(rolling_mean("close", S, 50)).alias("sma50"), r(rolling_mean("close", S, 200)).alias("sma200"))


@add("WIN23_wilder_rsi_30", f"""WITH RECURSIVE {_N}, f AS (SELECT symbol, i, date, greatest(close - pc, 0) AS u, greatest(pc - close, 0) AS v FROM n WHERE i = 2
UNION ALL SELECT n.symbol, n.i, n.date, f.u + (greatest(n.close - n.pc, 0) - f.u) / 30, f.v + (greatest(n.pc - n.close, 0) - f.v) / 30 FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1) SELECT symbol, date, round(100 * u / nullif(u + v, 0), 3) AS rsi FROM f""")
def wilder_rsi_30(spark, d):
    g = bars(spark, d).select("symbol", "date", (F.col("close") - F.lag("close").over(S.w)).alias("x")).filter("x IS NOT NULL")
    up = exponential_mean(g.withColumn("u", F.greatest("x", F.lit(0.0))), ["symbol"], "date", "u", 1 / 30, "eu")
    down = exponential_mean(g.withColumn("v", F.greatest(-F.col("x"), F.lit(0.0))), ["symbol"], "date", "v", 1 / 30, "ev")
    return up.join(down, ["symbol", "date"]).select("symbol", "date", r(100 * F.try_divide("eu", F.nullif(F.col("eu") + F.col("ev"), F.lit(0.0))), 3).alias("rsi"))


@add("WIN29_regimes", f"""WITH {BARS}, g AS (SELECT symbol, date, ln(close) - lag(ln(close), 30) OVER w AS t, ln(close) - lag(ln(close)) OVER w AS x FROM bars WINDOW {W}), v AS (SELECT symbol, date, t, CASE WHEN count(x) OVER w20 >= 20 THEN stddev_samp(x) OVER w20 END AS v FROM g WINDOW {frame(20)}),
q AS (SELECT symbol, quantile_cont(v, 0.9) AS q FROM v GROUP BY 1) SELECT symbol, date, CASE WHEN t IS NULL OR v IS NULL THEN 'unknown' WHEN v > q + 1e-12 THEN 'turbulent' WHEN t > 0 THEN 'up' ELSE 'down' END AS regime FROM v JOIN q USING (symbol)""")
def regimes(spark, d):
    """Labels by the log return over 30 bars and by volatility against the 90th percentile of the whole series."""
    g = bars(spark, d).select("symbol", "date", log_change("close", S, 30).alias("t"), log_change("close", S).alias("x"))
    v = g.select("symbol", "date", "t", rolling_std("x", S, 20).alias("v"))
    q = v.groupBy("symbol").agg(F.percentile("v", F.lit(0.9)).alias("q"))
    return v.join(q, "symbol").select("symbol", "date", F.when(F.col("t").isNull() | F.col("v").isNull(), "unknown").when(F.col("v") > F.col("q") + 1e-12, "turbulent").when(F.col("t") > 0, "up").otherwise("down").alias("regime"))


# --- derived columns on the union of all dates

_COIN = "lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g'))"
_USED = ("CapMVRVCur", "FlowInExUSD", "FlowOutExUSD", "AdrActCnt", "TxTfrCnt", "HashRate")
_FILLED = ", ".join(f"last_value({m} IGNORE NULLS) OVER w AS {m}" for m in _USED)
_PICKED = ", ".join(f"arg_max(value, (a, e, reading_id)) FILTER (metric = '{m}') AS {m}" for m in _USED)
_UNION = f"""r AS (SELECT {_COIN} AS coin, source, metric, epoch_us(as_of_ts) AS a, epoch_us(event_ts) AS e, reading_id, value, CAST(floor(epoch_us(as_of_ts) / 86400000000.0) AS INTEGER) AS d FROM onchain WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
p AS (SELECT coin, source, d, {_PICKED} FROM r GROUP BY ALL), f AS (SELECT coin, source, d, {_FILLED} FROM p WINDOW w AS (PARTITION BY coin, source ORDER BY d ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, FlowInExUSD - FlowOutExUSD AS net_flow_usd FROM f)"""


def _z(x: str, n: int, least: int) -> str:
    m, sd = f"CASE WHEN count({x}) OVER w{n} >= {least} THEN avg({x}) OVER w{n} END", f"CASE WHEN count({x}) OVER w{n} >= {least} THEN stddev_samp({x}) OVER w{n} END"
    return f"round(CASE WHEN {sd} > 1e-9 * greatest(abs({m}), 1e-300) THEN ({x} - {m}) / {sd} END, 4)"


def _chg(x: str, n: int) -> str:
    return f"round({x} / nullif(lag({x}, {n}) OVER w, 0) - 1, 4)"


_DERIVED = {"mvrv_z_1y": _z("CapMVRVCur", 365, 60), "mvrv_z_4y": _z("CapMVRVCur", 1460, 180), "net_flow_z_30d": _z("net_flow_usd", 30, 5), "active_addr_z_30d": _z("AdrActCnt", 30, 5), "tfr_cnt_chg_30d": _chg("TxTfrCnt", 30), "hashrate_chg_30d": _chg("HashRate", 30)}
_OVER = ", ".join(f"w{n} AS (PARTITION BY coin, source ORDER BY d ROWS {n - 1} PRECEDING)" for n in (30, 365, 1460))


@add("FEA02_on_union_index", f"WITH {_UNION} SELECT coin, source, d AS day, round(net_flow_usd / 1e3, 2) AS net_flow_usd, {', '.join(f'{x} AS {c}' for c, x in _DERIVED.items())} FROM u WINDOW w AS (PARTITION BY coin, source ORDER BY d), {_OVER}")
def fea02_union(spark, d):
    """Rows are the days on which any metric of a coin and source became known; values are filled forward over them."""
    rows = usable_readings(table(spark, d, "onchain")).withColumn("coin", clean_name("coin")).withColumn("day", day_number(F.col("as_of_ts")))
    known = F.struct("as_of_ts", "event_ts", "reading_id")
    daily = rows.groupBy("coin", "source", "day").agg(*[F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, known)).alias(m) for m in _USED])
    s = Series(("coin", "source"), ("day",))
    filled = daily.select("coin", "source", "day", *[forward_fill(m, s).alias(m) for m in _USED])
    out = derive(filled, s)
    return out.select("coin", "source", "day", r(F.col("net_flow_usd") / 1e3, 2).alias("net_flow_usd"), *[r(c).alias(c) for c in _DERIVED])


# --- significance

_MOMENTS = f"""{RETURNS}, m AS (SELECT symbol, avg(ret) AS mu FROM returns GROUP BY 1), c AS (SELECT symbol, mu, count(*) AS n, stddev_samp(ret) AS sd, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4 FROM returns JOIN m USING (symbol) GROUP BY symbol, mu),
q AS (SELECT symbol, n, mu / sd AS sr, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt FROM c)"""
_BEST = expected_maximum(12, 1e-4)
_Z95 = NormalDist().inv_cdf(0.95)


@add("MET15_deflated_sharpe", f"""WITH {_MOMENTS}, z AS (SELECT *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS v FROM q), s AS (SELECT *, sr / sqrt(v / (n - 1)) AS a, (sr - {_BEST!r}) / sqrt(v / (n - 1)) AS b FROM z)
SELECT symbol, n, round(sr, 6) AS sr, round({normal_cdf_sql('a')}, 6) AS psr, round({normal_cdf_sql('b')}, 6) AS dsr, CASE WHEN sr > 0 THEN round(ln(1 + v * pow({_Z95!r} / sr, 2)), 4) END AS log_shortest FROM s""")
def deflated(spark, d):
    """Probabilistic and deflated Sharpe ratio (12 trials) under the series' skew and kurtosis; log of the shortest length that would do."""
    q = returns(spark, d)
    mean = q.groupBy("symbol").agg(F.avg("ret").alias("mu"))
    m = lambda k: central_moment(F.col("ret"), F.col("mu"), k)
    c = q.join(mean, "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), sharpe(F.col("ret"), 1).alias("sr"), (m(3) / F.pow(m(2), F.lit(1.5))).alias("skew"), (m(4) / (m(2) * m(2))).alias("kurt"))
    spread = F.sqrt((1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / (F.col("n") - 1))
    least = shortest_length(F.col("sr"), F.col("skew"), F.col("kurt"))
    return c.select("symbol", "n", r("sr", 6).alias("sr"), r(normal_cdf(F.col("sr") / spread), 6).alias("psr"), r(normal_cdf((F.col("sr") - _BEST) / spread), 6).alias("dsr"), F.when(F.col("sr") > 0, r(F.ln(least))).alias("log_shortest"))


@add("MET23_tangency", f"""WITH {RETURNS}, x AS (SELECT date, a.ret AS u, b.ret AS v FROM returns a JOIN returns b USING (date) WHERE a.symbol = 'A' AND b.symbol = 'N'), c AS (SELECT date, row_number() OVER w AS i, avg(u) OVER w AS mu, avg(v) OVER w AS mv, var_samp(u) OVER w AS a, var_samp(v) OVER w AS b, covar_samp(u, v) OVER w AS c FROM x WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
k AS (SELECT date, (b * mu - c * mv) / nullif(a * b - c * c, 0) AS ta, (a * mv - c * mu) / nullif(a * b - c * c, 0) AS tb, (b - c) / nullif(a * b - c * c, 0) AS la, (a - c) / nullif(a * b - c * c, 0) AS lb FROM c WHERE i >= 60)
SELECT date, round(CASE WHEN abs(ta + tb) > 1e-12 THEN least(1, greatest(0, ta / (ta + tb))) ELSE 0.5 END, 3) AS tangency, round(CASE WHEN abs(la + lb) > 1e-12 THEN least(1, greatest(0, la / (la + lb))) ELSE 0.5 END, 3) AS least_variance FROM k""")
def tangency(spark, d):
    """Weights of two series by all returns up to each day, from 60 of them on. One row a day."""
    q = returns(spark, d)
    x = q.filter("symbol = 'A'").select(F.lit("A/N").alias("symbol"), "date", F.col("ret").alias("u")).join(q.filter("symbol = 'N'").select("date", F.col("ret").alias("v")), "date")
    f = S.so_far
    best, least = two_weights(F.avg("u").over(f), F.avg("v").over(f), F.var_samp("u").over(f), F.var_samp("v").over(f), F.covar_samp("u", "v").over(f))
    return x.select("date", F.row_number().over(S.w).alias("i"), r(best, 3).alias("tangency"), r(least, 3).alias("least_variance")).filter("i >= 60").drop("i")


@add("MET24_rescaled_range", f"""WITH {RETURNS}, i AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM returns), m AS (SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd, count(*) AS n FROM i WHERE k <= 100 GROUP BY 1),
c AS (SELECT symbol, sd, n, sum(ret - mu) OVER (PARTITION BY symbol ORDER BY k DESC) AS c FROM i JOIN m USING (symbol) WHERE k <= 100) SELECT symbol, round(CASE WHEN n < 100 OR sd <= 0 OR max(c) - min(c) <= 0 THEN 0.5 ELSE ln((max(c) - min(c)) / sd) / ln(100) END, 5) AS h FROM c GROUP BY symbol, sd, n""")
def rescaled_range(spark, d):
    """Hurst exponent by the rescaled range of the last 100 returns; 0.5 where there are fewer."""
    last = returns(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("k <= 100")
    m = last.groupBy("symbol").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count(F.lit(1)).alias("n"))
    c = last.join(m, "symbol").withColumn("c", F.sum(F.col("ret") - F.col("mu")).over(S.so_far))
    span = F.max("c") - F.min("c")
    return c.groupBy("symbol", "sd", "n").agg(r(F.when((F.col("n") < 100) | (F.col("sd") <= 0) | (span <= 0), 0.5).otherwise(F.ln(span / F.col("sd")) / math.log(100)), 5).alias("h")).select("symbol", "h")


@add("TIC06_joined_block", f"""WITH {TICKS}, f AS (SELECT symbol, date, arg_max(price, (ts, price)) AS f FROM ticks GROUP BY ALL), o AS (SELECT symbol, date, sum(qty) AS oi, avg(price) AS perp FROM ticks WHERE day(date) % 3 <> 0 GROUP BY ALL), l AS (SELECT symbol, date, sum(CASE WHEN sell THEN qty ELSE 0 END) AS a, sum(qty) AS t, min(price) AS spot FROM ticks WHERE day(date) % 5 <> 0 GROUP BY ALL),
j AS (SELECT * FROM f FULL JOIN o USING (symbol, date) FULL JOIN l USING (symbol, date))
SELECT symbol, date, f AS level, round((perp - spot) / nullif(spot, 0) * 365, 4) AS basis, round(CASE WHEN oi > 0 THEN ln(oi) END - lag(CASE WHEN oi > 0 THEN ln(oi) END, 7) OVER w, 5) AS change_7, round(2 * a / nullif(t, 0) - 1, 5) AS asymmetry FROM j WINDOW {W}""")
def joined_block(spark, d):
    """Last funding of the day, annualised basis, change of open interest and asymmetry of liquidations, from tables that lack days."""
    t = ticks(spark, d)
    f = t.groupBy("symbol", "date").agg(F.max_by("price", F.struct("ts", "price")).alias("f"))
    o = t.filter(F.dayofmonth("date") % 3 != 0).groupBy("symbol", "date").agg(F.sum("qty").alias("oi"), F.avg("price").alias("perp"))
    li = t.filter(F.dayofmonth("date") % 5 != 0).groupBy("symbol", "date").agg(F.sum(F.when(F.col("sell"), F.col("qty")).otherwise(0.0)).alias("a"), F.sum("qty").alias("t"), F.min("price").alias("spot"))
    j = f.join(o, ["symbol", "date"], "full").join(li, ["symbol", "date"], "full")
    share = 2 * F.try_divide("a", F.nullif("t", F.lit(0.0))) - 1
    return j.select("symbol", "date", F.col("f").alias("level"), r(F.try_divide(F.col("perp") - F.col("spot"), F.nullif("spot", F.lit(0.0))) * 365).alias("basis"), r(log_change("oi", S, 7), 5).alias("change_7"), r(share, 5).alias("asymmetry"))


# --- ingest, stores and streams

#: Symbols and the terms that stand for them.
TERMS = {"BTCUSD": ["bitcoin", "btc"], "ETHUSD": ["ethereum", "ether", " eth"], "BNBUSD": ["binance", "bnb"], "SOLUSD": ["solana", "=sol"], "ADAUSD": ["cardano", "=ada"]}


def _terms_sql() -> str:
    def hit(t: str) -> str:
        return f"list_contains(string_split_regex(h, '\\s+'), '{t[1:]}')" if t.startswith("=") else f"contains(h, '{t}')"

    return ", ".join(f"CASE WHEN {' OR '.join(map(hit, terms))} THEN '{s}' END" for s, terms in TERMS.items())


@add("SRC11_tags", f"WITH n AS (SELECT DISTINCT id, lower(coalesce(headline, '')) AS h, coalesce(content, '') AS c FROM news) SELECT id, coalesce(nullif(concat_ws(',', {_terms_sql()}), ''), 'BTCUSD') AS tags, regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS plain FROM n")
def tags(spark, d):
    rows = table(spark, d, "news").select("id", F.lower(F.coalesce("headline", F.lit(""))).alias("h"), F.coalesce("content", F.lit("")).alias("c")).distinct()
    return rows.select("id", tag_symbols(F.col("h"), TERMS, "BTCUSD").alias("tags"), without_tags("c").alias("plain"))


_WEEKS = "week_end timestamp, coin string, belief double"


@add("SNK04_upsert_beliefs", "SELECT coin, epoch_us(date_trunc('week', make_timestamp(epoch_us(published_ts)))) AS week, arg_max(CAST(n_chars AS DOUBLE), doc_id) AS belief FROM (SELECT coin_id AS coin, * FROM documents) WHERE coin IS NOT NULL AND published_ts IS NOT NULL GROUP BY ALL")
def upsert_beliefs(spark, d):
    root = scratch(spark, "beliefs")
    rows = table(spark, d, "documents").filter("coin_id IS NOT NULL AND published_ts IS NOT NULL").select(F.date_trunc("week", "published_ts").alias("week_end"), F.col("coin_id").alias("coin"), F.col("n_chars").cast("double").alias("belief"), F.col("doc_id").alias(SEQ))
    upsert(spark, rows.withColumn("belief", -F.col("belief")), root, _WEEKS, ["week_end", "coin"], "week_end")
    upsert(spark, rows, root, _WEEKS, ["week_end", "coin"], "week_end")  # the newer batch wins
    return read_store(spark, root, _WEEKS).select("coin", F.unix_micros("week_end").alias("week"), "belief")


_DAYS = "symbol string, date date, close double"


@add("SNK05_append_bars", f"WITH {BARS} SELECT symbol, date, CASE WHEN date < (SELECT max(date) - 400 FROM bars) THEN close ELSE close + 1 END AS close FROM bars")
def append_bars(spark, d):
    """Bars appended with an overlap; of each date the bar that came last stays."""
    b, root = stage(bars(spark, d)), scratch(spark, "bars")
    cut = F.date_sub(F.lit(b.agg(F.max("date")).first()[0]), 400)
    upsert(spark, b, root, _DAYS, ["symbol", "date"], "date")
    upsert(spark, b.filter(F.col("date") >= cut).withColumn("close", F.col("close") + 1), root, _DAYS, ["symbol", "date"], "date")
    return read_store(spark, root, _DAYS).select("symbol", "date", "close")


@add("SNK07_last_of_index", "SELECT epoch_us(event_ts) AS e, arg_max(value, (epoch_us(as_of_ts), value)) AS value FROM fng WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND value IS NOT NULL GROUP BY 1")
def last_of_index(spark, d):
    rows = table(spark, d, "fng").dropna(subset=["event_ts", "as_of_ts", "value"])
    return keep_last(rows, ["event_ts"], [F.col("as_of_ts"), F.col("value")]).select(F.unix_micros("event_ts").alias("e"), "value")


@add("SNK09_export_trades", "SELECT (SELECT count(*) FROM (SELECT DISTINCT id, coin, side, qty FROM trades)) AS n, 0 AS n_empty, (SELECT sum(CAST(CAST(qty AS VARCHAR) AS DECIMAL(38,9))) FROM (SELECT DISTINCT id, coin, side, qty FROM trades)) AS total")
def export_trades(spark, d):
    rows, path = table(spark, d, "trades").select("id", "coin", "side", "qty").distinct(), scratch(spark, "trades")
    n, none = export_csv(rows, path), export_csv(rows.limit(0), path + "-none")
    back = read_csv(spark, path, "id long, coin string, side string, qty double")
    return back.agg(F.count(F.lit(1)).alias("n"), F.lit(none).alias("n_empty"), F.sum(F.col("qty").cast("decimal(38,9)")).alias("total")).filter(F.col("n") == n)


@add("SRC02_index_scan", "SELECT DISTINCT epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, value FROM fng WHERE event_ts BETWEEN TIMESTAMPTZ '2024-05-31 00:00:00+00' AND TIMESTAMPTZ '2024-06-30 00:00:00+00' AND as_of_ts <= TIMESTAMPTZ '2024-06-30 00:00:00+00'")
def index_scan(spark, d):
    """A single-file store, read typed, and its last 30 days as known on a date."""
    from ..operators.pit import known_at
    from ..sources.stores import INDEX

    at = F.expr("TIMESTAMP '2024-06-30'")
    rows = known_at(read_store(spark, f"{d}/fng.parquet", INDEX), at, F.expr("TIMESTAMP '2024-05-31'"), at)
    return rows.select(F.unix_micros("event_ts").alias("e"), F.unix_micros("as_of_ts").alias("a"), "value").distinct()


@add("SRC05_newest_log", "SELECT cycle_id, n_trades FROM cycles WHERE status = 'error' OR error_msg IS NOT NULL")
def newest_log(spark, d):
    """Of several logs in a folder the one written last counts."""
    path = scratch(spark, "logs")
    rows = table(spark, d, "cycles").select("cycle_id", "n_trades", "status", "error_msg")
    rows.limit(1).select("cycle_id", F.lit(-1).alias("n_trades")).write.mode("append").json(path)
    rows.filter("status = 'error' OR error_msg IS NOT NULL").select("cycle_id", "n_trades").repartition(1).write.mode("append").option("ignoreNullFields", "false").json(path)
    return read_newest(spark, path, "cycle_id string, n_trades int")


@add("STM01_daily_cycle", "SELECT count(*) AS n FROM (SELECT DISTINCT id, epoch_us(as_of_ts) AS a FROM news WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL)")
def daily_cycle(spark, d):
    """News by files, in one run over what is there, upserted into a store batch by batch."""
    from ..sources.stores import NEWS

    incoming, root, state = scratch(spark, "in"), scratch(spark, "news"), scratch(spark, "checkpoint")
    table(spark, d, "news").dropna(subset=["event_ts", "as_of_ts"]).repartition(3).write.parquet(incoming)
    stream = spark.readStream.schema(NEWS).option("maxFilesPerTrigger", 1).parquet(incoming)
    into_store(stream, state, lambda batch, _id: upsert(batch.sparkSession, batch, root, NEWS, ["id", "as_of_ts"], "event_ts")).awaitTermination()
    return read_store(spark, root, NEWS).agg(F.count(F.lit(1)).alias("n"))


# --- journal look-ups and small tools


@add("TOL05_first_seen", f"SELECT {_COIN} AS coin, metric, source, epoch_us(event_ts) AS e, arg_min(reading_id, (epoch_us(as_of_ts), reading_id)) AS reading_id FROM onchain WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL GROUP BY ALL")
def first_seen(spark, d):
    """Of overlapping pulls, each time stamp's row that was seen first."""
    rows = table(spark, d, "onchain").dropna(subset=["event_ts", "as_of_ts"]).withColumn("coin", clean_name("coin"))
    return rows.groupBy("coin", "metric", "source", F.unix_micros("event_ts").alias("e")).agg(F.min_by("reading_id", F.struct("as_of_ts", "reading_id")).alias("reading_id"))


@add("TOL06_refresh_window", f"WITH r AS (SELECT {_COIN} AS coin, metric, source, CAST(floor(epoch_us(event_ts) / 86400000000.0) AS INTEGER) AS d FROM onchain WHERE event_ts IS NOT NULL), s AS (SELECT coin, metric, source, max(d) AS last, count(DISTINCT d) AS n FROM r GROUP BY ALL) SELECT coin, metric, source, strftime(DATE '1970-01-01' + (last - CASE WHEN n < 60 THEN 60 ELSE 2 END), '%Y-%m-%d') AS since FROM s")
def refresh_window(spark, d):
    """Day from which each series is fetched again: two days back, or 60 where it has fewer than 60 days."""
    rows = table(spark, d, "onchain").filter("event_ts IS NOT NULL").select(clean_name("coin").alias("coin"), "metric", "source", day_number(F.col("event_ts")).alias("d"))
    s = rows.distinct().groupBy("coin", "metric", "source").agg(F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
    return s.select("coin", "metric", "source", day_text(F.col("last") - F.when(F.col("n") < 60, 60).otherwise(2)).alias("since"))


@add("TOL08_forecasts", "SELECT DISTINCT id, pred_quantile_high - pred_quantile_low AS width, CASE WHEN pred_quantile_low > 0 THEN 'up' WHEN pred_quantile_high < 0 THEN 'down' ELSE 'unsure' END AS direction FROM predictions")
def forecasts(spark, d):
    way = F.when(F.col("pred_quantile_low") > 0, "up").when(F.col("pred_quantile_high") < 0, "down").otherwise("unsure")
    return table(spark, d, "predictions").select("id", (F.col("pred_quantile_high") - F.col("pred_quantile_low")).alias("width"), way.alias("direction")).distinct()


@add("TOL12_window_metrics", f"WITH {BARS}, p AS (SELECT symbol, date, close, row_number() OVER w AS i FROM bars WINDOW {W}), s AS (SELECT symbol, date, i, close / lag(close) OVER w - 1 AS x FROM p WINDOW {W}), k AS (SELECT * FROM s WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND i > 1) SELECT symbol, count(*) AS n, round(avg(x), 6) AS mean, round(exp(sum(ln(1 + x))) - 1, 4) AS total FROM k GROUP BY 1")
def window_metrics(spark, d):
    """Metrics of a slice of a path, worked out again from the changes within it; the path's first bar has no change."""
    s = bars(spark, d).select("symbol", "date", pct_change("close", S).alias("x")).filter("x IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x"), 6).alias("mean"), r(F.exp(F.sum(F.ln(1 + F.col("x")))) - 1).alias("total"))


@add("TOL14_cost_grid", f"WITH {RETURNS}, s AS (SELECT symbol, ret, sign(lag(ret) OVER w) AS x, sign(lag(ret, 2) OVER w) AS y FROM returns WINDOW {W}) SELECT symbol, g.bps, round(sum(x * ret - abs(x - coalesce(y, 0)) * g.bps / 1e4), 6) AS net FROM s, (VALUES (0), (5), (10), (20), (50)) g(bps) WHERE x IS NOT NULL GROUP BY ALL")
def cost_grid(spark, d):
    """Net sum of a signal's returns for a grid of costs a change of position, in basis points."""
    rows = returns(spark, d).select("symbol", "ret", F.signum(F.lag("ret").over(S.w)).alias("x"), F.signum(F.lag("ret", 2).over(S.w)).alias("y")).filter("x IS NOT NULL")
    cells = rows.select("*", F.explode(F.array(*map(F.lit, (0, 5, 10, 20, 50)))).alias("bps"))
    return cells.groupBy("symbol", "bps").agg(r(F.sum(F.col("x") * F.col("ret") - F.abs(F.col("x") - F.coalesce("y", F.lit(0.0))) * F.col("bps") / 1e4), 6).alias("net"))


@add("TOL19_latest_cycle", "SELECT arg_max(cycle_id, (epoch_us(loaded_ts), cycle_id)) AS cycle_id, count(*) FILTER (error_msg IS NOT NULL AND error_msg <> '') AS n_errors FROM cycles WHERE loaded_ts IS NOT NULL")
def latest_cycle(spark, d):
    rows = table(spark, d, "cycles").filter("loaded_ts IS NOT NULL")
    return rows.agg(F.max_by("cycle_id", F.struct("loaded_ts", "cycle_id")).alias("cycle_id"), F.count_if(F.col("error_msg").isNotNull() & (F.col("error_msg") != "")).alias("n_errors"))
