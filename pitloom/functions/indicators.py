"""Technical indicators over bars: symbol, date, open, high, low, close, volume. Textbook definitions.

Those that depend on their own past (MACD, ADX, KDJ) are folds of a series of daily bars; the others are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold_series
from .windows import Series, rolling_mean, rolling_sum

BARS = Series(("symbol",), ("date",))


def _fields(**values: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])


def _folded(rows: DataFrame, value: Column, zero: Column, step, out, name: str) -> DataFrame:
    """A fold over a struct of several columns of each bar: symbol, date and the fields of `out`."""
    folded = fold_series(rows.select("symbol", "date", value.alias("_v")), ["symbol"], "date", "_v", zero, step, out, name)
    return folded.select("symbol", "date", f"{name}.*")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macds, macdh: the difference of two exponential means of the close (from the first close on), the exponential mean of
    that (from 0 on), and the difference of both."""
    null = F.lit(None).cast("double")

    def step(s: Column, v: Column) -> Column:
        mean = lambda old, n: F.when(s[old].isNull(), v["x"]).otherwise(s[old] + (v["x"] - s[old]) * (2.0 / (n + 1)))
        f, w = mean("f", fast), mean("w", slow)
        return _fields(f=f, w=w, m=s["m"] + (f - w - s["m"]) * (2.0 / (signal + 1)))

    rows = bars.filter("close IS NOT NULL")
    return _folded(rows, _fields(x=F.col("close")), _fields(f=null, w=null, m=F.lit(0.0)), step, lambda s: _fields(macd=s["f"] - s["w"], macds=s["m"], macdh=s["f"] - s["w"] - s["m"]), "_o")


def directional(bars: DataFrame, n: int = 14) -> DataFrame:
    """pdi, mdi, adx: Wilder's directional movement; smoothed from the second bar on, by a factor of 1/n. 0 where nothing moves."""
    p = lambda c: F.lag(c).over(BARS.w)
    up, down = F.col("high") - p("high"), p("low") - F.col("low")
    moves = bars.select(
        "symbol", "date", F.when((up > down) & (up > 0), up).otherwise(0.0).alias("u"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("d"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p("close")), F.abs(F.col("low") - p("close"))).alias("t"), p("close").alias("_p"),
    ).filter("_p IS NOT NULL")
    part = lambda a, b: F.coalesce(F.try_divide(100 * a, F.nullif(b, F.lit(0.0))), F.lit(0.0))

    def step(s: Column, v: Column) -> Column:
        u, d, t = (s[k] + (v[k] - s[k]) / n for k in "udt")
        x = part(F.abs(u - d), u + d)
        return _fields(u=u, d=d, t=t, a=s["a"] + (x - s["a"]) / n)

    return _folded(moves, F.struct("u", "d", "t"), _fields(u=F.lit(0), d=F.lit(0), t=F.lit(0), a=F.lit(0)), step, lambda s: _fields(pdi=part(s["u"], s["t"]), mdi=part(s["d"], s["t"]), adx=s["a"]), "_o")


def stochastic(bars: DataFrame, n: int = 9) -> DataFrame:
    """kdjk, kdjd, kdjj: the close within the range of the last n bars (fewer at the start), smoothed twice by a third, from 50 on."""
    low, high = F.min("low").over(BARS.last(n)), F.max("high").over(BARS.last(n))
    rows = bars.select("symbol", "date", F.coalesce(F.try_divide(100 * (F.col("close") - low), F.nullif(high - low, F.lit(0.0))), F.lit(50.0)).alias("x"))

    def step(s: Column, v: Column) -> Column:
        k = s["k"] + (v["x"] - s["k"]) / 3
        return _fields(k=k, d=s["d"] + (k - s["d"]) / 3)

    return _folded(rows, F.struct("x"), _fields(k=F.lit(50), d=F.lit(50)), step, lambda s: _fields(kdjk=s["k"], kdjd=s["d"], kdjj=3 * s["k"] - 2 * s["d"]), "_o")


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def commodity_channel(bars: DataFrame, n: int = 20) -> DataFrame:
    """cci: distance of the typical price to its mean over n bars, in 0.015 mean absolute deviations; NULL where these are 0."""
    rows = bars.withColumn("_t", typical())
    seen = rows.select("symbol", "date", "_t", rolling_mean("_t", BARS, n).alias("_m"), F.collect_list("_t").over(BARS.last(n)).alias("_l"))
    spread = F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / n
    return seen.select("symbol", "date", F.when(spread > 1e-9, (F.col("_t") - F.col("_m")) / (0.015 * spread)).alias("cci"))


def money_flow(bars: DataFrame, n: int = 14) -> DataFrame:
    """mfi: part of the money (typical price by volume) of the last n changes that moved up, in percent."""
    rows = bars.withColumn("_t", typical()).withColumn("_c", F.col("_t") - F.lag("_t").over(BARS.w)).filter("_c IS NOT NULL")
    flow = rows.select("symbol", "date", F.when(F.col("_c") > 0, F.col("_t") * F.col("volume")).otherwise(0.0).alias("_u"), F.when(F.col("_c") < 0, F.col("_t") * F.col("volume")).otherwise(0.0).alias("_d"))
    up, down = rolling_sum("_u", BARS, n), rolling_sum("_d", BARS, n)
    return flow.select("symbol", "date", F.try_divide(100 * up, F.nullif(up + down, F.lit(0.0))).alias("mfi"))
