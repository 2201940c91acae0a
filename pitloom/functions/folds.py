"""Ordered folds: results that depend on their own past, as a struct-state aggregate over sorted arrays in the JVM."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_series(df: DataFrame, keys: list[str], order: str, value: str, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column], Column], name: str) -> DataFrame:
    """For each series the state after every row. Adds `name`, out(state); a series must fit into one row (daily data)."""
    row = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    arrays = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = "struct<s:" + _type(df, zero) + ",out:array<" + _type(df, out(zero)) + ">>"
    folded = F.aggregate("_rows", F.struct(zero.alias("s"), F.array().cast("array<" + _type(df, out(zero)) + ">").alias("out")).cast(kind), lambda a, r: _next(a, r, step, out).cast(kind))
    both = arrays.select(*keys, F.inline(F.arrays_zip("_rows", folded["out"].alias("x"))))
    return both.select(*keys, F.col("_rows.o").alias(order), F.col("_rows.v").alias(value), F.col("x").alias(name))


def _next(a: Column, r: Column, step, out) -> Column:
    s = step(a["s"], r["v"])
    return F.struct(s.alias("s"), F.concat(a["out"], F.array(out(s))).alias("out"))


def _type(df: DataFrame, c: Column) -> str:
    return df.sparkSession.range(1).select(c.alias("c")).schema["c"].dataType.simpleString()


def exponential_mean(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """e = e + alpha * (x - e), from the first value on; a NULL value repeats the state."""
    null = F.lit(None).cast("double")
    return fold_series(df, keys, order, value, null, lambda e, x: F.when(e.isNull(), x.cast("double")).when(x.isNull(), e).otherwise(e + F.lit(alpha) * (x - e)), lambda e: e, name)


def smooth_labels(df: DataFrame, keys: list[str], order: str, value: str, window: int, name: str = "smooth") -> DataFrame:
    """Keeps a label until another one has come up `window` times in a row, which then takes over."""
    state = F.struct(F.lit(None).cast("string").alias("now"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        same, n = x == s["now"], F.when(x == s["next"], s["n"] + 1).otherwise(1)
        keep = lambda now, nxt, k: F.struct(now.alias("now"), nxt.alias("next"), k.cast("int").alias("n"))
        none = F.lit(None).cast("string")
        return F.when(s["now"].isNull(), keep(x, none, F.lit(0))).when(same | x.isNull(), keep(s["now"], none, F.lit(0))).when(n >= window, keep(x, none, F.lit(0))).otherwise(keep(s["now"], x, n))

    return fold_series(df, keys, order, value, state, step, lambda s: s["now"], name)


def expanding_quantile(df: DataFrame, keys: list[str], order: str, value: str, p: float, least: int, name: str = "quantile") -> DataFrame:
    """keys, order, value and the exact quantile (interpolated) of all earlier values of the series, NULL before `least` of them exist.

    Values are kept sorted, so each row costs a binary search, where a window would sort its growing frame again.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        seen: list[float] = []
        out = np.full(len(rows), np.nan)
        for i, x in enumerate(rows[value].to_numpy(dtype=float)):
            if len(seen) >= max(least, 1):
                at = p * (len(seen) - 1)
                lo = int(at)
                hi = min(lo + 1, len(seen) - 1)
                out[i] = seen[lo] * (lo + 1 - at) + seen[hi] * (at - lo)
            if not np.isnan(x):
                insort(seen, x)
        return rows.assign(**{name: out})  # NaN comes out as NULL

    kinds = dict(df.dtypes)
    columns = [*keys, order, value]
    return df.select(*columns).groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` double")
