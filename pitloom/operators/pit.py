"""Bitemporal queries: what was known at a time, the latest of it, and as-of alignment on any order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shards import MOST, last_known


def known_at(df: DataFrame, as_of, event_from=None, event_to=None, event_ts: str = "event_ts", as_of_ts: str = "as_of_ts") -> DataFrame:
    """All revisions visible at `as_of` whose event time lies in the range (both ends in). NULL times are never visible."""
    out = df.filter(F.col(as_of_ts) <= F.lit(as_of))
    if event_from is not None:
        out = out.filter(F.col(event_ts) >= F.lit(event_from))
    return out if event_to is None else out.filter(F.col(event_ts) <= F.lit(event_to))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. With a full order the result doesn't depend on the partitioning."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def has_token(listed: Column | str, token: str, separator: str = ",") -> Column:
    """Whether a separated list in a string holds exactly this token, spaces around tokens aside."""
    items = F.transform(F.split(listed, separator), lambda x: F.trim(x))
    return F.array_contains(items, token)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, right_order: list[str], carried: list[str], most: int = MOST) -> DataFrame:
    """Each left row with `carried` of the last right row at or before its time; NULLs where there is none.

    Both sides are merged in one sorted pass: no range join. Ties on the right go to the last by `right_order`. The left
    row is kept whole; left columns must not be named like carried ones. A key with more than `most` rows is merged in several parts.
    """
    l = left.select(F.struct(*left.columns).alias("_l"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_ts).alias("_t"), F.lit(1).alias("_side"))
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)], F.struct(*carried).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_o{i}" for i in range(len(right_order))]]
    return last_known(both, [f"_k{i}" for i in range(len(keys))], ["_r"], order, most).filter("_side = 1").select("_l.*", "_r.*")


def calendar_gaps(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Days between a key's first and last day on which it has no row."""
    seen = df.select(*keys, F.col(day).alias("day")).distinct()
    span = seen.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day")).join(seen, [*keys, "day"], "left_anti")


def drop_head_of_runs(df: DataFrame, keys: list[str], index: str, head: int) -> DataFrame:
    """Drops the first `head` rows of every run of consecutive index values (an embargo after each gap)."""
    w = Window.partitionBy(*keys).orderBy(index)
    run = df.withColumn("_run", F.col(index) - F.row_number().over(w))
    return run.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(index))).filter(F.col("_at") > head).drop("_run", "_at")


def wide_as_of(readings: DataFrame, dates: Column, keys: list[str], metrics: list[str], as_of_ts: str, order: list[str], value: str = "value", metric: str = "metric", date: str = "date", most: int = MOST) -> DataFrame:
    """One row per key and date with the last value of each metric known by then: all metrics in one sorted pass, in several
    parts where a key has more than `most` rows.

    dates: an array of timestamps, asked of every key. A metric not known yet is NULL. Values never go stale.
    """
    cols = [F.when(F.col(metric) == m, F.struct(F.col(value).alias("v"))).alias(f"_m{i}") for i, m in enumerate(metrics)]
    facts = readings.filter(F.col(metric).isin(metrics)).select(*keys, F.col(as_of_ts).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *cols)
    asked = facts.select(*keys).distinct().select(*keys, F.explode(dates).alias("_t"), F.lit(1).alias("_side"))
    both = facts.unionByName(asked, allowMissingColumns=True)
    known = last_known(both, keys, [f"_m{i}" for i in range(len(metrics))], ["_t", "_side", *[f"_o{i}" for i in range(len(order))]], most)
    filled = known.select(*keys, "_t", "_side", *[F.col(f"_m{i}")["v"].alias(m) for i, m in enumerate(metrics)])
    return filled.filter("_side = 1").select(*keys, F.col("_t").alias(date), *metrics)


def walk_forward_folds(rows: DataFrame, date: str, every: int, minimum: int, purge: int, window: int | None) -> DataFrame:
    """Folds of a walk-forward fit: fold_date, n_train. A fold trains on the rows at least `purge` days before it (so that no label
    reaches into it) and, with a window, at most that many days before that; folds with fewer rows than `minimum` drop out.

    Counts per day are summed by running totals, so no pair of fold and row is made.
    """
    day = F.unix_date(date)
    counts = rows.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    every_day = span.select(F.explode(F.sequence("a", "b")).alias("d"), (F.col("a")).alias("a")).join(counts, "d", "left")
    w = Window.orderBy("d")  # one row a day
    last = w.rowsBetween(Window.unboundedPreceding, -purge)
    frame = last if window is None else w.rowsBetween(-purge - window + 1, -purge)
    folds = every_day.withColumn("n_train", F.coalesce(F.sum("n").over(frame), F.lit(0))).filter(F.col("n").isNotNull() & ((F.col("d") - F.col("a")) % every == 0))
    return folds.filter(F.col("n_train") >= minimum).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias("fold_date"), "n_train")
