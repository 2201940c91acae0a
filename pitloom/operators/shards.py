"""Time shards: a long series is cut into shards of fixed width, so that no series has to fit into one task.

Every shard is worked on by itself. What a shard must know of the others is small (its edge rows or its totals) and
is carried over by a window over one summary row a shard, never over the rows themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SHARD = "_shard"
DAY_US = 86_400_000_000
#: A shard with more rows than this, and more than a thousandth of all, is cut further, at borders between SLICES equal slices.
MOST, HOT_SHARE, SLICES = 1_000_000, 1000, 2048


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 in UTC, whatever the session's time zone."""
    return F.floor(F.unix_seconds(ts) / F.lit(86_400)).cast("int")


def clean_name(c: Column | str) -> Column:
    """Trimmed, in lower case; white space of any kind counts."""
    return F.lower(F.regexp_replace(c if isinstance(c, Column) else F.col(c), r"^\s+|\s+$", ""))


def day_text(day: Column) -> Column:
    """yyyy-MM-dd of a day number."""
    return F.date_add(F.to_date(F.lit("1970-01-01")), day).cast("string")


def usable_readings(df: DataFrame, value: str = "value") -> DataFrame:
    """Readings that have both times and a value that is a number."""
    v = F.col(value)
    ok = F.col("event_ts").isNotNull() & F.col("as_of_ts").isNotNull() & v.isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        ok = ok & ~F.isnan(v)
    return df.filter(ok)


class TimeShards:
    """Shards of (keys, time): of a fixed number of days each, and cut further by volume where they hold many rows.

    tables: (rows, microseconds) of all tables that will be sharded together. The rows of each shard are counted first (combined
    before the shuffle). A hot one, of which there are fewer than a thousand by definition, is cut into slices between
    its first and last time, and neighbouring slices are put together up to about the limit each. Shard numbers grow with time
    within a series, also where a key is NULL. Without `days` a series is one shard unless it is hot. `split`: whether any shard is cut.
    """

    def __init__(self, tables: list[tuple[DataFrame, Column]], keys: list[str], days: int | None, most: int = MOST) -> None:
        self.keys, self.days = keys, days
        rows = reduce(DataFrame.unionByName, [df.select(*keys, t.alias("_us")) for df, t in tables]).withColumn("_base", self._base(F.col("_us")))
        by = [*keys, "_base"]
        inside = F.when(F.abs("_us") < 2**60, F.col("_us"))  # marks for times before or after all others don't stretch the slices
        counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(inside).alias("_lo"), F.max(inside).alias("_hi"))
        total, largest = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
        limit = max(most, total // HOT_SHARE)
        self.split = largest > limit
        if not self.split:
            return
        hot = stage(counts.filter(F.col("_n") > limit).withColumn("_lo", F.coalesce("_lo", F.lit(0))).select(*by, "_lo", (F.floor((F.coalesce("_hi", F.lit(0)) - F.col("_lo")) / SLICES) + 1).alias("_wide"), F.greatest(F.lit(limit), F.col("_n") / (SLICES - 1)).alias("_each")))
        filled = self._match(rows, hot).groupBy(*by, self._slice().alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
        spine = hot.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        both = spine.withColumn("_n", F.lit(0).cast("long")).unionByName(filled, allowMissingColumns=True)
        slices = both.groupBy(*by, "_slice").agg(F.sum("_n").alias("_n"), *[F.max(c).alias(c) for c in ("_lo", "_wide", "_each")])
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = slices.withColumn("_part", F.least(F.floor(before / F.col("_each")), F.lit(SLICES - 1)).cast("int"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_slice", "_part"))), lambda x: x["_part"])
        self.table = stage(cut.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("_lo", "_wide")], parts.alias("_parts")))

    def _base(self, us: Column) -> Column:
        return F.lit(0).cast("long") if self.days is None else F.floor(us / F.lit(self.days * DAY_US)).cast("long")

    def _slice(self) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor((F.col("_us") - F.col("_lo")) / F.col("_wide")))).cast("int")

    def _match(self, df: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
        """Joins the rows of hot shards; fewer than a thousand rows of about 8 KB, so `hot` may be broadcast."""
        by = [*self.keys, "_base"]
        other = hot.select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(by)], *[c for c in hot.columns if c not in by])
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hot{i}")) for i, c in enumerate(by)])
        return df.join(F.broadcast(other), on, how).drop(*[f"_hot{i}" for i in range(len(by))])

    def add(self, df: DataFrame, us: Column) -> DataFrame:
        """df with its shard as the column SHARD. Rows with a NULL time get the shard NULL."""
        rows = df.withColumn("_us", us).withColumn("_base", self._base(F.col("_us")))
        if not self.split:
            return rows.withColumn(SHARD, F.col("_base")).drop("_us", "_base")
        part = F.coalesce(F.get("_parts", self._slice()), F.lit(0))
        return self._match(rows, self.table, "left").withColumn(SHARD, F.col("_base") * SLICES + part).drop("_us", "_base", "_lo", "_wide", "_parts")


def hot_groups(counts: DataFrame, n: str, most: int = MOST) -> DataFrame | None:
    """The groups that hold more than `most` and more than a thousandth of all rows, with the number of parts that brings each part
    below that: counts' other columns and `_salts`, fewer than a thousand rows. None if there is no such group."""
    total, largest = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(most, total // HOT_SHARE)
    if largest <= limit:
        return None
    return stage(counts.filter(F.col(n) > limit).withColumn("_salts", F.ceil(F.col(n) / limit).cast("int")).drop(n))


def with_edges(df: DataFrame, keys: list[str], order: list[str], carried: list[str], n: int) -> DataFrame:
    """Adds `_before` and `_after`: arrays of structs of `carried`, the n rows just outside the row's shard.

    df has the column SHARD. A shard that holds rows holds at least one, so the n nearest non-empty shards on either side
    always contain the n nearest rows.
    """
    within = Window.partitionBy(*keys, SHARD)
    ranked = df.withColumn("_rn", F.row_number().over(within.orderBy(*order))).withColumn("_cnt", F.count(F.lit(1)).over(within))
    row = F.struct("_rn", *carried)
    edges = (
        ranked.filter((F.col("_rn") <= n) | (F.col("_rn") > F.col("_cnt") - n))
        .groupBy(*keys, SHARD)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_rn") <= n, row))).alias("_first"),
            F.sort_array(F.collect_list(F.when(F.col("_rn") > F.col("_cnt") - n, row))).alias("_last"),
        )
    )
    along = Window.partitionBy(*keys).orderBy(SHARD)
    before = F.flatten(F.collect_list("_last").over(along.rowsBetween(-n, -1)))
    after = F.flatten(F.collect_list("_first").over(along.rowsBetween(1, n)))
    carry = edges.select(
        *keys, SHARD,
        F.when(F.size(before) > n, F.slice(before, -n, n)).otherwise(before).alias("_before"),
        F.slice(after, 1, n).alias("_after"),
    )
    return ranked.join(carry, [*keys, SHARD])


def micros(df: DataFrame, c: str) -> Column:
    """An order column as a whole number: microseconds of times and dates, else its own value."""
    kind = dict(df.dtypes)[c]
    x = F.col(c)
    return F.unix_micros(x.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz") else F.unix_date(x).cast("long") * DAY_US if kind == "date" else F.floor(x).cast("long")


def _join_shards(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, SHARD]
    other = carry.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in carry.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    return rows.join(other, on, "left").drop(*[f"_by{i}" for i in range(len(by))])


def last_known(rows: DataFrame, keys: list[str], columns: list[str], order: list[str], most: int = MOST) -> DataFrame:
    """rows with each column replaced by its last value that is not NULL up to the row, by `order`, of which the first is a time.

    A key with more than `most` rows is cut into shards by time; what the shards before know is carried in, one row a shard.
    """
    us = micros(rows, order[0])
    shards = TimeShards([(rows, us)], keys, None, most)
    by = keys if not shards.split else [*keys, SHARD]
    if shards.split:
        rows = shards.add(rows, us)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    if not shards.split:
        return filled
    ends = rows.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_end{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, *[F.last(f"_end{i}", ignorenulls=True).over(before).alias(f"_in{i}") for i in range(len(columns))])
    joined = _join_shards(filled, carry, keys)
    return joined.withColumns({c: F.coalesce(c, f"_in{i}") for i, c in enumerate(columns)}).drop(SHARD, *[f"_in{i}" for i in range(len(columns))])


def running_total(rows: DataFrame, keys: list[str], x: str, order: list[str], name: str, most: int = MOST) -> DataFrame:
    """rows with the sum of x up to each row; keys with more than `most` rows are cut into shards by time, as in last_known."""
    us = micros(rows, order[0])
    shards = TimeShards([(rows, us)], keys, None, most)
    by = keys if not shards.split else [*keys, SHARD]
    if shards.split:
        rows = shards.add(rows, us)
    own = rows.withColumn(name, F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not shards.split:
        return own
    before = Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*by).agg(F.sum(x).alias("_sum")).select(*by, F.sum("_sum").over(before).alias("_in"))
    return _join_shards(own, carry, keys).withColumn(name, F.col(name) + F.coalesce("_in", F.lit(0))).drop(SHARD, "_in")


_NULL = "\x00null"


def mark_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    """Text keys with NULL written as a mark, so that joins keep series whose key is NULL; unmark_nulls takes it back."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(_NULL)) for k in keys if dict(df.dtypes)[k] == "string"})


def unmark_nulls(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({k: F.nullif(F.col(k), F.lit(_NULL)) for k in keys if dict(df.dtypes)[k] == "string"})
