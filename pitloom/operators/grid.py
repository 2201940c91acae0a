"""Irregular readings onto a daily grid (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shards import MOST, SHARD, SLICES, TimeShards, day_number


def regular_grid(
    df: DataFrame, keys: list[str], value: str = "value", event_ts: str = "event_ts", tie: tuple[str, ...] = ("as_of_ts", "reading_id"), shard_days: int = 128, most: int = MOST
) -> DataFrame:
    """One row per series and day from its first to its last reading; days without a reading are marked and filled.

    Columns: the keys, `day` (number of days since 1970), `n_readings` (distinct event times of the day), `missing`,
    `value` (of the day's last reading, else carried forward from the last day that has one) and `value_day`.

    Method: each series is cut into time shards. A shard's first and last days are its summary; the last reading
    before a shard is found by a scan over these summaries and carried in; then all shards are filled independently. Where a
    shard holds more than `most` readings, these are brought down to days in several parts.

    Rows whose event time or value is NULL or NaN must be left out before (`usable_readings`); rows with a NULL event time are
    skipped here as they have no place on the grid. Among readings of one event time the greatest by `tie` counts, so
    repeated rows change nothing. NULL keys form a series of their own. An empty table gives no rows; other columns are ignored.
    """
    reading = F.struct(F.col(event_ts).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)], F.col(value).alias("v"))
    rows = df.filter(F.col(event_ts).isNotNull()).select(*keys, F.col(event_ts).alias("_t"), day_number(F.col(event_ts)).alias("_day"), reading.alias("_r"))
    us = F.unix_micros("_t")
    shards = TimeShards([(rows, us)], keys, shard_days, most)
    rows = shards.add(rows, us).repartition(*keys, SHARD)
    by = [*keys, SHARD]
    daily = rows.groupBy(*by, "_day", "_t").agg(F.max("_r").alias("_r")).groupBy(*by, "_day").agg(F.count(F.lit(1)).alias("_n"), F.max("_r").alias("_r"))
    if shards.split:  # a day can be spread over several parts of a shard
        daily = daily.withColumn(SHARD, F.floor(F.col(SHARD) / SLICES)).repartition(*by).groupBy(*by, "_day").agg(F.sum("_n").alias("_n"), F.max("_r").alias("_r"))
    daily = daily.select(*by, "_day", "_n", F.col("_r.v").alias("_v"))

    following = F.lead("_day").over(Window.partitionBy(*by).orderBy("_day"))
    inside = daily.withColumn("_to", F.coalesce(following - 1, F.col("_day"))).select(
        *keys, F.explode(F.sequence("_day", "_to")).alias("day"), F.col("_day").alias("value_day"), F.col("_v").alias("value"), "_n"
    )

    # first and last are separate columns, so that both readers of the shuffled rows prune alike and share one shuffle
    summary = daily.groupBy(*by).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"), F.max_by("_v", "_day").alias("_v"))
    along = Window.partitionBy(*keys).orderBy(SHARD)
    between = (
        summary.select(*keys, "_first", (F.lag("_last").over(along)).alias("_in"), F.lag("_v").over(along).alias("_v"))
        .filter(F.col("_in") + 1 < F.col("_first"))
        .select(*keys, F.explode(F.sequence(F.col("_in") + 1, F.col("_first") - 1)).alias("day"), F.col("_in").alias("value_day"), F.col("_v").alias("value"), F.lit(0).cast("long").alias("_n"))
    )
    missing = F.col("day") != F.col("value_day")
    return inside.unionByName(between).select(*keys, "day", F.when(missing, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("n_readings"), missing.alias("missing"), "value", "value_day")
