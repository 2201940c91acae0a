"""Late and out-of-order events (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .shards import MOST, SHARD, TimeShards, day_number, hot_groups

HOUR = 3_600_000_000


def period_and_close(event_ts: Column, period: str, slack_hours: int) -> tuple[Column, Column]:
    """First day of the event's period (a day number) and the period's close in microseconds; `period` is day or month, in UTC."""
    day = day_number(event_ts)
    if period == "day":
        start, end = day, day + 1
    elif period == "month":
        first = F.trunc(F.date_add(F.to_date(F.lit("1970-01-01")), day), "month")
        start, end = F.unix_date(first), F.unix_date(F.add_months(first, 1))
    else:
        raise ValueError("period is day or month")
    return start, end.cast("long") * (24 * HOUR) + slack_hours * HOUR


def k_slack(df: DataFrame, record_id: str, event_ts: str, as_of_ts: str, period: str, slack_hours: int, most: int = MOST) -> DataFrame:
    """Runs the arrivals of each period through its buffer, which is released once at the close: its end plus the slack.

    Columns: record_id, event_us, as_of_us, period_day (first day of the period, as a number), close_us, late. What arrives
    until the release, the close itself included, has been buffered and is released with it; what arrives behind it is `late`.
    Rows with a NULL in either time belong to no period and give no row; rows equal in id and both times are one arrival.

    Method: the release is an event of its own among the arrivals, which are merged in the order of their arrival. A period
    that holds more than `most` rows is spread over several buffers by record, each with the same release.
    """
    start, close = period_and_close(F.col(event_ts), period, slack_hours)
    rows = df.filter(F.col(event_ts).isNotNull() & F.col(as_of_ts).isNotNull()).select(F.col(record_id).alias("record_id"), F.unix_micros(event_ts).alias("event_us"), F.unix_micros(as_of_ts).alias("as_of_us"), start.alias("period_day"), close.alias("close_us"))
    periods = stage(rows.groupBy("period_day", "close_us").agg(F.count(F.lit(1)).alias("_n")))
    hot = hot_groups(periods.drop("close_us"), "_n", most)
    releases = periods.drop("_n")
    if hot is None:
        rows, releases = rows.withColumn("_salt", F.lit(0)), releases.withColumn("_salt", F.lit(0))
    else:
        hot = F.broadcast(hot)  # fewer than a thousand periods
        rows = rows.join(hot, "period_day", "left").withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
        releases = releases.join(hot, "period_day", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    kind = dict(rows.dtypes)["record_id"]
    release = releases.select(F.lit(None).cast(kind).alias("record_id"), F.lit(None).cast("long").alias("event_us"), F.col("close_us").alias("as_of_us"), "period_day", "close_us", "_salt", F.lit(True).alias("_release"))
    arrived = rows.withColumn("_release", F.lit(False)).unionByName(release).repartition("period_day", "_salt")
    so_far = Window.partitionBy("period_day", "_salt").orderBy("as_of_us", "_release").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = arrived.withColumn("late", F.max("_release").over(so_far)).filter(~F.col("_release"))
    once = run.groupBy("period_day", "_salt", "close_us", "record_id", "event_us", "as_of_us").agg(F.max("late").alias("late"))
    return once.select("record_id", "event_us", "as_of_us", "period_day", "close_us", "late")


def provisional_counts(arrivals: DataFrame, step_us: int = 24 * HOUR) -> DataFrame:
    """What is published from each period's buffer at the end of every step in which something came: period_day,
    published_us, n, final. Each record counts once in a period, from its first arrival on; what came late never counts."""
    first = arrivals.filter(~F.col("late")).groupBy("period_day", "close_us", "record_id").agg(F.min("as_of_us").alias("_a"))
    publish = (F.floor(F.col("_a") / step_us).cast("long") + 1) * step_us
    steps = first.groupBy("period_day", "close_us", F.least(publish, F.col("close_us")).alias("published_us")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("period_day").orderBy("published_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select("period_day", "published_us", F.sum("_n").over(upto).alias("n"), (F.col("published_us") == F.col("close_us")).alias("final"))


def released(arrivals: DataFrame) -> DataFrame:
    """The events that the buffers release: period_day, record_id, event_us. Of a record's several arrivals in time the last one counts."""
    return arrivals.filter(~F.col("late")).groupBy("period_day", "record_id").agg(F.max(F.struct("as_of_us", "event_us"))["event_us"].alias("event_us"))


def aggregate_released(events: DataFrame, most: int = MOST) -> DataFrame:
    """Per period, over its released events in the order of event time (ties by id): n, first_id, last_id, longest_gap_us.

    A period that holds more than `most` events is cut into parts by event time; each is sorted and aggregated by itself
    and the parts' summaries are joined in order.
    """
    events = stage(events)
    us = F.col("event_us")
    good = TimeShards([(events, us)], ["period_day"], None, most).add(events, us)
    w = Window.partitionBy("period_day", SHARD).orderBy("event_us", "record_id")
    gaps = good.withColumn("_gap", F.col("event_us") - F.lag("event_us").over(w))
    at = F.struct("event_us", "record_id")
    parts = gaps.groupBy("period_day", SHARD).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("_gap").alias("_gap"))
    along = Window.partitionBy("period_day").orderBy(SHARD)
    joined = parts.withColumn("_gap", F.greatest("_gap", F.col("_first.event_us") - F.lag("_last.event_us").over(along)))
    return joined.groupBy("period_day").agg(F.sum("_n").alias("n"), F.min("_first")["record_id"].alias("first_id"), F.max("_last")["record_id"].alias("last_id"), F.max("_gap").alias("longest_gap_us"))


def released_aggregates(arrivals: DataFrame, most: int = MOST) -> DataFrame:
    """Final values of each period: those of aggregate_released, and n_late, the arrivals behind the release. `arrivals`, the result of
    k_slack, is read twice: pass a staged table."""
    final = aggregate_released(released(arrivals), most)
    late = arrivals.filter("late").groupBy("period_day").agg(F.count(F.lit(1)).alias("n_late"))
    return final.join(late, "period_day", "full").select("period_day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_late", F.lit(0)).alias("n_late"), "first_id", "last_id", "longest_gap_us")
