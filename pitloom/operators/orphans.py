"""References to records that do not exist (problem 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shards import hot_groups

#: Times are moved by this many microseconds before the merge: a parent may be loaded so much later than its reference.
DAY = 86_400 * 1_000_000
#: A key with more references than this, and more than a thousandth of all, is spread over as many parts as bring it below that.
HOT_REFERENCES = 200_000


def reference_status(references: DataFrame, parents: DataFrame, grace_us: int = DAY, hot: int = HOT_REFERENCES) -> DataFrame:
    """Says of each reference whether its parent stood at that time: ok, missing, deleted or late.

    references: space string, key string, child_table, child_id, logged_ts. parents: space, key, loaded_ts, deleted_ts.
    A parent stands for a reference logged from loaded_ts minus the grace until just before deleted_ts (NULL: for ever).
    `deleted`: some parent had been loaded in time, none stands any more. `late`: parents came too late. `missing`:
    there is no parent of that key at all.

    Method: validity intervals become two events, start and end. Events and references are co-partitioned on the key and
    sorted by time; one linear merge counts starts and ends up to each reference. Neither side of a key is collected.
    Keys that hold many references are salted, with as many salts as their number asks for: their references are spread and
    their (already merged) events repeated for each salt. There are fewer than a thousand such keys by definition, so
    their list may be broadcast. A key's events are not split: they are its distinct load and delete times.

    References whose key is NULL or blank are no references and give no row. A reference with a NULL time can't be in
    any interval: `missing` or `late`. Parents with a NULL key or load time, or deleted before they could count, give no
    interval but do exist. Repeated rows on either side change nothing; the result holds each reference once.
    """
    refs = references.filter(F.col("key").isNotNull() & (F.col("key") != "")).select("space", "key", "child_table", "child_id", "logged_ts").distinct()
    hot_keys = hot_groups(refs.groupBy("space", "key").agg(F.count(F.lit(1)).alias("_refs")), "_refs", hot)

    start, end = F.unix_micros("loaded_ts") - grace_us, F.unix_micros("deleted_ts")
    known = parents.filter(F.col("key").isNotNull()).select("space", "key", start.alias("_s"), end.alias("_e"))
    empty = F.col("_s").isNull() | (F.col("_e").isNotNull() & (F.col("_e") <= F.col("_s")))
    event = lambda t, s, e: F.struct(t.alias("_t"), s.alias("_starts"), e.alias("_ends"))
    zero, one = F.lit(0), F.lit(1)
    first, beyond = F.lit(-(2**62)), F.lit(2**62)
    events = (
        known.distinct()
        .select("space", "key", F.explode(F.array(event(first, zero, zero), event(F.when(empty, beyond).otherwise(F.col("_s")), F.when(empty, zero).otherwise(one), zero), event(F.when(empty, beyond).otherwise(F.coalesce("_e", beyond)), zero, F.when(empty | F.col("_e").isNull(), zero).otherwise(one)))).alias("_x"))
        .select("space", "key", "_x.*")
        .groupBy("space", "key", "_t")
        .agg(F.sum("_starts").alias("_starts"), F.sum("_ends").alias("_ends"))
    )
    if hot_keys is None:
        salted_events, salted_refs = events.withColumn("_salt", F.lit(0)), refs.withColumn("_salt", F.lit(0))
    else:
        known_hot = F.broadcast(hot_keys)  # fewer than a thousand keys
        salted_events = events.join(known_hot, ["space", "key"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        salted_refs = refs.join(known_hot, ["space", "key"], "left").withColumn("_salt", F.pmod(F.xxhash64("child_table", "child_id", "logged_ts"), F.coalesce("_salts", F.lit(1))).cast("int"))

    none = lambda kind: F.lit(None).cast(kind)
    types = dict(refs.dtypes)
    merged = salted_events.select("space", "key", "_salt", "_t", F.lit(0).alias("_side"), "_starts", "_ends", *[none(types[c]).alias(c) for c in ("child_table", "child_id", "logged_ts")]).unionByName(
        salted_refs.select("space", "key", "_salt", F.coalesce(F.unix_micros("logged_ts"), F.lit(-(2**61))).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_starts"), F.lit(0).cast("long").alias("_ends"), "child_table", "child_id", "logged_ts")
    )
    so_far = Window.partitionBy("space", "key", "_salt").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (
        merged.withColumn("_started", F.sum("_starts").over(so_far)).withColumn("_ended", F.sum("_ends").over(so_far)).withColumn("_parents", F.max(F.col("_side") == 0).over(so_far))
    ).filter(F.col("_side") == 1)
    status = F.when(F.col("_started") > F.col("_ended"), "ok").when(F.col("_started") > 0, "deleted").when(F.col("_parents"), "late").otherwise("missing")
    return counted.select("child_table", "child_id", "space", "key", "logged_ts", status.alias("status"))


def blank_to_null(key: Column) -> Column:
    """Keys compare trimmed and without regard to case; a blank one is none."""
    return F.nullif(F.lower(F.regexp_replace(key.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def month_text(ts: Column) -> Column:
    """yyyy-MM in UTC, whatever the session's time zone."""
    return F.substring(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(F.unix_seconds(ts) / 86_400).cast("int")).cast("string"), 1, 7)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphan_report(status: DataFrame) -> DataFrame:
    """Per child table and month: references in all, and how many are ok, missing, deleted and late."""
    kinds = [F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("ok", "missing", "deleted", "late")]
    return status.groupBy("child_table", month_text(F.col("logged_ts")).alias("period")).agg(F.count(F.lit(1)).alias("n_references"), *kinds)
