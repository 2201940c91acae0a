"""Attributes as known at event time (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .shards import MOST, SHARD, TimeShards


def as_known_at(requests: DataFrame, readings: DataFrame, keys: list[str], attributes: list[str], request_id: str = "request_id", request_ts: str = "request_ts", event_ts: str = "event_ts", as_of_ts: str = "as_of_ts", tie: str = "reading_id", shard_days: int = 128, most: int = MOST) -> DataFrame:
    """Gives each request the reading that was known at its time, and none that became known later.

    A reading is known from the later of its two times on. Of all that are known at request_ts, the one with the
    greatest event time, then as_of time, then `tie` is given. Columns: request_id, the keys, `tie`, event_ts, as_of_ts
    and the attributes. A request before everything known gives no row.

    Method: along the time at which readings become known, a reading that beats all before it is a change; the running
    count of changes is the version number of the entity. Narrow rows (key, time) of changes and requests are merged to
    give each request its number, which joins on entity and number; the wide attributes are joined last, to the readings that
    were found. Series are cut into time shards (further where a shard holds more than `most` rows): numbers count within
    a shard, and the best version of earlier shards is carried in over one row a shard.

    Rows with a NULL in one of the times or NULL keys match nothing. Repeated rows change nothing (of rows that differ in
    attributes only, the greatest counts); requests that are equal in every column come out as often as they came in.
    Extra columns are ignored, also where names clash.
    """
    by = [*keys, SHARD]
    event_us, as_of_us = F.unix_micros(event_ts), F.unix_micros(as_of_ts)
    usable = readings.dropna(subset=[*keys, event_ts, as_of_ts])
    known = usable.select(*keys, F.greatest(event_us, as_of_us).alias("_t"), event_us.alias("_e"), as_of_us.alias("_a"), F.col(tie).alias("_i"))
    asked = requests.dropna(subset=[*keys, request_ts]).select(*keys, F.col(request_id).alias("_q"), F.unix_micros(request_ts).alias("_t"))
    shards = TimeShards([(known, F.col("_t")), (asked, F.col("_t"))], keys, shard_days, most)
    known, asked = shards.add(known, F.col("_t")).repartition(*by), shards.add(asked, F.col("_t"))

    order = Window.partitionBy(*by).orderBy("_t", "_e", "_a", "_i")
    rank = F.struct("_e", "_a", "_i")
    earlier = F.max(rank).over(order.rowsBetween(Window.unboundedPreceding, -1))
    changes = known.withColumn("_m", earlier).filter(F.col("_m").isNull() | (rank > F.col("_m"))).drop("_m")
    changes = stage(changes.withColumn("_version", F.row_number().over(order)))

    narrow = changes.select(*by, "_t", F.lit(1).alias("_change"), F.lit(None).cast(dict(asked.dtypes)["_q"]).alias("_q")).unionByName(asked.select(*by, "_t", F.lit(0).alias("_change"), "_q"))
    upto = Window.partitionBy(*by).orderBy("_t", F.desc("_change")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = narrow.withColumn("_version", F.coalesce(F.sum("_change").over(upto), F.lit(0)).cast("int")).filter(F.col("_change") == 0)
    own = numbered.join(changes.select(*by, "_version", rank.alias("_own")), [*by, "_version"], "left")

    best = changes.groupBy(*by).agg(F.max(rank).alias("_best"))
    wanted = asked.select(*by).distinct().withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType))
    every = best.unionByName(wanted).groupBy(*by).agg(F.max("_best").alias("_best"))
    before = F.max("_best").over(Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select(*by, before.alias("_carried")).filter(F.col("_carried").isNotNull())
    found = own.join(carried, by, "left").withColumn("_x", F.greatest("_own", "_carried")).filter(F.col("_x").isNotNull()).select("_q", *keys, "_x.*")
    named = [F.col("_q").alias(request_id), *keys, F.col("_i").alias(tie), F.timestamp_micros("_e").alias(event_ts), F.timestamp_micros("_a").alias(as_of_ts)]
    if not attributes:
        return found.select(*named)
    wide = usable.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], event_us.alias("_we"), as_of_us.alias("_wa"), F.col(tie).alias("_wi"), F.struct(*attributes).alias("_w"))
    wide = wide.groupBy(*[c for c in wide.columns if c != "_w"]).agg(F.max("_w").alias("_w"))
    same = (F.col("_e") == F.col("_we")) & (F.col("_a") == F.col("_wa")) & F.col("_i").eqNullSafe(F.col("_wi"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return found.join(wide, same).select(*named, "_w.*")
