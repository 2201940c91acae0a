"""Volume buckets over trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import MOST, running_total


def volume_buckets(trades: DataFrame, keys: list[str], ts: str, price: str, qty: str, sell: str, size: float, tie: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """Buckets of exactly `size` volume, trades split where they cross a border: keys, bucket, volume, buy, sell, notional.

    A trade occupies [c - q, c) of the running volume c, so its part in bucket g is an overlap of two intervals and no
    trade has to wait for the one before. The last bucket stays only if at least half full. Trades of one time are ordered by `tie`,
    then by price, size and side. The running volume of a key with more than `most` trades is summed in several parts.
    """
    order = list(dict.fromkeys([ts, *tie, price, qty, sell]))
    running = running_total(trades.filter(F.col(qty) > 0), keys, qty, order, "_b", most)
    placed = running.select(*keys, F.col(price).alias("_p"), F.col(sell).alias("_s"), (F.col("_b") - F.col(qty)).alias("_a"), "_b")
    first, last = F.floor(F.col("_a") / size), F.ceil(F.col("_b") / size) - 1
    parts = placed.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    share = F.greatest(F.lit(0.0), F.least(F.col("_b"), (F.col("bucket") + 1) * size) - F.greatest(F.col("_a"), F.col("bucket") * size))
    parts = parts.withColumn("_v", share)
    out = parts.groupBy(*keys, "bucket").agg(F.sum("_v").alias("volume"), F.sum(F.when(~F.col("_s"), F.col("_v")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("_s"), F.col("_v")).otherwise(0.0)).alias("sell"), F.sum(F.col("_v") * F.col("_p")).alias("notional"))
    return out.filter(F.col("volume") >= size / 2)


def order_imbalance(buckets: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Mean of |buy - sell| over the bucket size."""
    return buckets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_buckets"), (F.avg(F.abs(F.col("buy") - F.col("sell"))) / size).alias("vpin"))


def fast_buckets(trades: DataFrame, keys: list[str], ts: str, qty: str, sell: str, buckets: int, tie: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """Imbalance over `buckets` buckets without splitting: a trade counts where the running volume ends; buckets that stay empty
    count as 0, so the sum is divided by the number of buckets up to the last one."""
    all_of = trades.groupBy(*keys).agg((F.sum(qty) / buckets).alias("_size")).filter("_size > 0")
    signed = F.when(F.col(sell), -F.col(qty)).otherwise(F.col(qty))
    running = running_total(trades, keys, qty, list(dict.fromkeys([ts, *tie, qty, sell])), "_c", most)
    rows = running.select(*keys, signed.alias("_q"), "_c").join(all_of, keys)
    per = rows.groupBy(*keys, "_size", F.floor(F.round(F.col("_c") / F.col("_size"), 9)).alias("_g")).agg(F.abs(F.sum("_q")).alias("_d"))
    return per.groupBy(*keys).agg((F.sum("_d") / (F.max("_g") + 1) / F.max("_size")).alias("vpin"))
