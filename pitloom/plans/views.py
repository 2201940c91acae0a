"""Market-like views of the test tables, in Spark and as SQL, on which the operators run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: daily bars of lineitem by return flag; close is the mean weighted by volume."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    return rows.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.round(F.min_by(price, first), 6).alias("open"), F.round(F.max(price), 6).alias("high"), F.round(F.min(price), 6).alias("low"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.sum("l_quantity").alias("volume")
    )


BARS = """bars AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date,
  round(arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)), 6) AS open, round(max(l_extendedprice / l_quantity), 6) AS high,
  round(min(l_extendedprice / l_quantity), 6) AS low, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, ts, price, qty, sell: the events as trades."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("date"), "ts", (F.col("user_id") % 100 + 1).cast("double").alias("price"), F.col("value").alias("qty"), (F.col("user_id") % 2 == 1).alias("sell"))


TICKS = "ticks AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, ts, CAST(user_id % 100 + 1 AS DOUBLE) AS price, value AS qty, user_id % 2 = 1 AS sell FROM events)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, ret: daily returns of the bars, the first day of a symbol left out."""
    from ..functions.windows import Series, pct_change

    s = Series(("symbol",), ("date",))
    return bars(spark, sf_dir).select("symbol", "date", (pct_change("close", s) / 50).alias("ret")).filter("ret IS NOT NULL")


RETURNS = BARS + ", returns AS (SELECT symbol, date, ret FROM (SELECT symbol, date, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) / 50 AS ret FROM bars) WHERE ret IS NOT NULL)"
