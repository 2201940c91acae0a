"""A filter of bounded size that keeps most rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and bits at most: a million words of 64 bits, which may always be broadcast.
EACH, MOST = 8, 1 << 26


def likely(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in `keys`, and some others: a join on the key must follow. No row with a partner is lost.

    The filter is a table of 64-bit words with a bit set for the hash of each key. Its size follows from the number of
    keys; if they are too many for a filter of MOST bits to keep much out (less than 2 bits a key), there is none, and the join
    that follows does it all. `keys` is read twice: pass a staged table.
    """
    n = keys.count()
    bits = min(MOST, 1 << max(10, (n * EACH - 1).bit_length()))
    if n * 2 > bits:
        return df
    place = lambda: F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(place().alias("_h")).groupBy(F.floor(F.col("_h") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_h % 64 AS INT))")).alias("_bits"))
    hashed = df.withColumn("_h", place()).withColumn("_word", F.floor(F.col("_h") / 64))
    hit = hashed.join(F.broadcast(words), "_word")
    return hit.filter("(shiftrightunsigned(_bits, CAST(_h % 64 AS INT)) & 1L) = 1").select(*df.columns)
