"""Groups of exact copies, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group counts as hot from this size on, and from a thousandth of all rows.
HOT_ROWS, HOT_SHARE = 200_000, 1000


def representatives(rows: DataFrame, row_id: str, digest: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """row_id and rep, the smallest id with the same digest. `rows` is read more than once: pass a staged table.

    Groups are aggregated before the shuffle. Hot ones, of which there are fewer than a thousand by definition, come back to
    their rows by a broadcast, so that no task gets a hot group; the others by a shuffle.
    """
    groups = rows.groupBy(*digest).agg(F.min(row_id).alias("rep"), F.count(F.lit(1)).alias("_n"))
    limit = max(hot, rows.count() // HOT_SHARE)
    known = F.broadcast(groups.filter(F.col("_n") > limit).select(*digest, F.col("rep").alias("_hot")))
    marked = rows.select(row_id, *digest).join(known, digest, "left")
    cold = marked.filter(F.col("_hot").isNull()).join(groups.filter(F.col("_n") <= limit), digest).select(row_id, "rep")
    return cold.unionByName(marked.filter(F.col("_hot").isNotNull()).select(row_id, F.col("_hot").alias("rep")))
