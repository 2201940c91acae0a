"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

from collections import deque
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that a packer holds open at most.
OPEN_BINS = 512
#: Items that one packer gets, about.
ITEMS = 20_000


class Packer:
    """Bounded-space online best fit. Bit f of `free` is set if an open bin has f units free, so the bin that an item fills
    best is the lowest set bit from its size on. When one bin more than allowed would be open, the fullest closes."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, open_bins
        self.free = 0
        self.bins: dict[int, deque[int]] = {}
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        queue = self.bins[space]
        number = queue.popleft()
        if not queue:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def add(self, size: int) -> int:
        """Number of the bin that takes an item of this size (0 to capacity)."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        space -= size
        if space:  # a full bin is closed at once
            self.bins.setdefault(space, deque()).append(number)
            self.free |= 1 << space
            self.open += 1
        return number


def _pack_group(key, rows: pd.DataFrame, open_bins: int) -> pd.DataFrame:
    packer = Packer(int(key[2]), open_bins)
    rows = rows.sort_values(["_order", "doc_id", "piece"], kind="stable")
    rows["bin"] = [packer.add(int(n)) for n in rows["tokens"]]
    return rows[["spec_name", "capacity_tokens", "doc_id", "piece", "tokens", "_shard", "bin"]]


def pack(items: DataFrame, specs: DataFrame, open_bins: int = OPEN_BINS, items_per_packer: int = ITEMS) -> DataFrame:
    """Puts each item into a container of each capacity: spec_name, capacity_tokens, doc_id, piece, token_start, tokens, bin.

    items: doc_id, tokens. specs: spec_name, capacity_tokens. An item is split only if it is larger than the capacity: into pieces of
    the whole capacity, which are full containers of their own, and the rest, which is packed like an item. `bin` is
    unique within a spec.

    Method: bounded-space online best fit with a bitset of open bins by free space, the fullest closing first. Items are
    spread over packers by a hash, in a random order, so no group grows with the data; each packer leaves at most
    `open_bins` containers part filled. Full pieces need no packer and stay where they are.

    Items without tokens (NULL or empty texts) or with a NULL size are in no container. Repeated rows are packed as often as
    they come. A capacity that is NULL or below 1 is an error. Empty tables give no rows.
    """
    if specs.filter(F.col("capacity_tokens").isNull() | (F.col("capacity_tokens") < 1)).limit(1).count():
        raise ValueError("a capacity must be at least 1")
    known = [(r["spec_name"], int(r["capacity_tokens"])) for r in specs.select("spec_name", "capacity_tokens").distinct().sort("spec_name", "capacity_tokens").limit(1000).collect()]
    if len(known) == 1000:
        raise ValueError("more than 999 specs")
    good = items.filter(F.col("tokens") > 0).select("doc_id", F.col("tokens").cast("long").alias("tokens"))
    shards = max(1, -(-good.count() // items_per_packer))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("spec_name"), F.lit(c).cast("int").alias("capacity_tokens")) for n, c in known])) if known else None
    if each is None:
        return good.select(F.lit("").alias("spec_name"), F.lit(0).alias("capacity_tokens"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("token_start"), "tokens", F.lit("").alias("bin")).limit(0)
    copies = good.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("_n"))  # repeated rows get numbers, so that names of bins don't depend on partitions
    numbered = copies.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    cut = numbered.select("doc_id", "tokens", "_copy", each.alias("_s")).select("doc_id", "tokens", "_copy", "_s.*")
    full = F.floor(F.col("tokens") / F.col("capacity_tokens")).cast("long")
    whole = cut.filter(full > 0).select("spec_name", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"), F.col("capacity_tokens").cast("long").alias("tokens"), F.concat_ws("-", F.lit("w"), "doc_id", "tokens", "_copy").alias("_name"))
    whole = whole.withColumn("bin", F.concat_ws("-", "_name", "piece")).drop("_name")
    rest = cut.select("spec_name", "capacity_tokens", "doc_id", "_copy", full.alias("piece"), (F.col("tokens") % F.col("capacity_tokens")).alias("tokens")).filter("tokens > 0")
    order = F.xxhash64("doc_id", "_copy")
    spread = rest.withColumn("_order", order).withColumn("_shard", F.pmod("_order", F.lit(shards)).cast("int")).drop("_copy")
    kind = dict(spread.dtypes)["doc_id"]
    packed = spread.groupBy("_shard", "spec_name", "capacity_tokens").applyInPandas(partial(_pack_group, open_bins=open_bins), f"spec_name string, capacity_tokens int, doc_id {kind}, piece long, tokens long, _shard int, bin long")
    packed = packed.select("spec_name", "capacity_tokens", "doc_id", "piece", "tokens", F.concat_ws("-", F.lit("p"), "_shard", "bin").alias("bin"))
    return whole.unionByName(packed).select("spec_name", "capacity_tokens", "doc_id", "piece", (F.col("piece") * F.col("capacity_tokens")).alias("token_start"), "tokens", "bin")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per spec: containers, items, tokens and the part of the room that is used."""
    bins = packed.groupBy("spec_name", "capacity_tokens", "bin").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return bins.groupBy("spec_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("bins"), F.sum("_n").alias("items"), F.sum("_t").alias("tokens"), F.max("_t").alias("fullest")).withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
