"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, stage

#: Records of a source that one range of the random key holds, about; the number of ranges is a power of two, at least LEAST.
RECORDS, LEAST = 100_000, 64
#: How often each source is cut again behind the records that straddle a cut, and then searched for one more record that fits.
CUTS, FILLS = 3, 3


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per targeted source: target_share, max_repeats, available, budget (tokens).

    Without `total`, the mix is as large as the sources allow that have documents: that of the scarcest one, used
    max_repeats times. With `total`, a source whose budget exceeds what it may give is held at that.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).dropDuplicates(["source"]).select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    both = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    most = F.col("available") * F.col("max_repeats")
    if total is None:
        size = F.min(F.when(most > 0, most / F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # one row a target
        both = both.withColumn("_total", F.coalesce(size, F.lit(0.0)))
    else:
        both = both.withColumn("_total", F.lit(float(total)))
    return both.withColumn("budget", F.least(F.floor(F.col("_total") * F.col("target_share") + 1e-6).cast("long"), most)).drop("_total")


def _ends(rows: DataFrame) -> DataFrame:
    """rows with `_end`, the tokens of their source up to each of them in the order of the key: sums of ranges, then within a range."""
    rows = rows.drop("_end")
    sums = rows.groupBy("source", "_range").agg(F.sum("tokens").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_within", F.sum("tokens").over(own)).join(offsets, ["source", "_range"]).withColumn("_end", F.col("_offset") + F.col("_within")).drop("_within", "_offset")


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, ranges: int | None = None, cuts: int = CUTS, fills: int = FILLS) -> tuple[DataFrame, DataFrame]:
    """Chooses and repeats records so that each source gives its share of the tokens. Returns (chosen, report).

    sizes: doc_id, source, tokens. targets: source, target_share, max_repeats. chosen: doc_id, source, tokens, times (1 or more).
    report, one row per target: target_share, available, budget, documents, tokens, repeats (most times of one record), share
    of the mix reached.

    Method: each record has a hash-random key; a source is cut into ranges of the key, the tokens of each range are summed
    (combined before the shuffle), and the running sum over ranges plus the one inside a range is the record's place in
    its source. A source repeats as a whole while its budget lasts; the last epoch is cut at the exact budget: the record
    that straddles it is left out, and those behind it that are not larger than what is left are cut again at that, in the order
    of the key, up to `cuts` times; then the largest that fits is taken (the first by key of equal ones), up to `fills` times a
    source. So no source gets more than its budget. No source is sorted in one task.

    Sources without a target, NULL sources and records without tokens are left out. A target without documents gives a
    report row with 0 tokens; the others then share the mix in proportion. Repeated targets count once, repeated doc_ids as
    records of their own. Ties of the key are ordered by doc_id. Empty tables give empty results.
    """
    plan = stage(budgets(sizes, targets, total))
    known = sizes.filter(F.col("tokens") > 0).select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))
    ranges = ranges or max(LEAST, 1 << (known.count() // RECORDS).bit_length())
    bounded_plan = plan.count() <= 10_000
    bounded = plan.select("source", "available", "budget", "max_repeats")
    bounded = F.broadcast(bounded) if bounded_plan else bounded
    key = F.xxhash64(F.lit(seed), "doc_id")
    keyed = known.join(bounded, "source").withColumn("_key", key).withColumn("_range", F.shiftrightunsigned(key, 64 - (ranges.bit_length() - 1)).cast("int"))
    placed = _ends(keyed)
    end = F.col("_end")
    epochs = F.floor(F.col("budget") / F.col("available")).cast("long")
    rest = F.col("budget") - epochs * F.col("available")
    inside = (end <= rest) & (epochs < F.col("max_repeats"))
    placed = stage(placed.select("doc_id", "source", "tokens", "_key", F.col("_end").alias("_own"), "_range", epochs.cast("int").alias("_epochs"), inside.alias("_in"), rest.alias("_rest")))
    left = placed.groupBy("source", "_rest").agg(F.sum(F.when(F.col("_in"), F.col("tokens")).otherwise(F.lit(0))).alias("_used")).select("source", (F.col("_rest") - F.col("_used")).alias("_left"))
    place = F.struct(F.col("tokens"), (-F.col("_key").cast("decimal(20,0)")).alias("k"), F.col("doc_id"), F.col("_own"))
    names = ["source", "_key", "doc_id", "_own"]
    extra = None
    for k in range(cuts + fills):
        left = stage(left)  # one row a source
        behind = placed.filter(~F.col("_in")).join(F.broadcast(left) if bounded_plan else left, "source").filter(F.col("tokens") <= F.col("_left"))
        if extra is not None:
            behind = behind.join(extra, names, "left_anti")
        if k < cuts:
            more = _ends(behind).filter(F.col("_end") <= F.col("_left")).select(*names, "tokens")
        else:
            more = behind.groupBy("source").agg(F.max(place).alias("_b")).select("source", (-F.col("_b.k")).cast("long").alias("_key"), F.col("_b.doc_id").alias("doc_id"), F.col("_b._own").alias("_own"), F.col("_b.tokens").alias("tokens"))
        more = stage(more)
        used = more.groupBy("source").agg(F.sum("tokens").alias("_used"))
        left = left.join(used, "source", "left").select("source", (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left"))
        extra = more.drop("tokens") if extra is None else extra.unionByName(more.drop("tokens"))
    if extra is not None:
        extra = extra.withColumn("_extra", F.lit(1))
        placed = placed.join(small(stage(extra)), names, "left")
    more = F.coalesce("_extra", F.lit(0)) if extra is not None else F.lit(0)
    chosen = stage(placed.select("doc_id", "source", "tokens", (F.col("_epochs") + F.col("_in").cast("int") + more).cast("int").alias("times")).filter("times > 0"))
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("repeats"))
    report = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", "available", "budget", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "repeats")])
    return chosen, report.withColumn("share", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(0)))))
