"""Implausible spikes in measurements (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits, small, stage
from .shards import MOST, SHARD, TimeShards, mark_nulls, unmark_nulls, with_edges

#: Steps of a histogram per doubling of the distance, and the buckets of 0 and of what has no logarithm.
STEPS, LOWEST, HIGHEST = 8, -(2**30), 2**30
#: Equal parts into which a bucket is cut if it holds too many values to be sorted in one task.
CUTS = 4096
SIDE = 5


def _median_of_5(a: list[Column]) -> Column:
    """The third of five by exchanges: the lowest and the highest of two pairs can't be it."""
    p, q, r, s, t = a
    low = F.greatest(F.least(p, q), F.least(r, s))
    high = F.least(F.greatest(p, q), F.greatest(r, s))
    return F.greatest(F.least(low, high), F.least(F.greatest(low, high), t))


def _bucket(x: Column) -> Column:
    """Grows with x; all zeros share one bucket, and so do equal values."""
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, F.lit(LOWEST)).when(x < 1e308, F.floor(F.log2(x) * STEPS)).otherwise(F.lit(HIGHEST)).cast("int")


def _edge(bucket: Column, upper: bool) -> Column:
    """A bound of the values in a bucket, a little wide, as logarithms are rounded."""
    inside = F.pow(F.lit(2.0), (bucket + int(upper)) / STEPS) * (1 + 1e-9 if upper else 1 - 1e-9)
    return F.when(bucket == LOWEST, 0.0).when(bucket == HIGHEST, float("inf") if upper else 1e307).otherwise(inside)


def phase_space(readings: DataFrame, keys: list[str], value: str = "value", event_ts: str = "event_ts", tie: tuple[str, ...] = ("as_of_ts", "reading_id"), shard_days: int = 256, most: int = MOST) -> DataFrame:
    """The current readings with their coordinates in phase space; staged, as several passes follow.

    Columns: keys, SHARD, the last of `tie`, value, before and after (distance to the median of the five current readings on
    that side, NULL where there are not five), d1 and d2 (size of the first and second difference), run (number of
    consecutive equal values around the reading, up to five on each side, itself included).
    """
    row_id = tie[-1]
    rows = readings.select(*keys, F.col(event_ts).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)], F.col(value).cast("double").alias("value"))
    rows = TimeShards([(rows, F.unix_micros("_t"))], keys, shard_days, most).add(rows, F.unix_micros("_t"))
    w = Window.partitionBy(*keys, SHARD)
    ties = [f"_k{i}" for i in range(len(tie))]
    current = rows.withColumn("_then", F.lead("_t").over(w.orderBy("_t", *ties))).filter(F.col("_then").isNull() | (F.col("_then") != F.col("_t"))).drop("_then")
    edged = with_edges(current.select(*keys, SHARD, "_t", ties[-1], "value"), keys, ["_t"], ["value"], SIDE)
    o = w.orderBy("_t")
    steps = range(1, SIDE + 1)
    near = edged.select("*", *[F.lag("value", k).over(o).alias(f"_p{k}") for k in steps], *[F.lead("value", k).over(o).alias(f"_n{k}") for k in steps])
    left, right = F.col("_rn"), (F.col("_cnt") - F.col("_rn") + 1).cast("int")  # places from either edge of the shard
    earlier = [F.when(left > k, F.col(f"_p{k}")).otherwise(F.try_element_at("_before", left - k - 1)["value"]) for k in steps]
    later = [F.when(right > k, F.col(f"_n{k}")).otherwise(F.try_element_at("_after", k + 1 - right)["value"]) for k in steps]
    near = near.select(*keys, SHARD, F.col(ties[-1]).alias(row_id), "value", *[x.alias(f"_p{k}") for k, x in zip(steps, earlier)], *[x.alias(f"_n{k}") for k, x in zip(steps, later)])
    p, n, v = [F.col(f"_p{k}") for k in steps], [F.col(f"_n{k}") for k in steps], F.col("value")

    def equal(neighbours: list[Column]) -> Column:
        count = F.lit(SIDE)
        for k in reversed(range(SIDE)):
            count = F.when(neighbours[k].isNotNull() & (neighbours[k] == v), count).otherwise(F.lit(k))
        return count

    return stage(near.select(
        *keys, SHARD, row_id, "value",
        F.when(p[-1].isNotNull(), F.abs(v - _median_of_5(p))).alias("before"),
        F.when(n[-1].isNotNull(), F.abs(v - _median_of_5(n))).alias("after"),
        F.abs(v - p[0]).alias("d1"), F.abs(n[0] - 2 * v + p[0]).alias("d2"),
        (1 + equal(p) + equal(n)).alias("run"),
    ))


def _histogram(rows: DataFrame, keys: list[str], axes: list[Column]) -> DataFrame:
    """keys, _axis, _b, _n: number of values of each axis in each bucket, combined before the shuffle; NULLs are left out."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_axis"), _bucket(x).alias("_b")) for i, x in enumerate(axes)]))).filter(F.col("_b").isNotNull())
    return long.groupBy(*keys, "_axis", "_b").agg(F.count(F.lit(1)).alias("_n"))


def _middle(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of counts per ordered `value`, those that hold a middle rank: keys, value, _n, _c0 (values below), _r (the rank): one row a rank, so up to two a group."""
    g = Window.partitionBy(*keys)
    ranked = counts.withColumn("_c", F.sum("_n").over(g.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("_n").over(g))
    ranks = ranked.select("*", F.explode(F.array_distinct(F.array(F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)))).alias("_r"))
    return ranks.filter((F.col("_r") > F.col("_c") - F.col("_n")) & (F.col("_r") <= F.col("_c"))).select(*keys, value, "_n", (F.col("_c") - F.col("_n")).alias("_c0"), "_r")


def _at_rank(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """The row of each group of `by` in which the running count, from _c0 on, reaches the rank _r."""
    upto = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("_c", F.sum("_n").over(upto) + F.col("_c0"))
    return running.filter((F.col("_r") > F.col("_c") - F.col("_n")) & (F.col("_r") <= F.col("_c"))).withColumn("_c0", F.col("_c") - F.col("_n")).drop("_c", "_n")


def _exact(rows: DataFrame, keys: list[str], x: str, middle: DataFrame, most: int) -> DataFrame:
    """The median of each group of `middle` (see _middle, by bucket): keys, median. Equal values are counted before they are sorted."""
    middle = stage(middle)
    largest = middle.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    some = rows.filter(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), _bucket(F.col(x)).alias("_b"))
    inside = some.join(small(middle.drop("_n")), [*keys, "_b"])
    at = [*keys, "_b", "_c0", "_r"]
    if largest > most:  # too many to sort: first the part of the bucket that holds the rank, then its values
        low, high = _edge(F.col("_b"), False), _edge(F.col("_b"), True)
        cut = F.when(F.col("_b").isin(LOWEST, HIGHEST), 0).otherwise(F.floor((F.col("_x") - low) / (high - low) * CUTS)).cast("int")
        inside = inside.withColumn("_cut", cut)
        parts = _at_rank(inside.groupBy(*at, "_cut").agg(F.count(F.lit(1)).alias("_n")), keys, "_cut")
        inside = inside.drop("_c0").join(small(stage(parts)), [*keys, "_b", "_r", "_cut"]).drop("_cut")
    values = inside.groupBy(*at, "_x").agg(F.count(F.lit(1)).alias("_n"))
    return _at_rank(values, keys, "_x").groupBy(*keys).agg(((F.min("_x") + F.max("_x")) / 2).alias("median"))


def exact_median(rows: DataFrame, keys: list[str], x: str, most: int = MOST) -> DataFrame:
    """The median of x per group as `median`: exact, and no group is held in memory or sorted as a whole.

    Counts per bucket of a histogram (combined before the shuffle) show which buckets hold the two middle ranks; of their rows,
    equal values are counted, and only distinct values are sorted; a bucket with more than `most` rows is cut further before.
    NULLs are left out; groups without a value or with a NULL key give no row. `rows` is read several times.
    """
    return _exact(rows, keys, x, _middle(_histogram(rows, keys, [F.col(x)]).drop("_axis"), keys, "_b"), most)


def _scales(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _axis, _low, _high: bounds of the median of each axis, by the edges of the buckets that hold the middle ranks."""
    middle = _middle(histogram, [*keys, "_axis"], "_b")
    return middle.groupBy(*keys, "_axis").agg(_edge(F.min("_b"), False).alias("_low"), _edge(F.max("_b"), True).alias("_high"))


def _as_columns(scales: DataFrame, keys: list[str], columns: dict[str, tuple[int, str]]) -> DataFrame:
    return scales.groupBy(*keys).agg(*[F.max(F.when(F.col("_axis") == axis, F.col(side))).alias(name) for name, (axis, side) in columns.items()])


def _attach(points: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """points with the columns of a (staged) table that has one row a series: broadcast if it is small, else joined by series and
    shard, so that no series has to fit into one task."""
    if fits(table):
        return points.join(F.broadcast(table), keys, "left")
    by = [*keys, SHARD]
    return points.join(points.select(*by).distinct().join(table, keys), by, "left")


def flag_faults(readings: DataFrame, catalog: DataFrame, keys: list[str], metric: str = "metric", factor: float = 8.0, rounds: int = 2, stuck: int = 6, value: str = "value", event_ts: str = "event_ts", tie: tuple[str, ...] = ("as_of_ts", "reading_id"), shard_days: int = 256, most: int = MOST) -> DataFrame:
    """One row per current reading: the id, value, and the flags impossible, stuck, candidate and spike.

    readings: usable readings (both times and a number). catalog: metric, min_valid, max_valid, may_repeat; a metric that it
    lacks has no bounds and is never called stuck, as nothing is known of it.

    Method, phase-space thresholding: a reading is a point of its distance to the nearer of the medians of its five
    neighbours on either side, its first difference and its second difference. Points outside the ellipsoid whose axes
    are `factor` robust scales long are candidates. The scales, medians known to a histogram bucket, are then taken again
    from the points that are left (by taking the candidates out of the histogram), and further points fall out, `rounds` times in all.
    `spike` is for candidates that are farther than `factor` times the series' usual difference from both medians. As the first
    axis of the first ellipsoid is the lower bound of the usual difference, every such reading is a candidate; one beyond the
    upper bound as well is decided by that; only the series of candidates in between get their exact usual difference. Runs of
    zero difference give `stuck`, the catalog's bounds `impossible`.

    A series with fewer than eleven readings has no spikes; a NULL in a text key is a series of its own. Where the usual difference is 0, any distance is out. Series
    are cut into time shards, further where they hold more than `most` rows; the scales join on series and shard, so a long series is spread over many tasks.
    """
    row_id = tie[-1]
    points = phase_space(mark_nulls(readings.select(*keys, *{event_ts, *tie, value}), keys), keys, value, event_ts, tie, shard_days, most)
    before, after, near = F.col("before"), F.col("after"), F.least("before", "after")  # least skips NULLs
    histogram = stage(_histogram(points, keys, [before, near, F.col("d1"), F.col("d2")]))

    def outside(scales: tuple[str, str, str]) -> Column:
        total, beyond = F.lit(0.0), F.lit(False)
        for x, s in zip((near, F.col("d1"), F.col("d2")), map(F.col, scales)):
            part = F.coalesce(F.try_divide(x, s * factor), F.lit(0.0))
            total = total + part * part
            beyond = beyond | F.coalesce((s == 0) & (x > 0), F.lit(False))
        return beyond | (total > 1)

    table = stage(_as_columns(_scales(histogram, keys), keys, {"_low": (0, "_low"), "_high": (0, "_high"), "_s1": (2, "_high"), "_s2": (3, "_high")}))
    ellipsoids = [("_low", "_s1", "_s2")]
    fallen = stage(_attach(points, table, keys).filter(outside(ellipsoids[0])).select(*keys, SHARD, row_id, "before", "after", "d1", "d2", "_low", "_high"))
    both = lambda bound: (before > factor * F.col(bound)) & (after > factor * F.col(bound))
    open_series = stage(fallen.filter(both("_low") & ~both("_high")).select(*keys).distinct())
    for k in range(1, rounds):
        rest = histogram.unionByName(_histogram(fallen, keys, [before, near, F.col("d1"), F.col("d2")]).withColumn("_n", -F.col("_n")))
        rest = rest.groupBy(*keys, "_axis", "_b").agg(F.sum("_n").alias("_n")).filter("_n > 0")
        names = (f"_u{k}", f"_d{k}", f"_e{k}")
        table = stage(table.join(_as_columns(_scales(rest, keys), keys, {n: (a, "_high") for n, a in zip(names, (1, 2, 3))}), keys, "left"))
        if k + 1 < rounds:
            now = outside(ellipsoids[0])
            for e in (*ellipsoids[1:], names):
                now = now | outside(e)
            fallen = stage(_attach(points, table, keys).filter(now).select(*keys, SHARD, row_id, "before", "after", "d1", "d2"))
        ellipsoids.append(names)
    if not open_series.isEmpty():
        undecided = histogram.filter("_axis = 0").drop("_axis").join(small(open_series), keys, "left_semi")
        exact = _exact(points, keys, "before", _middle(undecided, keys, "_b"), most)
        table = stage(table.join(exact.withColumnRenamed("median", "_usual"), keys, "left"))
    else:
        table = table.withColumn("_usual", F.lit(None).cast("double"))
    candidate = F.lit(False)
    for e in ellipsoids:
        candidate = candidate | outside(e)
    far = F.coalesce(F.when(F.col("_usual").isNotNull(), both("_usual")).otherwise(both("_high")), F.lit(False))
    known = small(catalog.select(F.col(metric).alias("_metric"), "min_valid", "max_valid", "may_repeat").dropDuplicates(["_metric"]))
    named = _attach(points, table, keys).join(known, F.col(metric) == F.col("_metric"), "left").withColumn("candidate", candidate)
    bad = F.coalesce(F.col("value") < F.col("min_valid"), F.lit(False)) | F.coalesce(F.col("value") > F.col("max_valid"), F.lit(False))
    out = named.select(row_id, *keys, "value", bad.alias("impossible"), (F.coalesce(~F.col("may_repeat"), F.lit(False)) & (F.col("run") >= stuck)).alias("stuck"), "candidate", (F.col("candidate") & far).alias("spike"))
    return unmark_nulls(out, keys)
