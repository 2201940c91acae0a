"""Rolling totals over trailing periods (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shards import MOST, SHARD, TimeShards, day_number, mark_nulls, unmark_nulls

#: Totals are kept as decimals, so that taking an expired amount out leaves exactly what was there before it came in.
AMOUNT = "decimal(38,9)"
#: Amounts from this size on do not fit; see rolling_totals.
LARGEST = 1e24
WINDOWS = (7, 30)


def daily_amounts(readings: DataFrame, keys: list[str], value: str = "value", tie: tuple[str, ...] = ("as_of_ts", "reading_id"), shard_days: int = 128, most: int = MOST) -> DataFrame:
    """Sum and number of the current readings of each series and day: keys, day, amount, n, n_large.

    Of each event time only the reading that is greatest by `tie` counts, so revisions and repeats are not added up. Series
    are cut into time shards, which are cut further where they hold more than `most` rows.
    """
    rows = readings.filter(F.col("event_ts").isNotNull() & F.col(value).isNotNull()).select(*keys, F.col("event_ts").alias("_t"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)], F.col(value).cast("double").alias("v")).alias("_r"))
    us = F.unix_micros("_t")
    shards = TimeShards([(rows, us)], keys, shard_days, most)
    rows = shards.add(rows, us).withColumn("day", day_number(F.col("_t"))).repartition(*keys, SHARD)
    current = rows.groupBy(*keys, SHARD, "day", "_t").agg(F.max("_r")["v"].alias("v"))
    large = ~(F.abs("v") < LARGEST)
    amount = F.when(large, F.lit(0)).otherwise(F.col("v")).cast(AMOUNT)
    daily = current.groupBy(*keys, SHARD, "day").agg(F.try_sum(amount).cast(AMOUNT).alias("amount"), F.count(F.lit(1)).alias("n"), F.count_if(large).alias("n_large"))
    if shards.split:  # a day can be spread over several parts of a shard
        daily = daily.groupBy(*keys, "day").agg(F.try_sum("amount").cast(AMOUNT).alias("amount"), F.sum("n").alias("n"), F.sum("n_large").alias("n_large"))
    return daily.drop(SHARD)


def _measures(windows: tuple[int, ...]) -> list[str]:
    return [f"{m}{w}" for w in windows for m in "snl"]


def advance(daily: DataFrame, keys: list[str], windows: tuple[int, ...] = WINDOWS, yesterday: DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Moves the rolling state on, day by day: today's totals are yesterday's plus today's arrivals minus the expiring day's amounts.

    daily: keys, day, amount, n, n_large. yesterday: keys, day and the totals s, n, l (sum, number, number that is too large) of each
    window at the end of that day, one row a series; without it every series begins with nothing. `since`: a column of `daily`
    with yesterday's day (NULL: none); amounts up to it only expire. `until`: a column of `daily` with the last day to
    write; else the last day of an arrival. Returns keys, day and the totals of every day after yesterday, days
    on which nothing arrives or expires included.

    Each daily amount is joined to its own day as an arrival and to the day that gives it up as an expiry, both with the running state.
    A series has at most one amount a day here, so its days are worked on in one task, however many readings they are made of.
    """
    measures = _measures(windows)
    zero, nothing = F.lit(0).cast(AMOUNT), F.lit(0).cast("long")
    start = F.col(since) if since else F.lit(None).cast("int")
    rows = daily.select(*keys, "day", F.lit(0).alias("_held"), start.alias("_since"), (F.col(until) if until else F.lit(None).cast("int")).alias("_until"), "amount", "n", "n_large", *[F.lit(None).cast(AMOUNT if m[0] == "s" else "long").alias(m) for m in measures])
    if yesterday is not None:
        held = yesterday.select(*keys, "day", F.lit(1).alias("_held"), F.col("day").alias("_since"), F.lit(None).cast("int").alias("_until"), zero.alias("amount"), nothing.alias("n"), nothing.alias("n_large"), *[F.col(m).cast(AMOUNT if m[0] == "s" else "long").alias(m) for m in measures])
        rows = rows.unionByName(held)
    rows = rows.repartition(*keys)

    def event(day: Column, when: Column, value, arrives: bool) -> Column:
        return F.when(when, F.struct(day.cast("int").alias("day"), (F.col("day") if arrives else F.lit(None).cast("int")).alias("_arrival"), *[value(m) for m in measures]))

    fresh = (F.col("_held") == 0) & (F.col("_since").isNull() | (F.col("day") > F.col("_since")))
    amounts = {"s": F.col("amount"), "n": F.col("n"), "l": F.col("n_large")}
    none = {"s": zero, "n": nothing, "l": nothing}
    arrival = event(F.col("day"), fresh, lambda m: amounts[m[0]].alias(m), True)
    held = event(F.col("day"), F.col("_held") == 1, lambda m: F.coalesce(m, none[m[0]]).alias(m), False)
    expiries = [event(F.col("day") + w, (F.col("_held") == 0) & (F.col("_since").isNull() | (F.col("day") + w > F.col("_since"))), lambda m, w=w: (-amounts[m[0]] if m == f"{m[0]}{w}" else none[m[0]]).alias(m), False) for w in windows]
    events = rows.select(*keys, "_since", F.col("_until").alias("_last"), F.inline(F.filter(F.array(arrival, held, *expiries), lambda x: x.isNotNull())))
    total = lambda m: F.try_sum(m).cast(AMOUNT) if m[0] == "s" else F.sum(m).cast("long")
    changes = events.groupBy(*keys, "day").agg(*[total(m).alias(m) for m in measures], F.max("_arrival").alias("_arrival"), F.max("_since").alias("_since"), F.max("_last").alias("_last"))
    series = Window.partitionBy(*keys)
    w = series.orderBy("day")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda m: F.try_sum(m).over(so_far).cast(AMOUNT) if m[0] == "s" else F.sum(m).over(so_far).cast("long")
    end = F.coalesce(F.max("_last").over(series), F.max("_arrival").over(series))
    state = changes.select(*keys, F.greatest(F.col("day"), F.max("_since").over(series) + 1).alias("_from"), F.lead("day").over(w).alias("_then"), end.alias("_end"), *[running(m).alias(m) for m in measures])
    state = state.withColumn("_to", F.least(F.coalesce(F.col("_then") - 1, F.col("_end")), F.col("_end"))).filter("_end IS NOT NULL AND _from <= _to")
    return state.select(*keys, *measures, F.explode(F.sequence("_from", "_to")).alias("day"))


def present(state: DataFrame, keys: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The state as sums (decimals, as held), numbers and means; see rolling_totals."""
    rest = [c for c in state.columns if c not in (*keys, "day", *_measures(windows))]
    fits = lambda w: F.col(f"l{w}") == 0
    totals = [x for w in windows for x in (
        F.when(fits(w), F.col(f"s{w}")).alias(f"sum_{w}"), F.col(f"n{w}").alias(f"n_{w}"),
        F.when(fits(w) & (F.col(f"n{w}") > 0), F.col(f"s{w}").cast("double") / F.col(f"n{w}")).alias(f"mean_{w}"))]
    return state.select(*keys, "day", *totals, *rest)


def rolling_totals(daily: DataFrame, keys: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The rolling totals of every series and day from its first to its last: sum, number and mean of each window, by `advance`.

    A window that holds an amount of 1e24 or more, or an infinite one, has a NULL sum and mean, its number is
    right; so has one whose sum doesn't fit 29 digits. Repeated (key, day) rows are added up. A NULL in a key is a series of its
    own. An empty table gives no rows. Extra columns are ignored.
    """
    return present(advance(daily, keys, windows), keys, windows)


def advance_in_steps(daily: DataFrame, keys: list[str], cuts: list[int], windows: tuple[int, ...] = WINDOWS, keep=lambda df: df) -> DataFrame:
    """The same state, maintained: one step for the days up to each cut (ascending), then one for the rest.

    A step reads the amounts of its own days and of those that can still expire, and yesterday's totals of each series, which
    are the last it has. `keep` stores a step's result (`stage` on a cluster, as in a daily job).
    """
    longest = max(windows)
    daily = mark_nulls(daily, keys)
    last, parts = None, []
    for hi in [*cuts, None]:
        own = daily if hi is None else daily.filter(F.col("day") <= hi)
        if last is not None:  # a series that has paused for long still has amounts to give up
            own = own.join(last.select(*keys, F.col("day").alias("_since")), keys, "left").filter(F.col("_since").isNull() | (F.col("day") > F.col("_since") - longest))
        # a series without fresh amounts has no new days
        part = keep(advance(own, keys, windows, last, "_since" if last is not None else None))
        parts.append(part)
        newest = part.groupBy(*keys).agg(F.max_by(F.struct(*part.columns), "day").alias("_x")).select("_x.*")
        last = newest if last is None else keep(newest.unionByName(last.join(newest, keys, "left_anti").select(*newest.columns)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return unmark_nulls(out, keys)


def correct(state: DataFrame, daily: DataFrame, changed: DataFrame, keys: list[str], version: int, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Adds a new version of the days that corrections touch; the older versions stay.

    state: results of `advance` with the columns `version` and `gone`. daily: the daily amounts after the correction. changed:
    keys, day of the amounts that were corrected, added or taken away. The days in reach of a change, and those by which
    a series grew at either end, make runs of days; each run is advanced from the stored totals of the day before it, with the
    amounts of its own days and of those that expire in it. Days that a series no longer has get a version that is `gone`.
    """
    longest = max(windows)
    state, daily, changed = (mark_nulls(x, keys) for x in (state, daily, changed))
    measures = _measures(windows)
    series = changed.select(*keys).distinct()
    now = latest(state, keys).join(series, keys, "left_semi")
    old = now.groupBy(*keys).agg(F.min("day").alias("_begin"), F.max("day").alias("_end"))
    new = daily.join(series, keys, "left_semi").groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    both = new.join(old, keys, "full")
    span = lambda a, b: F.struct(a.alias("_a"), b.alias("_b"))
    reach = changed.select(*keys, F.inline(F.array(span(F.col("day"), F.col("day") + longest - 1))))
    grown = both.select(*keys, F.inline(F.array(
        span(F.greatest("_first", F.col("_end") + 1), F.col("_last")), span(F.col("_first"), F.least(F.col("_begin") - 1, F.col("_last"))), span(F.col("_first"), F.when(F.col("_begin").isNull(), F.col("_last"))),
    )))
    spans = reach.unionByName(grown).join(both, keys).select(*keys, "_first", F.greatest("_a", "_first").alias("_a"), F.least("_b", "_last").alias("_b"), F.col("_b").alias("_raw")).filter("_first IS NOT NULL AND _raw IS NOT NULL AND _a <= _b").drop("_raw")
    w = Window.partitionBy(*keys).orderBy("_a", "_b")
    opens = F.coalesce(F.col("_a") > F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbered = spans.withColumn("_open", opens.cast("int")).withColumn("_run", F.sum("_open").over(w))
    runs = numbered.groupBy(*keys, "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.min("_first").alias("_first"))
    by = [*keys, "_run"]
    before = runs.filter("_a > _first").select(*by, (F.col("_a") - 1).alias("day")).join(now.select(*keys, "day", *measures), [*keys, "day"], "left")
    starts = before.select(*by, "day", *measures).unionByName(runs.filter("_a = _first").select(*by, (F.col("_a") - 1).alias("day"), *[F.lit(None).cast(AMOUNT if m[0] == "s" else "long").alias(m) for m in measures]))
    # at a series' first day nothing is left of earlier amounts, whatever the old state says
    needed = runs.select(*by, (F.col("_a") - 1).alias("_since"), F.col("_b").alias("_until"), F.explode(F.sequence(F.greatest(F.col("_a") - longest, F.col("_first")), "_b")).alias("day"))
    amounts = daily.join(needed, [*keys, "day"])
    until = runs.select(*by, F.col("_a").alias("day"), F.lit(0).cast(AMOUNT).alias("amount"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_large"), (F.col("_a") - 1).alias("_since"), F.col("_b").alias("_until"))
    fresh = advance(amounts.select(*until.columns).unionByName(until), by, windows, starts, "_since", "_until").drop("_run")
    lost = now.join(both.select(*keys, "_first", "_last"), keys).filter(F.col("_first").isNull() | (F.col("day") < F.col("_first")) | (F.col("day") > F.col("_last")))
    fresh = fresh.withColumn("gone", F.lit(False)).unionByName(lost.select(*keys, *measures, "day", F.lit(True).alias("gone"))).withColumn("version", F.lit(version))
    return unmark_nulls(state.unionByName(fresh.select(*state.columns)), keys)


def changed_days(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day of the daily amounts that differ, are new or are gone."""
    before, after = mark_nulls(before, keys), mark_nulls(after, keys)
    fields = ("amount", "n", "n_large")
    old = before.select(*keys, "day", F.struct(*fields).alias("_a"))
    both = after.select(*keys, "day", F.struct(*fields).alias("_b")).join(old, [*keys, "day"], "full")
    return unmark_nulls(both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, "day"), keys)


def versioned(state: DataFrame, version: int) -> DataFrame:
    return state.withColumn("gone", F.lit(False)).withColumn("version", F.lit(version))


def latest(state: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every series and day that is not gone."""
    rest = [c for c in state.columns if c not in (*keys, "day", "version")]
    newest = state.groupBy(*keys, "day").agg(F.max_by(F.struct(*rest), "version").alias("_x"))
    return newest.select(*keys, "day", "_x.*").filter("NOT gone").drop("gone")
