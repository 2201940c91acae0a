"""The queries of the general problems over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import as_known_at
from ..operators.grid import regular_grid
from ..operators.late import k_slack, provisional_counts, released_aggregates
from ..operators.orphans import blank_to_null, month_text, orphan_report, reference_status, union_all
from ..operators.rolling import advance, advance_in_steps, changed_days, correct, daily_amounts, latest, present, versioned
from ..operators.shards import clean_name, day_text, usable_readings
from ..operators.spikes import flag_faults
from ..session import stage

SERIES = ["coin", "metric", "source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable readings of onchain; coins trimmed and in lower case."""
    rows = table(spark, sf_dir, "onchain").select("reading_id", "event_ts", "as_of_ts", "coin", "metric", "source", "value", "status")
    return usable_readings(rows).withColumn("coin", clean_name("coin"))


def _reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    def child(name: str, key: str, space: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(space).alias("space"), blank_to_null(F.col(key)).alias("key"), F.lit(name).alias("child_table"), F.col("id").alias("child_id"), "logged_ts")

    def parent(name: str, key: str, space: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(space).alias("space"), blank_to_null(F.col(key)).alias("key"), "loaded_ts", "deleted_ts")

    references = union_all([child("predictions", "cycle_id", "cycles"), child("sizing", "cycle_id", "cycles"), child("analyst_reports", "trade_id", "trades")])
    return reference_status(references, union_all([parent("cycles", "cycle_id", "cycles"), parent("trades", "id", "trades")]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orphans = _reference_status(spark, sf_dir).filter(F.col("status") != "ok")
    return orphans.select("child_table", "child_id", month_text(F.col("logged_ts")).alias("period")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_reference_status(spark, sf_dir))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    onchain = readings(spark, sf_dir).select(F.lit("onchain").alias("tbl"), *SERIES, "event_ts", "as_of_ts", "reading_id", F.lit("").alias("label"), "value")
    fng = usable_readings(table(spark, sf_dir, "fng")).select(F.lit("fng").alias("tbl"), *[F.lit("-").alias(c) for c in SERIES], "event_ts", "as_of_ts", F.lit(0).cast("long").alias("reading_id"), F.coalesce("classification", F.lit("")).alias("label"), F.col("value").cast("double").alias("value"))
    return regular_grid(onchain.unionByName(fng), ["tbl", *SERIES], tie=("as_of_ts", "reading_id", "label"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).filter("missing").select("tbl", *SERIES, day_text(F.col("day")).alias("day"))


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    return g.select("tbl", *SERIES, day_text(F.col("day")).alias("day"), "n_readings", "value", day_text(F.col("value_day")).alias("value_day"))


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_faults(readings(spark, sf_dir), table(spark, sf_dir, "metric_catalog"), SERIES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faults(spark, sf_dir).filter("impossible or stuck or spike").select("reading_id").distinct()


def _as_known(spark: SparkSession, sf_dir: str, attributes: list[str]) -> DataFrame:
    requests = table(spark, sf_dir, "asof_requests").withColumn("coin", clean_name("coin"))
    return as_known_at(requests, readings(spark, sf_dir), SERIES, attributes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_known(spark, sf_dir, []).select("request_id", "reading_id").distinct()


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_known(spark, sf_dir, ["value", "status"]).select("request_id", *SERIES, "reading_id", F.unix_micros("event_ts").alias("event_us"), "value", "status").distinct()


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_amounts(readings(spark, sf_dir), SERIES)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = advance(_daily(spark, sf_dir), SERIES)
    return state.filter("n7 = 0").select(*SERIES, day_text(F.col("day")).alias("day"))


def _totals_out(state: DataFrame) -> DataFrame:
    return present(state, SERIES).select(*SERIES, day_text(F.col("day")).alias("day"), "n_7", "n_30", "sum_7", "sum_30", "mean_7", "mean_30")


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sums and means of every series and day, none rounded or left out."""
    return _totals_out(advance(_daily(spark, sf_dir), SERIES))


def p6_stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals, maintained in four steps, each from the stored totals of the step before."""
    daily = stage(_daily(spark, sf_dir))
    first, last = daily.agg(F.min("day"), F.max("day")).first()
    cuts = sorted({first + (last - first) * k // 4 for k in (1, 2, 3)}) if first is not None else []
    return _totals_out(advance_in_steps(daily, SERIES, cuts, keep=stage))


def p6_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state built from what came within three days, then corrected by everything that came later."""
    all_rows = readings(spark, sf_dir)
    in_time = all_rows.filter(F.unix_micros("as_of_ts") <= F.unix_micros("event_ts") + 3 * 86_400_000_000)
    first, now = stage(daily_amounts(in_time, SERIES)), stage(daily_amounts(all_rows, SERIES))
    state = stage(versioned(advance(first, SERIES), 1))
    return _totals_out(latest(correct(state, now, changed_days(first, now, SERIES), SERIES, 2), SERIES))


def _arrivals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "news": k_slack(table(spark, sf_dir, "news"), "id", "event_ts", "as_of_ts", "day", 72),
        "unlocks": k_slack(table(spark, sf_dir, "unlocks"), "unlock_id", "unlock_date", "as_of_ts", "month", 240),
    }


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [run.filter("late").select(F.lit(name).alias("tbl"), "record_id", "as_of_us") for name, run in _arrivals(spark, sf_dir).items()]
    return union_all(runs).distinct()


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    finals = [released_aggregates(stage(run)).select(F.lit(name).alias("tbl"), "*") for name, run in _arrivals(spark, sf_dir).items()]
    return union_all(finals).select("tbl", day_text(F.col("period_day")).alias("period"), "n", "n_late", "first_id", "last_id", "longest_gap_us")


def p7_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [provisional_counts(run).select(F.lit(name).alias("tbl"), "*") for name, run in _arrivals(spark, sf_dir).items()]
    return union_all(counts).select("tbl", day_text(F.col("period_day")).alias("period"), "published_us", "n", "final")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_grid, p4_found, p5_found, p5_values, p6_found, p6_rolling, p6_stepped, p6_corrected, p7_found, p7_counts, p7_provisional)
}

_READINGS = """readings AS (
  SELECT reading_id, epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin,
         metric, source, value, status, CAST(floor(epoch_us(event_ts) / 86400000000.0) AS INTEGER) AS d
  FROM onchain WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
current AS (SELECT DISTINCT * FROM (
  SELECT *, row_number() OVER (PARTITION BY coin, metric, source, e ORDER BY a DESC, reading_id DESC) AS rn FROM readings) WHERE rn = 1)"""
_DAY = "strftime(DATE '1970-01-01' + CAST({0} AS INTEGER), '%Y-%m-%d')"
_STATUS = """
WITH refs AS (
  SELECT DISTINCT 'cycles' AS space, lower(regexp_replace(cycle_id, '^\\s+|\\s+$', '', 'g')) AS k, 'predictions' AS child_table, id AS child_id, epoch_us(logged_ts) AS t FROM predictions
  UNION ALL SELECT DISTINCT 'cycles', lower(regexp_replace(cycle_id, '^\\s+|\\s+$', '', 'g')), 'sizing', id, epoch_us(logged_ts) FROM sizing
  UNION ALL SELECT DISTINCT 'trades', CAST(trade_id AS VARCHAR), 'analyst_reports', id, epoch_us(logged_ts) FROM analyst_reports),
parents AS (
  SELECT DISTINCT 'cycles' AS space, lower(regexp_replace(cycle_id, '^\\s+|\\s+$', '', 'g')) AS k, epoch_us(loaded_ts) AS l, epoch_us(deleted_ts) AS x FROM cycles
  UNION ALL SELECT DISTINCT 'trades', CAST(id AS VARCHAR), epoch_us(loaded_ts), epoch_us(deleted_ts) FROM trades),
status AS (
  SELECT r.child_table, r.child_id, r.t, strftime(DATE '1970-01-01' + CAST(floor(r.t / 86400000000.0) AS INTEGER), '%Y-%m') AS period,
    coalesce(bool_or(p.l <= r.t + 86400000000 AND (p.x IS NULL OR p.x > r.t)), false) AS ok,
    coalesce(bool_or(p.l <= r.t + 86400000000 AND (p.x IS NULL OR p.x > p.l - 86400000000)), false) AS in_time, count(p.space) > 0 AS has_parent
  FROM refs r LEFT JOIN parents p ON r.space = p.space AND r.k = p.k
  WHERE r.k IS NOT NULL AND r.k <> '' GROUP BY ALL)"""
_SPAN = "spans AS (SELECT coin, metric, source, min(d) AS d0, max(d) AS d1 FROM current GROUP BY ALL), days AS (SELECT coin, metric, source, CAST(unnest(generate_series(d0, d1)) AS INTEGER) AS d FROM spans)"
_ARRIVALS = """
arrivals AS (
  SELECT DISTINCT 'news' AS tbl, id AS record_id, epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, CAST(floor(epoch_us(event_ts) / 86400000000.0) AS BIGINT) AS p,
    (CAST(floor(epoch_us(event_ts) / 86400000000.0) AS BIGINT) + 1) * 86400000000 + 72 * 3600000000 AS c FROM news WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'unlocks', unlock_id, epoch_us(unlock_date), epoch_us(as_of_ts), date_trunc('month', make_timestamp(epoch_us(unlock_date)))::DATE - DATE '1970-01-01',
    (((date_trunc('month', make_timestamp(epoch_us(unlock_date))) + INTERVAL 1 MONTH)::DATE - DATE '1970-01-01') + 10) * 86400000000 FROM unlocks WHERE unlock_date IS NOT NULL AND as_of_ts IS NOT NULL)"""
#: A double becomes a decimal by its shortest text, as in Spark; DuckDB's own cast goes by a product of doubles.
_ROLLING = f"""WITH {_READINGS},
daily AS (SELECT coin, metric, source, d, sum(CAST(CAST(value AS VARCHAR) AS DECIMAL(38,9))) AS s, count(*) AS n FROM current GROUP BY ALL), {_SPAN},
joined AS (SELECT days.*, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM days LEFT JOIN daily USING (coin, metric, source, d)),
totals AS (SELECT coin, metric, source, d, CAST(sum(n) OVER w7 AS BIGINT) AS n_7, CAST(sum(n) OVER w30 AS BIGINT) AS n_30, sum(s) OVER w7 AS s7, sum(s) OVER w30 AS s30
  FROM joined WINDOW w7 AS (PARTITION BY coin, metric, source ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY coin, metric, source ORDER BY d ROWS 29 PRECEDING))
SELECT coin, metric, source, {_DAY.format("d")} AS day, n_7, n_30,
  CAST(s7 AS DECIMAL(38,9)) AS sum_7, CAST(s30 AS DECIMAL(38,9)) AS sum_30, CASE WHEN n_7 > 0 THEN CAST(s7 AS DOUBLE) / n_7 END AS mean_7, CASE WHEN n_30 > 0 THEN CAST(s30 AS DOUBLE) / n_30 END AS mean_30 FROM totals"""

SQL: dict[str, str] = {
    "p1_found": _STATUS + " SELECT DISTINCT child_table, child_id, period FROM status WHERE NOT ok",
    "p1_report": _STATUS + """ SELECT child_table, period, count(*) AS n_references, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok AND NOT in_time AND NOT has_parent) AS n_missing,
      count(*) FILTER (NOT ok AND in_time) AS n_deleted, count(*) FILTER (NOT ok AND NOT in_time AND has_parent) AS n_late FROM status GROUP BY ALL""",
    "p2_found": f"""WITH {_READINGS}, {_SPAN},
      fd AS (SELECT DISTINCT CAST(floor(epoch_us(event_ts) / 86400000000.0) AS INTEGER) AS d FROM fng WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND value IS NOT NULL)
      SELECT 'onchain' AS tbl, coin, metric, source, {_DAY.format("d")} AS day FROM days ANTI JOIN current USING (coin, metric, source, d)
      UNION ALL SELECT 'fng', '-', '-', '-', {_DAY.format("d")} FROM (SELECT unnest(generate_series((SELECT min(d) FROM fd), (SELECT max(d) FROM fd))) AS d) ANTI JOIN fd USING (d)""",
    "p2_grid": f"""WITH {_READINGS}, {_SPAN},
      f AS (SELECT CAST(floor(epoch_us(event_ts) / 86400000000.0) AS INTEGER) AS d, epoch_us(event_ts) AS e, epoch_us(as_of_ts) AS a, CAST(value AS DOUBLE) AS value, coalesce(classification, '') AS c
            FROM fng WHERE event_ts IS NOT NULL AND as_of_ts IS NOT NULL AND value IS NOT NULL),
      obs AS (SELECT 'onchain' AS tbl, coin, metric, source, d, count(*) AS n, arg_max(value, e) AS v FROM current GROUP BY ALL
              UNION ALL SELECT 'fng', '-', '-', '-', d, count(DISTINCT e), arg_max(value, (e, a, c, value)) FROM f GROUP BY ALL),
      span AS (SELECT tbl, coin, metric, source, min(d) AS d0, max(d) AS d1 FROM obs GROUP BY ALL), spine AS (SELECT tbl, coin, metric, source, CAST(unnest(generate_series(d0, d1)) AS INTEGER) AS d FROM span)
      SELECT tbl, coin, metric, source, {_DAY.format("s.d")} AS day, CASE WHEN o.d = s.d THEN n ELSE 0 END AS n_readings, v AS value, {_DAY.format("o.d")} AS value_day
      FROM spine s ASOF JOIN obs o USING (tbl, coin, metric, source, d)""",
    "p4_found": f"""WITH {_READINGS},
      near AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY coin, metric, source) AS n,
          list_sort([lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w, lag(value, 4) OVER w, lag(value, 5) OVER w])[3] AS mb,
          list_sort([lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w, lead(value, 4) OVER w, lead(value, 5) OVER w])[3] AS ma,
          CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS fresh
        FROM current WINDOW w AS (PARTITION BY coin, metric, source ORDER BY e)),
      usual AS (SELECT coin, metric, source, median(abs(value - mb)) AS u FROM near WHERE i > 5 GROUP BY ALL),
      runs AS (SELECT *, sum(fresh) OVER (PARTITION BY coin, metric, source ORDER BY e) AS run FROM near),
      long AS (SELECT *, count(*) OVER (PARTITION BY coin, metric, source, run) AS len FROM runs)
      SELECT DISTINCT reading_id FROM long LEFT JOIN usual USING (coin, metric, source) LEFT JOIN metric_catalog c USING (metric)
      WHERE value < min_valid OR value > max_valid OR (len >= 6 AND NOT may_repeat)
        OR (i > 5 AND n - i >= 5 AND abs(value - mb) > 8 * u AND abs(value - ma) > 8 * u)""",
    "p5_found": f"""WITH {_READINGS},
      asked AS (SELECT request_id, lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin, metric, source, epoch_us(request_ts) AS t FROM asof_requests)
      SELECT request_id, arg_max(reading_id, (e, a, reading_id)) AS reading_id FROM asked JOIN readings USING (coin, metric, source) WHERE e <= t AND a <= t GROUP BY request_id""",
    "p5_values": f"""WITH {_READINGS},
      asked AS (SELECT request_id, lower(regexp_replace(coin, '^\\s+|\\s+$', '', 'g')) AS coin, metric, source, epoch_us(request_ts) AS t FROM asof_requests),
      ranked AS (SELECT request_id, coin, metric, source, reading_id, e, value, status, row_number() OVER (PARTITION BY request_id ORDER BY e DESC, a DESC, reading_id DESC) AS rn
        FROM asked JOIN readings USING (coin, metric, source) WHERE e <= t AND a <= t)
      SELECT request_id, coin, metric, source, reading_id, e AS event_us, value, status FROM ranked WHERE rn = 1""",
    "p6_found": f"""WITH {_READINGS}, {_SPAN}, obs AS (SELECT DISTINCT coin, metric, source, d FROM current)
      SELECT coin, metric, source, {_DAY.format("d")} AS day FROM (SELECT days.*, o.d AS last FROM days ASOF JOIN obs o USING (coin, metric, source, d)) WHERE d - last >= 7""",
    "p6_rolling": _ROLLING,
    "p6_stepped": _ROLLING,
    "p6_corrected": _ROLLING,
    "p7_found": f"WITH {_ARRIVALS} SELECT DISTINCT tbl, record_id, a AS as_of_us FROM arrivals WHERE a > c",
    "p7_counts": f"""WITH {_ARRIVALS},
      good AS (SELECT tbl, p, record_id, arg_max(e, (a, e)) AS e FROM arrivals WHERE a <= c GROUP BY ALL),
      gaps AS (SELECT *, e - lag(e) OVER (PARTITION BY tbl, p ORDER BY e, record_id) AS g FROM good),
      final AS (SELECT tbl, p, count(*) AS n, arg_min(record_id, (e, record_id)) AS first_id, arg_max(record_id, (e, record_id)) AS last_id, max(g) AS longest_gap_us FROM gaps GROUP BY ALL),
      late AS (SELECT tbl, p, count(*) AS n_late FROM arrivals WHERE a > c GROUP BY ALL)
      SELECT tbl, {_DAY.format("p")} AS period, coalesce(n, 0) AS n, coalesce(n_late, 0) AS n_late, first_id, last_id, longest_gap_us FROM final FULL JOIN late USING (tbl, p)""",
    "p7_provisional": f"""WITH {_ARRIVALS},
      first AS (SELECT tbl, p, c, record_id, min(a) AS a FROM arrivals WHERE a <= c GROUP BY ALL),
      steps AS (SELECT tbl, p, c, least((CAST(floor(a / 86400000000.0) AS BIGINT) + 1) * 86400000000, c) AS published_us, count(*) AS k FROM first GROUP BY ALL)
      SELECT tbl, {_DAY.format("p")} AS period, published_us, CAST(sum(k) OVER (PARTITION BY tbl, p ORDER BY published_us) AS BIGINT) AS n, published_us = c AS final FROM steps""",
}
