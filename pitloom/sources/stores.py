"""File stores: typed scans, revision-safe upserts into monthly shards, logs and exports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


METRICS = "event_ts timestamp, as_of_ts timestamp, coin string, metric string, value double, source string, status string"
NEWS = "event_ts timestamp, as_of_ts timestamp, id long, headline string, content string, summary string, symbols string, source string, author string, url string"
INDEX = "event_ts timestamp, as_of_ts timestamp, value int, classification string"
UNLOCKS = "unlock_date timestamp, as_of_ts timestamp, coin string, amount_tokens double, pct_circulating_supply double, recipient_category string, source string"
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
BOOK = "asof string, written_utc string, weights map<string,double>, realized_book_ret double, realized_mark_ret double"
SEQ = "_batch_seq"
#: A batch that touches more months than this reads the whole store.
MONTHS = 1200


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The columns of the schema, cast, in its order; extra columns are dropped, a missing one is an error."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def read_store(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Scan of a Parquet store; a store that does not exist is an empty table of that schema."""
    known = _known(spark, root, schema)
    return spark.createDataFrame([], schema) if known is None else known


def shard_columns(ts: Column | str) -> list[Column]:
    return [F.year(ts).alias("year"), F.month(ts).alias("month")]


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the given order (NULLs first); combined before the shuffle, so a hot key is no burden."""
    last = F.max_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_x")
    grouped = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(last)
    return grouped.select("_x.*")


def _known(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    """The store, or None if there is none yet; any other error is passed on."""
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return None


def _swap(spark: SparkSession, staging: str, root: str) -> None:
    """Puts the staged months in the place of the store's by renames; if one fails, those done before are taken back."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(root))
    done: list[tuple[str, str]] = []

    def move(old: str, new: str) -> None:
        fs.mkdirs(jvm.Path(os.path.dirname(new)))
        if not fs.rename(jvm.Path(old), jvm.Path(new)):
            raise OSError(f"{old} could not be moved to {new}")
        done.append((old, new))

    try:
        for year in fs.listStatus(jvm.Path(staging)):
            if not year.isDirectory():
                continue
            for month in fs.listStatus(year.getPath()):
                part = f"{year.getPath().getName()}/{month.getPath().getName()}"
                if fs.exists(jvm.Path(f"{root}/{part}")):
                    move(f"{root}/{part}", f"{staging}/_old/{part}")
                move(f"{staging}/{part}", f"{root}/{part}")
    except BaseException:
        for old, new in reversed(done):
            fs.rename(jvm.Path(new), jvm.Path(old))
        raise
    fs.delete(jvm.Path(staging), True)


def upsert(spark: SparkSession, batch: DataFrame, root: str, schema: str, keys: list[str], ts: str, merged: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Merges a batch into a store sharded by year and month of `ts`; rows of equal keys are replaced, the newest batch wins.

    Within a batch the last row by `_batch_seq` wins, if there is such a column, else the last by content. Only the shards of the
    batch's months are read and written: the new state goes to a staging folder, whose months then replace the store's by
    renames. A job that fails before them leaves the store as it was, one that fails among them takes them back. Months of any size are
    written by as many tasks as they need. Returns the number of rows in the touched shards.
    """
    has_seq = SEQ in batch.columns
    new = conform(batch, schema + (f", {SEQ} long" if has_seq else "")).withColumn("_new", F.lit(1))
    new = new.withColumn("_seq", F.col(SEQ) if has_seq else F.lit(0).cast("long")).withColumn("_text", F.to_json(F.struct(*[c for c in new.columns if c not in ("_new", SEQ)]))).drop(SEQ).select("*", *shard_columns(ts))
    number = F.col("year") * 12 + F.col("month")
    months = [r[0] for r in new.select(number.alias("m")).distinct().limit(MONTHS + 1).collect()]
    old = _known(spark, root, schema + ", year int, month int")
    both = new
    if old is not None:
        if len(months) <= MONTHS:  # the others' files are not opened
            old = old.filter(number.isin(months))
        else:
            old = old.join(new.select("year", "month").distinct(), ["year", "month"], "left_semi")
        both = new.unionByName(old.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(0).cast("long")).withColumn("_text", F.lit(None).cast("string")))
    state = keep_last(both, keys, [F.col("_new"), F.col("_seq"), F.col("_text")]).drop("_new", "_seq", "_text")
    if merged is not None:
        state = merged(state)
    staging = os.path.join(os.path.dirname(root.rstrip("/")), f".staging-{uuid.uuid4().hex}")
    state.hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(staging)
    n = spark.read.schema(schema + ", year int, month int").parquet(staging).count()
    _swap(spark, staging, root)
    return n


def replace_family(base: DataFrame, fresh: DataFrame, key: str, prefix: str) -> DataFrame:
    """Drops the base's columns of a prefix and joins the fresh family in, keeping the keys of both sides."""
    rest = base.drop(*[c for c in base.columns if c.startswith(prefix)])
    return rest.join(fresh, key, "full")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a log of JSON lines. A line that is no JSON, or whose `required` field is no ISO date, is malformed:
    it is counted, not returned. counts: n_rows, n_malformed."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    good = F.col("_bad").isNull() & F.coalesce(F.col(required).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & F.try_to_date(required, "yyyy-MM-dd").isNotNull()
    counts = parsed.agg(F.count_if(good).alias("n_rows"), F.count_if(~good).alias("n_malformed"))
    return parsed.filter(good).drop("_bad").orderBy(required), counts


def read_newest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the most recently modified file of a folder; lines that are no JSON are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder).select("*", F.col("_metadata.file_modification_time").alias("_t"), F.col("_metadata.file_path").alias("_p"))
    last = rows.agg(F.max(F.struct("_t", "_p")).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).filter("_t = _last._t AND _p = _last._p").drop("_t", "_p", "_last")  # one row


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; lines that do not fit the schema are dropped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def export_csv(df: DataFrame, path: str) -> int:
    """Writes a CSV file with a header and returns its rows; an empty table writes nothing and gives 0."""
    n = df.count()
    if n:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return n


def stage_by(df: DataFrame, column: str, root: str) -> None:
    """One folder per value of a column, as a serving layout."""
    df.write.mode("overwrite").partitionBy(column).parquet(root)


def stable_id(*parts: str) -> Column:
    """A number that depends on the given text columns alone: the first 15 hex digits of their SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def tag_symbols(text: Column, words: dict[str, list[str]], default: str) -> Column:
    """Comma list of the symbols of whose terms one is in the lower-cased text; the default where there is none. A term written
    =word must be a whole word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.split(low, r"\s+")
    def hit(term: str) -> Column:
        return F.array_contains(tokens, term[1:]) if term.startswith("=") else low.contains(term)
    tags = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, map(hit, terms)), F.lit(symbol)) for symbol, terms in words.items()]))
    return F.when(F.size(tags) > 0, F.array_join(tags, ",")).otherwise(F.lit(default))


def without_tags(text: Column | str) -> Column:
    """Text with its markup taken out, nothing put in its place, and trimmed; NULL is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), r"^\s+|\s+$", "")


def strip_tags(text: Column | str) -> Column:
    """Text without markup, white space runs made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def epoch_to_ts(x: Column | str) -> Column:
    """A timestamp of epoch milliseconds or microseconds; which of them is told by the size."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c > 10**14, F.timestamp_micros(c)).otherwise(F.timestamp_millis(c))


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str], event_ts: str, late: list[str], lag_days: int = 1, late_lag_days: int = 7) -> DataFrame:
    """Wide text columns to one row per metric; what is no number is dropped. Known a day later, a late metric a week."""
    rows = wide.select(*keys, event_ts, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast(`{m}` AS DOUBLE)").alias("value")) for m in metrics])))
    lag = F.when(F.col("metric").isin(late), late_lag_days).otherwise(lag_days) if late else F.lit(lag_days)
    return rows.filter(F.col("value").isNotNull()).withColumn("as_of_ts", F.col(event_ts) + F.make_dt_interval(lag))
