"""Session helpers: a local session for tests, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A side of a join is broadcast only if it has at most this many rows and megabytes; otherwise it is shuffled.
BROADCAST_ROWS, BROADCAST_MB = 200_000, 32
FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date"}


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pitloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Sets runtime settings for a block and puts the old values back."""
    names = {"shuffle_cleanup": SHUFFLE_CLEANUP, "arrow_batch": ARROW_BATCH}
    old = {}
    for k, v in values.items():
        name = names.get(k, k)
        old[name] = spark.conf.get(name, None)
        spark.conf.set(name, v)
    try:
        yield
    finally:
        for name, v in old.items():
            spark.conf.unset(name) if v is None else spark.conf.set(name, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or in local mode one of our own."""
    folder = spark.sparkContext.getConf().get(CHECKPOINT_DIR, None) or spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pitloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, f"file://{folder}")
        folder = f"file://{folder}"
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path in a folder of its own under the shared folder, which `release` removes with the staged tables."""
    path = os.path.join(shared_folder(spark), f"scratch-{uuid.uuid4().hex}")
    _staged.append(path)
    return f"{path}/{name}"


def stage(df: DataFrame, arrow_batch: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs no earlier stage, and several readers share one computation.
    Shuffle files of the writing job are removed as soon as the table stands.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"stage-{uuid.uuid4().hex}")
    extra = {"arrow_batch": str(arrow_batch)} if arrow_batch else {}
    with settings(spark, shuffle_cleanup="true", **extra):
        df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that no result is read from any more."""
    for df in tables:
        for path in [p for p in _staged if df.inputFiles() and f"/{os.path.basename(p)}/" in df.inputFiles()[0]]:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            _staged.remove(path)


_staged: list[str] = []


@atexit.register
def release(spark: SparkSession | None = None) -> None:
    """Removes the staged tables of this process; results read from them must have been written before.

    With a session, folders of any file system are removed; without one, at the end of the process, those on mounted paths.
    """
    while _staged:
        path = _staged.pop()
        if spark is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        elif path.startswith("file:") or "://" not in path:
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, mb: int = BROADCAST_MB) -> bool:
    """Whether a count shows that df has at most `rows` rows and `mb` megabytes.

    Columns of no fixed width count with their real size. The plan of df runs once for the count: pass a staged or small table.
    """
    wide = [c for c, kind in df.dtypes if not kind.startswith(("decimal", "timestamp")) and kind not in FIXED]
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`") if kind in ("string", "binary") else F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c, kind in df.dtypes if c in wide]
    width = 16 * len(df.columns) + reduce(lambda a, b: a + b, sizes, F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and size <= mb << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, mb: int = BROADCAST_MB) -> DataFrame:
    """df with a broadcast hint if it fits, else df."""
    return F.broadcast(df) if fits(df, rows, mb) else df
