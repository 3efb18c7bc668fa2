"""Session set-up and tables written once and read many times."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_fallback_dirs: dict[str, str] = {}

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20  # bytes of whole texts handed to a Python worker at once
FILE_ROWS = 50_000  # rows that a file of a table of known size has at least, unless that left cores idle


def get_spark(app: str = "panelweave", cpus: int | str | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own session instead."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` if the cluster names one.

    Only where it is unset (a local test session) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/panelweave-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="panelweave-")
    return _fallback_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`work_dir`; never one that already holds data."""
    clean = re.sub(r"[^A-Za-z0-9_]+", "_", label)
    return f"{work_dir(spark)}/{clean}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Used where one result feeds several branches (a panel, a forecast table, a
    recursion state): the branches then share one scan with column pruning and
    file statistics, and a lost executor costs a re-read, not a rebuild.

    ``rows``, about as many as there are, keeps a small table out of one file for each shuffle partition:
    every file starts processes on its executor (Hadoop sets modes by ``chmod``) and has to be opened by each reader.
    The last step then runs in as many tasks as there are files, all cores' at least.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, key: str = "id") -> DataFrame:
    """Like :func:`materialize`, but bucketed by ``key``.

    For tables that many steps window, group or fit by the same key: their scans
    come partitioned by it, so none of those steps shuffles. The buckets follow
    the session's shuffle width; rows already hashed to it are written as they lie.
    The table is registered in the session catalog, its files stay in the work folder.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(width, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def small_batches(spark: SparkSession) -> None:
    """Have rows travel to Python workers in batches of at most ``BATCH_BYTES``, for this session.

    Spark's own limits, 10,000 rows and 64 MB, let whole texts grow the executor's buffers and every worker, which
    hand little of that back; batches of short rows stay as they are. A limit that the session names itself is kept.
    It holds when rows are read, which for a returned table is after the operator, so it is not taken back.
    """
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle width.

    For CPU-heavy work per series: adaptive coalescing goes by bytes and would
    put many small but slow series into one task; a fixed width is left alone.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def side_by_side(task: Callable, items: Iterable, width: int = 4) -> list:
    """Run a few driver-side fits at once, results in order.

    A fit is a chain of short jobs that leaves most executors idle between
    stages; a small pool fills them without queueing dozens of jobs.
    """
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(task, items))
