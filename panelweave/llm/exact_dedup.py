"""Exact deduplication as a stateful stream.

Arriving rows are reduced to a log of (digest, id, place); a structured stream folds
the log into keyed state on disk (RocksDB, checkpointed to the shared folder) that never
expires: per digest the smallest id with its place and the number of rows. Hits, digests
seen more than once, are then checked on their full bytes, those of earlier calls read again at
their places; should two texts ever share a digest, it is remembered beside the state, and its
rows are decided on the texts themselves, now and in later calls.

Null text counts as empty; equal means identical after each run of white space became one
space. Of equal rows the smallest id stays, a null id after all others, then the first
place. Repeated rows are copies like any other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import SPACES, field, join_spread, keep_places, located, quoted
from panelweave.session import materialize, new_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HIT_SALTS = 32


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _arrival(doc_id: Column) -> Column:
    """What state compares: smallest id first, then the place of the content."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.col("file"), F.col("row"))


def fold(spark: SparkSession, log: str, state: str, files_per_batch: int = 4096) -> DataFrame:
    """Stream new files of the arrival log into the state and return it as ``(digest, first, n)``.

    A session of its own keeps the store provider away from the caller's settings. Run again
    with the same folders it reads only what has arrived since.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    # Many small stores share one budget, write from small buffers, and are closed soon after the stream has ended.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "1")
    own.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "10s")
    # Many small stores: without this each reserves megabytes of disk for its logs.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    schema = spark.read.parquet(log).schema
    arrivals = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    kept = arrivals.groupBy("digest").agg(F.min("arrival").alias("first"), F.count("*").alias("n"))
    run = (
        kept.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    table = spark.read.format("statestore").load(state)
    first, n = [F.col("value")[f] for f in table.schema["value"].dataType.fieldNames()]
    return table.select(F.col("key")["digest"].alias("digest"), first.alias("first"), n.alias("n"))


def dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    state_dir: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest, file, row``.

    With ``state_dir`` the state outlives the call, and rows are also compared with all that
    arrived in earlier calls; the files of those calls must still be there and name the text the
    same. ``digest`` may be any function of the text; the byte check makes the result exact whatever
    it is.
    """
    return dedup_rows(located(docs), text, doc_id, digest, state_dir)


def dedup_rows(
    rows: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    state_dir: str | None = None,
) -> DataFrame:
    """:func:`dedup` of rows that carry their place already."""
    spark = rows.sparkSession
    key = field(rows, doc_id).cast("bigint")
    texts = rows.select("file", "row", key.alias("doc_id"), normalised(field(rows, text)).alias("body"))
    texts = texts.withColumn("digest", digest(F.col("body")))
    folder = state_dir or new_path(spark, "dedup")
    batch = new_path(spark, "arrivals").rsplit("-", 1)[-1]
    new = texts.select("digest", _arrival(F.col("doc_id")).alias("arrival"), F.lit(batch).alias("batch"))
    new.write.mode("append").parquet(f"{folder}/log")
    state = materialize(fold(spark, f"{folder}/log", f"{folder}/state"), "state")
    log = spark.read.schema(new.schema).parquet(f"{folder}/log")
    own = log.filter(F.col("batch") == batch).select("digest", "arrival")

    decided = join_spread(own, state, ["digest"], "n")
    clashes = _clashes(texts, state)
    if state_dir:
        earlier = log.filter(F.col("batch") != batch).select("digest", "arrival")
        clashes = _remembered(clashes, texts, earlier, text, f"{folder}/clashes")
    if not clashes.isEmpty():
        decided = decided.join(clashes, "digest", "left_anti").select("digest", "arrival", "first", "n")
        decided = decided.unionByName(_on_bytes(texts, clashes, earlier if state_dir else None, text))
    return decided.select(
        F.col("arrival.doc_id").alias("doc_id"),
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").cast("bigint").alias("group_size"),
        (F.col("first") == F.col("arrival")).alias("kept"),
        F.col("digest"),
        F.col("arrival.file").alias("file"),
        F.col("arrival.row").alias("row"),
    )


def _clashes(texts: DataFrame, state: DataFrame) -> DataFrame:
    """Digests whose rows of this call differ in their bytes.

    Only hits are compared. A digest with a third of all rows is dealt over salted parts,
    and equal bodies fold to one row per task before they move on.
    """
    hits = state.filter("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(HIT_SALTS - 1))).alias("salt"))
    salted = texts.select("digest", "body", F.pmod(F.xxhash64("file", "row"), F.lit(HIT_SALTS)).cast("int").alias("salt"))
    bodies = salted.join(hits, ["digest", "salt"], "left_semi").groupBy("digest", "body").agg(F.count("*").alias("n"))
    return materialize(bodies.groupBy("digest").agg(F.count("*").alias("bodies")).filter("bodies > 1").select("digest"), "clashes")


def _contents(places: DataFrame, text: str) -> DataFrame:
    """``places`` (with file and row) with the normalised text found there."""
    spark = places.sparkSession
    files = [unquote(r["file"]) for r in places.select("file").distinct().toLocalIterator()]
    if not files:
        return places.withColumn("body", F.lit(None).cast("string"))
    kept = spark.read.schema(f"`{text.replace('`', '``')}` string").parquet(*files)
    meta = kept.metadataColumn("_metadata")
    kept = kept.select(normalised(quoted(text)).alias("body"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    return places.join(kept, ["file", "row"])


def _remembered(clashes: DataFrame, texts: DataFrame, earlier: DataFrame, text: str, folder: str) -> DataFrame:
    """All clashing digests among the new rows: these, those that differ from what earlier calls kept, those known before."""
    spark = texts.sparkSession
    new = texts.groupBy("digest").agg(F.min("body").alias("new"))  # if there are several, the digest clashes already
    first = earlier.groupBy("digest").agg(F.min("arrival").alias("first")).join(new, "digest")
    kept = _contents(first.select("digest", "new", "first.file", "first.row"), text)
    found = clashes.unionByName(kept.filter("new <> body").select("digest")).distinct()
    found.write.mode("append").parquet(folder)
    return materialize(spark.read.schema(found.schema).parquet(folder).distinct().join(new, "digest", "left_semi"), "clashes")


def _on_bytes(texts: DataFrame, clashes: DataFrame, earlier: DataFrame | None, text: str) -> DataFrame:
    """The rows of clashing digests decided on digest and text, over all calls."""
    twisted = texts.join(clashes, "digest", "left_semi").select("digest", "body", _arrival(F.col("doc_id")).alias("arrival"))
    every = twisted
    if earlier is not None:
        before = earlier.join(clashes, "digest", "left_semi").select("digest", "arrival", "arrival.file", "arrival.row")
        every = every.unionByName(_contents(before, text).select("digest", "body", "arrival"))
    groups = every.groupBy("digest", "body").agg(F.min("arrival").alias("first"), F.count("*").alias("n"))
    return twisted.join(groups, ["digest", "body"]).select("digest", "arrival", "first", "n")


def unique_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    rows = located(docs)
    return keep_places(rows, dedup_rows(rows, text, doc_id).filter("kept"))
