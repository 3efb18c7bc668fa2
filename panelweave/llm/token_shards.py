"""Training order on disk: token sequences at permuted slots of fixed-stride shards.

The ids of each task's documents, one closing id after each, run on and are cut into
sequences of fixed length. A task may use as many numbers as its input bytes could need, so
numbers are known without tokenizing twice. A keyed Feistel network over the next even number
of bits, walked until it falls inside the range again, permutes the numbers; ranges of
permuted numbers are the shards. A shard is written in slot order with a fixed stride, and the
counts of the shards before it give every sequence its global slot, without holes.

A reader needs only the manifest: slot s of shard k lies at ``(s - first slot) * stride``, so a
run of slots is one sequential read and can resume anywhere. A task that runs again writes the
same bytes under a name of its own and moves them into place.

Ids are little-endian, 16 bits if the vocabulary allows. Null text is empty and has its closing
id. An empty table gives no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import field, located
from panelweave.llm.tokens import task_tokenizer
from panelweave.session import materialize, new_path

LENGTH = 1024
END = 0
SHARD_SEQUENCES = 16_384  # numbers of a shard's range
KEY = 0x5EED
ROUNDS = 6
NARROW = "slot long, shard long, n_tokens int, doc_ids array<long>, body binary"
WRITTEN = "shard long, place long, n_tokens int, ids_crc32 long, doc_ids array<long>"


def permute(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..size-1, applied to each number."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(key).generate_state(ROUNDS, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    outside = out >= size
    while outside.any():
        out[outside] = once(out[outside])
        outside = out >= size
    return out.astype(np.int64)


def write_shards(
    docs: DataFrame,
    path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str = "byte_bpe_50k.json",
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
    key: int = KEY,
    wide: bool = False,
) -> DataFrame:
    """Write the shards below ``path``; one row per sequence: ``slot, shard, byte_offset, n_tokens, ids_crc32, doc_ids``."""
    spark = docs.sparkSession
    rows = located(docs)
    slim = rows.select(field(rows, doc_id).cast("bigint").cast("string").alias("doc_id"), field(rows, text).cast("string").alias("text"))
    # A byte-level vocabulary makes at most one id of a byte. One number per task comes to the driver.
    need = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    bounds = {r.task: -(-r.ids // length) for r in slim.groupBy(F.spark_partition_id().alias("task")).agg(need.alias("ids")).collect()}
    first, size = {}, 0
    for task in sorted(bounds):
        first[task] = size
        size += bounds[task]
    shards = max(1, -(-size // shard_sequences))
    kind = np.dtype("<u4" if wide else "<u2")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, task = task_tokenizer(vocabulary), TaskContext.get().partitionId()
        used = 0
        pending: list[np.ndarray] = []
        owners: list[tuple] = []
        waiting = 0

        def cut(last: bool) -> pd.DataFrame:
            nonlocal used, pending, owners, waiting
            flat = np.concatenate(pending).astype(kind)
            count = -(-len(flat) // length) if last else len(flat) // length
            lengths = np.minimum(length, len(flat) - np.arange(count) * length)
            padded = np.concatenate([flat, np.full(count * length - len(flat), END, kind)]) if last else flat
            if used + count > bounds[task]:
                raise ValueError(f"task {task} has more tokens than bytes")
            slots = permute(np.arange(first[task] + used, first[task] + used + count), size, key)
            names = [o[0] for o in owners]
            ends = np.cumsum([o[1] for o in owners])
            from_ = np.searchsorted(ends, np.arange(count) * length, side="right")
            to = np.searchsorted(ends, np.arange(count) * length + lengths - 1, side="right")
            out = pd.DataFrame(
                {"slot": slots, "shard": slots // shard_sequences, "n_tokens": lengths.astype(np.int32),
                 "doc_ids": [[n for n in dict.fromkeys(names[a : b + 1]) if n is not None] for a, b in zip(from_, to)],
                 "body": [padded[i * length : (i + 1) * length].tobytes() for i in range(count)]}
            )
            rest = len(flat) - count * length
            used += count
            pending, waiting = ([flat[-rest:]], rest) if rest > 0 else ([], 0)
            keep, tail = rest, []
            for name, n in reversed(owners):
                if keep <= 0:
                    break
                tail.append((name, min(n, keep)))
                keep -= n
            owners = tail[::-1]
            return out

        for batch in batches:
            for name, ids in zip(batch["doc_id"], tokenizer.all_ids(batch["text"].tolist())):
                ids = np.append(ids, np.uint32(END))
                pending.append(ids)
                owners.append((None if pd.isna(name) else int(name), len(ids)))
                waiting += len(ids)
                if waiting >= 2048 * length:
                    yield cut(False)
        if waiting:
            yield cut(True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        attempt = uuid.uuid4().hex
        store, folder = fs.FileSystem.from_uri(path)
        shard, file, place = None, None, 0

        def close() -> None:
            file.close()
            store.move(f"{folder}/_{attempt}-{shard:08d}", f"{folder}/shard-{shard:08d}.bin")

        for batch in batches:
            places = np.empty(len(batch), np.int64)
            for i, (own, body) in enumerate(zip(batch.shard, batch.body)):
                if own != shard:
                    if file is not None:
                        close()
                    shard, place = int(own), 0
                    store.create_dir(folder)
                    file = store.open_output_stream(f"{folder}/_{attempt}-{shard:08d}")
                file.write(body)
                places[i] = place
                place += 1
            crcs = [zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in batch.body]
            yield pd.DataFrame({"shard": batch.shard, "place": places, "n_tokens": batch.n_tokens, "ids_crc32": crcs, "doc_ids": batch.doc_ids})
        if file is not None:
            close()

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.mapInPandas(number, NARROW).repartition(min(width, shards) if shards < width else width, "shard")
    written = materialize(dealt.sortWithinPartitions("shard", "slot").mapInPandas(write, WRITTEN), "written")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    manifest = written.groupBy("shard").agg(F.count("*").alias("sequences"))
    manifest = manifest.select("shard", F.coalesce(F.sum("sequences").over(earlier), F.lit(0)).alias("first_slot"))
    stride = length * kind.itemsize
    return written.join(manifest, "shard").select(
        (F.col("first_slot") + F.col("place")).alias("slot"), "shard", (F.col("place") * stride).alias("byte_offset"), "n_tokens", "ids_crc32", "doc_ids"
    )


def read_run(path: str, shard: int, place: int, count: int, length: int = LENGTH, wide: bool = False) -> np.ndarray:
    """``count`` sequences of a shard from ``place`` on, in one read."""
    from pyarrow import fs

    kind = np.dtype("<u4" if wide else "<u2")
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/shard-{shard:08d}.bin") as file:
        file.seek(place * length * kind.itemsize)
        return np.frombuffer(file.read(count * length * kind.itemsize), kind).reshape(-1, length)


def shard_folder(docs: DataFrame) -> str:
    """A fresh folder for shards in the shared work folder, as a URI."""
    path = new_path(docs.sparkSession, "shards")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
