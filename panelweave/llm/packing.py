"""Packing documents into sequences by multiway number differencing.

Documents are cut at the capacity: full pieces are sequences of their own, and remainders are
packed. Partitions of a batch start as k-tuples with one remainder each; the two whose
imbalance is largest are merged with opposing order, large against small, until one k-tuple
is left: near-equal windows (Karmarkar and Karp). Where a window exceeds the capacity, the
window count rises by one and the batch is differenced again. Every few remainders are first
cut into small pieces, which even out what whole remainders cannot.

Batches are formed inside a task from the rows in their order, so no group of rows meets in
one place and memory is bounded by a batch; a task that runs again packs the same.

Null text is empty and still holds its closing id. Documents with repeated ids are packed
each on its own. Empty tables give no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.llm.tokens import task_tokenizer
from panelweave.session import small_batches

END = 0
CAPACITY = 1024
BATCH_WINDOWS = 96  # remainders are packed when they fill so many windows
FINE_SHARE, FINE = 0.2, 48  # share of the remainders' tokens cut into pieces of this many tokens
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` subsets with near-equal sums."""
    if windows == 1:
        return [list(range(len(sizes)))]
    # A partial partition: sums of its largest subsets, the other subsets are empty (zero).
    heap = [(-s, i, np.array([s]), [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, a_sets = heapq.heappop(heap)
        _, _, b, b_sets = heapq.heappop(heap)
        # Sums are sorted downwards and taken relative to the smallest of all windows.
        overlap = len(a) + len(b) - windows
        if overlap <= 0:
            sums, sets = np.concatenate([a, b]), a_sets + b_sets
        else:
            tail = a[-overlap:] + b[-overlap:][::-1]
            sums = np.concatenate([a[:-overlap], b[:-overlap], tail])
            joined = [x + y for x, y in zip(a_sets[-overlap:], reversed(b_sets[-overlap:]))]
            sets = a_sets[:-overlap] + b_sets[:-overlap] + joined
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], [sets[i] for i in order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tick, sums, sets))
        tick += 1
    sets = heap[0][3]
    return sets + [[] for _ in range(windows - len(sets))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; each size is at most the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, count)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        count += 1


def padded(length: int, capacity: int = CAPACITY) -> int:
    """Stored length of a sequence: the capacity, unless it is a power of two."""
    return length if length & (length - 1) == 0 else capacity


class Packer:
    """Collects pieces of one task and numbers its sequences."""

    def __init__(self, task: int, capacity: int):
        self.next = task << 33
        self.capacity = capacity
        self.waiting: list[tuple] = []
        self.tokens = 0
        self.fine_due = 0.0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """Pieces that are placed by now."""
        total, done = len(ids), []
        full = total - total % self.capacity
        for start in range(0, full, self.capacity):
            done.append((doc_id, start, self.capacity, _crc(ids[start : start + self.capacity]), total, self.next, 0))
            self.next += 1
        rest = total - full
        if rest:
            self.fine_due += rest * FINE_SHARE
            step = rest
            if self.fine_due >= rest:
                self.fine_due -= rest
                step = FINE
            for start in range(full, total, step):
                end = min(start + step, total)
                self.waiting.append((doc_id, start, end - start, _crc(ids[start:end]), total))
            self.tokens += rest
        if self.tokens >= BATCH_WINDOWS * self.capacity:
            done += self.flush()
        return done

    def flush(self) -> list[tuple]:
        done = []
        if self.waiting:
            for window in windows([p[2] for p in self.waiting], self.capacity):
                offset = 0
                for i in window:
                    done.append((*self.waiting[i], self.next, offset))
                    offset += self.waiting[i][2]
                self.next += 1
        self.waiting, self.tokens = [], 0
        return done


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its place in its document and in its sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, packer = task_tokenizer(vocabulary), Packer(TaskContext.get().partitionId(), capacity)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def table(pieces: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(pieces, columns=names)
            return out.astype({"doc_id": "Int64"} | {c: "int64" for c in names[1:]})

        for batch in batches:
            pieces = []
            for key, ids in zip(batch["doc_id"], tokenizer.all_ids(batch["text"].tolist())):
                pieces += packer.add(None if pd.isna(key) else int(key), np.append(ids, np.uint32(END)))
            yield table(pieces)
        yield table(packer.flush())

    small_batches(docs.sparkSession)
    # Ids travel as text: a long column with nulls would pass through floating point.
    slim = docs.select(quoted(doc_id).cast("bigint").cast("string").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return slim.mapInPandas(run, PIECES)
