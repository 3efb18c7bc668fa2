"""Near-duplicates by SimHash, found through anchor points of a covering code.

A document's fingerprint has a bit set where over half of its word shingles' hashes have it.
Fingerprints link at ``threshold`` or fewer differing bits. Equal fingerprints become one
node first, so thousands of exact copies cost one row.

The 64 bits are cut in two halves. If two fingerprints differ in at most k bits, they differ
in at most k // 2 bits of the first half or in at most k - 1 - k // 2 bits of the second. In
each half the anchors are the words of a covering code: [15, 11] Hamming words side by side
(covering radius 1 each), the bits left over as they are. A fingerprint's home is the anchor
within the covering radius; it is replicated to every anchor that is the home of a word
within the half's share of the threshold, all of which lie within radius plus share. Two
linked fingerprints therefore meet at the home of either, and only homes are compared with
visitors, on all 64 bits.

An anchor with many homes (a large group of near copies) is dealt over cells, home chunks
times visitor chunks. A cell reports a forest that spans what it linked, never the pairs.

Null text and text without words have fingerprint zero, and link like any other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import field, keep_places, located
from panelweave.llm.components import connected
from panelweave.session import materialize, small_batches

HASH_SEED = 42
BLOCK = 15  # bits of a Hamming word
HALF = 32
CELL = 2048  # homes of an anchor compared in one cell
PAIRS = 4_000_000  # comparisons held in memory at once


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of the text's word shingles, repeats included; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], HASH_SEED) for a, z in zip(starts, last)), np.uint64, len(last))


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little")
    return int(most.view("<i8")[0])


def fingerprints(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4) -> DataFrame:
    """``(doc_id, file, row, fp)`` of located rows."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    small_batches(rows.sparkSession)
    return rows.select(
        field(rows, doc_id).cast("bigint").alias("doc_id"), "file", "row", of(field(rows, text).cast("string")).alias("fp")
    )


def _correction() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 15-bit word, and the flip that mends each syndrome."""
    words = np.arange(1 << BLOCK)
    syndrome = np.zeros(1 << BLOCK, np.uint8)
    for j in range(BLOCK):
        syndrome ^= (((words >> j) & 1) * (j + 1)).astype(np.uint8)
    return syndrome, np.array([0, *(1 << j for j in range(BLOCK))], np.uint64)


class Anchors:
    """The covering code of one half: homes, and the anchors a word within ``flips`` may have."""

    def __init__(self, flips: int, width: int = HALF):
        self.syndrome, self.mend = _correction()
        self.blocks = width // BLOCK
        errors = [0]
        for k in range(1, flips + 1):
            errors += [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), k)]
        errors = np.array(errors, np.uint64)
        moved = self.classes(errors)
        reach = []
        for c in range(16**self.blocks):
            own = self.repair(np.array([c]))
            reach.append(np.unique(errors ^ self.repair(moved ^ c) ^ own))
        most = max(map(len, reach))
        self.delta = np.zeros((len(reach), most), np.uint64)
        self.used = np.zeros((len(reach), most), bool)
        for c, d in enumerate(reach):
            self.delta[c, : len(d)] = d
            self.used[c, : len(d)] = True

    def classes(self, words: np.ndarray) -> np.ndarray:
        """The syndromes of a word's blocks as one number; the code is linear, so they add up by xor."""
        out = np.zeros(len(words), np.int64)
        for b in range(self.blocks):
            part = (words >> np.uint64(BLOCK * b)) & np.uint64((1 << BLOCK) - 1)
            out |= self.syndrome[part.astype(np.int64)].astype(np.int64) << (4 * b)
        return out

    def repair(self, classes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes), np.uint64)
        for b in range(self.blocks):
            out |= self.mend[(classes >> (4 * b)) & 15] << np.uint64(BLOCK * b)
        return out

    def homes(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.repair(self.classes(words))

    def visits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the word and anchor, for every anchor that it is replicated to."""
        classes = self.classes(words)
        anchors = (words ^ self.repair(classes))[:, None] ^ self.delta[classes]
        used = self.used[classes]
        return np.nonzero(used)[0], anchors[used]


def _codes(threshold: int) -> list[tuple[int, Anchors]]:
    """(shift, code) of each half that can hold a link."""
    shares = [(0, threshold // 2), (HALF, threshold - 1 - threshold // 2)]
    return [(shift, Anchors(t)) for shift, t in shares if t >= 0]


def _placed(nodes: DataFrame, threshold: int, visitors: bool) -> DataFrame:
    """``(anchor, fp, home)`` rows: homes alone, or homes and visitors."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _codes(threshold)
        for batch in batches:
            fps = batch.fp.to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                for half, (shift, code) in enumerate(codes):
                    some = fps[at : at + 4096]
                    words = (some >> np.uint64(shift)) & np.uint64((1 << HALF) - 1)
                    tag = np.uint64(half << HALF)
                    homes = (code.homes(words) | tag).view(np.int64)
                    yield pd.DataFrame({"anchor": homes, "fp": some.view(np.int64), "home": True})
                    if visitors:
                        who, anchors = code.visits(words)
                        yield pd.DataFrame({"anchor": (anchors | tag).view(np.int64), "fp": some[who].view(np.int64), "home": False})

    return nodes.select("fp").mapInPandas(place, "anchor long, fp long, home boolean")


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between a and b reduced to (node, root), one per node that is no root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _compare(threshold: int):
    def links(homes: np.ndarray, home_group: np.ndarray, visitors: np.ndarray, group: np.ndarray) -> Iterator[pd.DataFrame]:
        """Visitors against the homes of their group, a bounded number of pairs at a time."""
        first = np.searchsorted(home_group, group)
        count = np.searchsorted(home_group, group, side="right") - first
        seen = count > 0
        first, count, visitors = first[seen], count[seen], visitors[seen]
        upto = np.cumsum(count)
        at = 0
        while at < len(count):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            n = count[at:end]
            place = np.repeat(first[at:end] - (upto[at:end] - n - done), n) + np.arange(n.sum())
            a, b = homes[place], np.repeat(visitors[at:end], n)
            near = (np.bitwise_count(a ^ b) <= threshold) & (a != b)
            if near.any():
                node, root = spanning_forest(a[near], b[near])
                yield pd.DataFrame({"u": node.view(np.int64), "v": root.view(np.int64)})
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by cell, homes first: the homes of the open cell are carried over.
        key, homes = None, np.empty(0, np.uint64)
        for batch in batches:
            anchor, cell = batch.anchor.to_numpy(), batch.cell.to_numpy()
            fp, home = batch.fp.to_numpy().view(np.uint64), batch.home.to_numpy()
            fresh = np.empty(len(fp), bool)
            fresh[0] = key is not None and key != (anchor[0], cell[0])
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])
            group = np.cumsum(fresh)
            kept = homes if not fresh[0] else homes[:0]
            all_homes = np.concatenate([kept, fp[home]])
            home_group = np.concatenate([np.zeros(len(kept), group.dtype), group[home]])
            yield from links(all_homes, home_group, fp[~home], group[~home])
            key = (anchor[-1], cell[-1])
            homes = all_homes[home_group == group[-1]]

    return run


def links(nodes: DataFrame, threshold: int = 4, cell: int = CELL) -> DataFrame:
    """``(u, v)`` between distinct fingerprints ``nodes.fp``: they connect what the threshold connects."""
    crowded = _placed(nodes, threshold, visitors=False).groupBy("anchor").agg(F.count("*").alias("homes"))
    crowded = crowded.filter(F.col("homes") > cell).select("anchor", F.ceil(F.col("homes") / cell).cast("int").alias("parts"))
    crowded = materialize(crowded, "crowded_anchors")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    others = F.sequence(F.lit(0), parts - 1)
    # Cell (i, j) holds home chunk i and visitor chunk j.
    cells = F.transform(others, lambda k: F.when(F.col("home"), part * parts + k).otherwise(k * parts + part))
    dealt = _placed(nodes, threshold, visitors=True).join(crowded, "anchor", "left")
    dealt = dealt.select("anchor", "fp", "home", F.explode(cells).alias("cell"))
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(width, "anchor", "cell").sortWithinPartitions("anchor", "cell", F.col("home").desc())
    return dealt.mapInPandas(_compare(threshold), "u long, v long")


def near_duplicates(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """Rows of :func:`fingerprints` with ``component_id``, the smallest id reachable (null if none has an id).

    ``prints`` is read several times and should be stored.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    stars = connected(links(nodes, threshold))
    placed = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = placed.select("fp", "root").join(smallest, "root")
    return prints.join(component, "fp")


def simhash(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, threshold: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, one row per document."""
    prints = materialize(fingerprints(located(docs), text, doc_id, width), "simhash")
    out = near_duplicates(prints, threshold)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, threshold: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates, the smallest id (null last)."""
    rows = located(docs)
    prints = materialize(fingerprints(rows, text, doc_id, width), "simhash")
    found = near_duplicates(prints, threshold)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select("best.file", "best.row")
    return keep_places(rows, best)
