"""Near-duplicates by the Jaccard similarity of word shingles.

Two texts link if their sets of ``WIDTH``-word shingles have a Jaccard similarity of ``LEAST``
or more; of each connected group one document stays. Candidates are the links of :mod:`simhash`
between fingerprints of the same shingles, found by anchors of a covering code at ``BITS`` or
fewer differing bits. At 0.8 two fingerprints differ in about ten bits, too many for anchors to tell
copies from other texts, so MinHash bands propose as well: ``ROWS`` minima a band, ``BANDS`` bands.
A pair at 0.8 shares no band with a chance of (1 - 0.8^4)^24, about three in a million, and less
above. Texts with equal sets become one node first.

Nodes whose fingerprints link or that share a band are joined into blocks, a star of links for
each fingerprint and band. A block is
only a place to look: its whole texts are fetched and every link is verified on the full
shingle sets. A block of more than ``CHUNK`` shingles is dealt over cells, each pair of its
chunks in one cell. A cell reports a forest that spans what it linked, never the pairs.

A text of fewer words than a shingle has is one shingle. Null texts and texts without words
have the empty set, which equals itself only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import simhash
from panelweave.llm.common import field, keep_places, located
from panelweave.llm.components import connected
from panelweave.llm.simhash import majority, shingle_hashes
from panelweave.session import materialize, small_batches

WIDTH, LEAST = 5, 0.8
BITS = 4  # differing bits at which fingerprints link
BANDS, ROWS = 24, 4
CHUNK = 150_000  # shingles of a block's chunk; a cell holds two
STEP = 2048  # shingles hashed at a time


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"%d" % i, seed) for i in range(n)], np.uint64)


TURN, SCALE, MIX = _numbers(BANDS * ROWS, 1), _numbers(BANDS * ROWS, 2) | np.uint64(1), _numbers(ROWS, 3) | np.uint64(1)
TAG = _numbers(BANDS, 4)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of minima; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        turned = (hashes[None, at : at + STEP] ^ TURN[:, None]) * SCALE[:, None]
        np.minimum(low, turned.min(axis=1), out=low)
    return ((low.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) ^ TAG).view(np.int64)


def sketches(rows: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """``(doc_id, file, row, node, size, fp, bands)`` of located rows; equal sets have the same node."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sizes, prints, found = [], [], [], []
            for t in batch.text:
                every = shingle_hashes(t, width)
                hashes = np.unique(every)
                prints.append(majority(every))
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                found.append(bands(hashes))
            yield batch[["doc_id", "file", "row"]].assign(node=np.array(nodes, np.uint64).view(np.int64), size=sizes, fp=prints, bands=found)

    slim = rows.select(field(rows, doc_id).cast("bigint").alias("doc_id"), "file", "row", field(rows, text).cast("string").alias("text"))
    # Nullable ids would turn into floats in pandas: they travel as text.
    slim = slim.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = slim.mapInPandas(of, "doc_id string, file string, row long, node long, size long, fp long, bands array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def spanned(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links (place, place) that connect what pairs of similarity ``least`` connect."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    holders = owner[np.argsort(which, kind="stable")]
    counts = np.bincount(which)
    begins = np.cumsum(counts) - counts
    upto = np.cumsum(sizes)
    todo = np.ones(len(sets), bool)
    a, b = [], []
    for seed in range(len(sets)):
        if not todo[seed]:
            continue
        todo[seed] = False
        reached = [seed]
        while reached and todo.any():
            x = reached.pop()
            mine = which[upto[x] - sizes[x] : upto[x]]
            n = counts[mine]
            place = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holders[place], minlength=len(sets))
            near = np.nonzero(todo & (common / (sizes[x] + sizes - common) >= least))[0]
            todo[near] = False
            reached += near.tolist()
            a += [x] * len(near)
            b += near.tolist()
    return a, b


def _verify(width: int, least: float):
    def links(nodes: list[int], texts: list[str]) -> Iterator[pd.DataFrame]:
        if len(nodes) > 1:
            a, b = spanned([shingle_set(t, width) for t in texts], least)
            if a:
                at = np.array(nodes, np.int64)
                yield pd.DataFrame({"u": at[a], "v": at[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by cell; the open cell is carried over.
        key, nodes, texts = None, [], []
        for batch in batches:
            for block, cell, node, text in zip(batch.block, batch.cell, batch.node, batch.text):
                if (block, cell) != key:
                    yield from links(nodes, texts)
                    key, nodes, texts = (block, cell), [], []
                nodes.append(node)
                texts.append(text)
        yield from links(nodes, texts)

    return run


def print_links(nodes: DataFrame, threshold: int = BITS) -> DataFrame:
    """``(u, v)`` between nodes of equal or linked fingerprints: a star each, and one link between the stars of linked ones."""
    held = nodes.filter("size > 0")
    prints = materialize(held.groupBy("fp").agg(F.min("node").alias("low")), "near_prints", nodes.count())
    same = held.select("fp", "node").join(prints, "fp").filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    low = lambda side: prints.select(F.col("fp").alias(side), F.col("low").alias(f"{side}_low"))
    near = simhash.links(prints, threshold).join(low("u"), "u").join(low("v"), "v")
    return same.unionByName(near.select(F.col("u_low").alias("u"), F.col("v_low").alias("v")))


def blocks(nodes: DataFrame) -> DataFrame:
    """``(node, block)`` of the nodes whose fingerprint links to, or that share a band with, another, directly or through others."""
    posted = nodes.select(F.explode("bands").alias("band"), "node")
    shared = posted.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    banded = posted.join(shared.select("band", "low"), "band").select(F.col("node").alias("u"), F.col("low").alias("v"))
    stars = connected(banded.unionByName(print_links(nodes)))
    roots = stars.select(F.col("root").alias("node"), F.col("root").alias("block")).distinct()
    return stars.select("node", F.col("root").alias("block")).unionByName(roots)


def links(rows: DataFrame, nodes: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Verified ``(u, v)`` between ``nodes``: they connect what the similarity connects."""
    inside = materialize(nodes.drop("bands", "fp").join(blocks(nodes), "node"), "near_blocks", nodes.count())
    parts = inside.groupBy("block").agg(F.ceil(F.sum("size") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: (k != part) | (F.col("parts") == 1))
    cells = F.transform(others, lambda k: F.least(part, k) * F.col("parts") + F.greatest(part, k))
    inside = inside.join(parts, "block").select("block", "node", "file", "row", F.explode(cells).alias("cell"))
    texts = rows.select("file", "row", field(rows, text).cast("string").alias("text"))
    dealt = inside.join(texts, ["file", "row"]).select("block", "cell", "node", "text")
    size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(size, "block", "cell").sortWithinPartitions("block", "cell")
    return dealt.mapInPandas(_verify(width, least), "u long, v long")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates, the smallest id (null last)."""
    small_batches(docs.sparkSession)
    rows = located(docs)
    prints = materialize(sketches(rows, text, doc_id, width), "sketches")
    nodes = prints.groupBy("node").agg(F.min(F.struct("file", "row")).alias("at"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("node", "at.file", "at.row", "size", "fp", "bands"), "near_nodes", prints.count())
    stars = connected(links(rows, nodes, text, width, least, chunk))
    placed = prints.drop("bands", "size", "fp").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")
    best = placed.groupBy("root").agg(F.min(order).alias("best")).select("best.file", "best.row")
    return keep_places(rows, best)
