"""The trie of conversation prefixes, with totals over subtrees by depth-band rollup.

Every distinct sequence of the first d turns (role, text) is a node of depth d below a textless
root; the conversations that start with it are its members. A node is known by its depth and 128
bits: the sum, word by word, of hashes of (position, SHA-256 of the turn). Sums of parts
add up, so a conversation of any length is folded in blocks by different tasks.

Totals over subtrees go up by bands of ``height`` levels. A node explodes only to its ancestors
in its own band; the tops of the bands, with what they hold so far, are a trie of their own,
``height`` times flatter, and rolled up the same way; their completed totals then explode to
the ancestors in the band above. A node is copied ``height`` times at most, and the rounds
grow with the logarithm of the depth.

Turns are ordered by number (null first), then role, text and place; null role or text is empty.
Rows without a conversation id take no part. A conversation's turns are sorted in ranges, so
one that holds a third of all rows lies in many tasks. Repeated rows are turns of their own.
An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import field, join_spread, located
from panelweave.session import materialize

HEIGHT = 8  # levels of a band
BLOCK = 1024  # turns of a conversation folded by one task
PIECE = 256  # ids written as one piece of text
KEY = ["depth", "n1", "n2"]  # what a node is known by
WORDS = ["s1", "s2", "s3", "s4"]
LOW = (1 << 32) - 1


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, rank, digest, bytes, n)``: each turn's place in its conversation, from 0, and the conversation's length.

    Rows are sorted in ranges; within a range the turns of a conversation are numbered on, and
    each of its ranges is told how many lie before.
    """
    rows = located(rows)
    empty = F.lit("")
    wide = rows.select(
        field(rows, conv_id).cast("bigint").alias("c"),
        field(rows, turn).alias("turn"),
        F.coalesce(field(rows, role).cast("string"), empty).alias("role"),
        F.coalesce(field(rows, text).cast("string"), empty).alias("text"),
        "file",
        "row",
    ).filter("c is not null")
    order = ["c", "turn", "role", "text", "file", "row"]
    lined = wide.repartitionByRange(*order).sortWithinPartitions(*order)
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    lined = lined.select(
        "c",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("line"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    lined = materialize(lined, "turns")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = lined.groupBy("c", "part").agg(F.count("*").alias("own"), F.min("line").alias("first"))
    runs = runs.select(
        "c", "part", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"), F.sum("own").over(whole).alias("n")
    )
    rank = F.col("ahead") + F.col("line") - F.col("first")
    return materialize(lined.join(runs, ["c", "part"]).select("c", rank.alias("rank"), "digest", "bytes", "n"), "ranked_turns")


def sequences(turns: DataFrame) -> DataFrame:
    """The conversations as they are: ``(c, depth, digest, bytes, total)``, with a row of depth 0 each."""
    own = turns.select("c", (F.col("rank") + 1).alias("depth"), "digest", "bytes", F.col("n").alias("total"))
    return own.unionByName(_roots(turns.select("c", F.col("n").alias("total")).distinct()))


def grafted(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt on the heads of others, as :func:`sequences`.

    Conversation c takes the first h = crc32(c) mod ``most`` turns of c - c mod ``group`` (all if
    that has fewer, none if it is absent), then its own after its first h.
    """
    lengths = turns.groupBy("c").agg(F.max("n").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    convs = lengths.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    bases = lengths.filter(F.col("c") % group == 0).select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left")
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    total = given + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = materialize(convs.select("c", "base", "h", given.alias("given"), total.alias("total")), "grafts")

    # A conversation's own turns need h and what it was given: both follow from its id but for
    # the length of the base, which differs from h only where the base is short.
    short = convs.filter("given < h").select("c", "given", "total", F.greatest("total", F.lit(1)).alias("weight"))
    own_h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    tails = turns.withColumn("h", own_h).filter("rank >= h")
    tails = join_spread(tails, short, ["c"], "weight", "left")
    shift = F.coalesce("given", "h") - F.col("h")
    tails = tails.select(
        "c",
        (F.col("rank") + shift + 1).alias("depth"),
        "digest",
        "bytes",
        F.coalesce("total", "n").alias("total"),
    )
    heads = turns.filter((F.col("c") % group == 0) & (F.col("rank") < most - 1))
    heads = heads.select(F.col("c").alias("base"), "rank", "digest", "bytes")
    heads = heads.join(convs.filter("given > 0").select("c", "base", "given", "total"), "base").filter("rank < given")
    heads = heads.select("c", (F.col("rank") + 1).alias("depth"), "digest", "bytes", "total")
    return tails.unionByName(heads).unionByName(_roots(convs.select("c", "total")))


def _roots(convs: DataFrame) -> DataFrame:
    return convs.select(
        "c", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("bytes"), "total"
    )


def paths(seqs: DataFrame) -> DataFrame:
    """Each conversation's way down: ``(c, depth, n1, n2, p1, p2, bytes, ends)`` with the node's and its parent's key."""
    words = []
    for seed in (1, 2):
        turn = F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(F.lit(0).cast("bigint"))
        words += [turn.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(turn, 32)]
    termed = seqs.select("c", "depth", F.expr(f"depth div {BLOCK}").alias("block"), "bytes", "total", *[w.alias(s) for w, s in zip(words, WORDS)])
    # Blocks of long conversations: what lies before each.
    blocks = termed.filter(F.col("total") >= BLOCK).groupBy("c", "block").agg(*[F.sum(s).alias(s) for s in WORDS])
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("c", "block", *[F.sum(s).over(before).alias(f"a{s}") for s in WORDS])
    within = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = termed.select("c", "depth", "block", "bytes", "total", *WORDS, *[F.sum(s).over(within).alias(f"w{s}") for s in WORDS])
    summed = summed.join(ahead, ["c", "block"], "left")
    upto = {s: F.coalesce(F.col(f"a{s}"), F.lit(0)) + F.col(f"w{s}") for s in WORDS}
    node = [_packed(upto["s1"], upto["s2"]), _packed(upto["s3"], upto["s4"])]
    above = [_packed(upto[a] - F.col(a), upto[b] - F.col(b)) for a, b in (("s1", "s2"), ("s3", "s4"))]
    out = summed.select(
        "c", "depth", node[0].alias("n1"), node[1].alias("n2"), above[0].alias("p1"), above[1].alias("p2"), "bytes",
        (F.col("depth") == F.col("total")).alias("ends"),
    )
    return materialize(out, "paths")


def _packed(low: Column, high: Column) -> Column:
    return low.bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(LOW)), 32))


def _in_bands(way: DataFrame, stride: int, height: int) -> DataFrame:
    """Nodes at every ``stride``-th depth of each way, with the keys ``up``: their ancestors in the band and themselves.

    The top of a band, but for the root, is listed a second time (``carry``) below the band above it.
    """
    top = stride * height
    band = F.expr(f"depth div {top}")
    bands = F.when((F.col("depth") % top == 0) & (F.col("depth") > 0), F.array(band, band - 1)).otherwise(F.array(band))
    listed = way.filter(F.col("depth") % stride == 0).withColumn("band", F.explode(bands))
    upto = Window.partitionBy("c", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return listed.select("*", (F.col("band") < band).alias("carry"), F.collect_list(F.struct(*KEY)).over(upto).alias("up"))


def _climbed(listed: DataFrame, values: DataFrame, own: bool) -> DataFrame:
    """The values of nodes added up at their listed ancestors."""
    up = F.col("up") if own else F.slice("up", 1, F.size("up") - 1)
    found = listed.join(values, KEY).select(F.explode(up).alias("a"), "n_leaves", "saved")
    return _added(found.select(*[F.col("a")[k].alias(k) for k in KEY], "n_leaves", "saved"))


def _added(values: DataFrame) -> DataFrame:
    return values.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _rolled(way: DataFrame, listed: DataFrame, values: DataFrame, deepest: int, stride: int, height: int) -> DataFrame:
    """Totals over subtrees, of the nodes at every ``stride``-th depth."""
    inside = materialize(_climbed(listed.filter("not carry"), values, True), "band_totals")
    top = stride * height
    if deepest < top:
        return inside
    above = _in_bands(way, top, height).groupBy(*KEY, "carry").agg(F.first("up").alias("up"))
    done = _rolled(way, materialize(above, "band_tops"), inside.filter(F.col("depth") % top == 0), deepest, top, height)
    carried = _climbed(listed.filter("carry"), done, False)
    return materialize(_added(inside.unionByName(carried)), "subtree_totals")


def trie(way: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of :func:`paths`: key, ``conv_id`` (smallest member), ``parent_conv_id, n_convs, n_children, n_leaves, saved``.

    ``saved`` is, over the subtree, the bytes of a node's last text for every member but one.
    """
    if height < 2:
        raise ValueError("a band has two levels or more")
    nodes = _in_bands(way, 1, height).groupBy(*KEY, "carry").agg(
        F.min("c").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.first("up").alias("up"),
    )
    listed = materialize(nodes, "trie_nodes")
    nodes = listed.filter("not carry").drop("carry", "up")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), KEY, "left").fillna(0, ["n_children"])
    nodes = materialize(nodes, "counted_nodes")
    leaf = (F.col("n_children") == 0).cast("bigint")
    values = nodes.select(*KEY, leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = _rolled(way, listed, values, deepest, 1, height)
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("weight"),
    )
    named = join_spread(nodes, parents, ["depth", "p1", "p2"], "weight", "left")
    named = named.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children")
    return named.join(totals, KEY)


def ends(way: DataFrame) -> DataFrame:
    """Per node where conversations end: SHA-256 of their ids, ascending, joined by commas.

    Sorted ranges of ids become pieces of text first, so that a node where a third of all
    conversations end is hashed from a stream of few rows.
    """
    order = ["n1", "n2", "depth", "c"]
    last = way.filter("ends").select(*order)
    lined = last.repartitionByRange(*order).sortWithinPartitions(*order)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[["n1", "n2", "depth"]].to_numpy()
            new = np.nonzero(np.any(keys[1:] != keys[:-1], axis=1))[0] + 1
            ids = batch["c"].to_numpy().tolist()
            starts, pieces = [], []
            for a, b in zip([0, *new], [*new, len(ids)]):
                for at in range(a, b, PIECE):
                    starts.append(at)
                    pieces.append(",".join(map(str, ids[at : min(b, at + PIECE)])))
            out = batch.iloc[starts].copy()
            out["ids"] = pieces
            yield out

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for n1, n2, depth, ids in zip(batch["n1"], batch["n2"], batch["depth"], batch["ids"]):
                if (n1, n2, depth) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (n1, n2, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["n1", "n2", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["n1", "n2", "depth", "ends_sha256"])

    pieces = lined.mapInPandas(written, "n1 long, n2 long, depth long, c long, ids string")
    dealt = pieces.repartition("n1", "n2", "depth").sortWithinPartitions(*order)
    return dealt.mapInPandas(hashed, "n1 long, n2 long, depth long, ends_sha256 string")


def trie_digests(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of the grafted conversations with a digest of who ends at each node."""
    way = paths(grafted(ordered_turns(conversations)))
    nothing = hashlib.sha256().hexdigest()
    found = trie(way, height).join(ends(way), KEY, "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
