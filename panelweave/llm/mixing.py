"""Mixing sources to target weights by a splitting tree of exact block quotas.

A source's documents are dealt by hash into blocks of about ``block_words`` words, and a keyed
permutation orders its blocks. The mix takes whole passes over them, then a last pass up to
the word at which the target is met, so a source is met exactly and one document per source
is cut. The blocks so drawn are the source's quota.

Quotas are handed to output shards by recursive halving: the left half of a shard range gets a
multivariate hypergeometric share of every source's remaining blocks. Each leaf then owns a
run of every source's permuted blocks, disjoint from all others, and orders its rows by hash.
All draws are keyed by (seed, node), so any task walks any part of the tree by itself.

Only narrow rows (place, source, words) move; texts are joined once at the end. A source with
a third of all rows is spread by salted joins and over its blocks; running totals are
taken in three bounded steps (block groups, blocks, documents).

Size is the number of words; null text has 0 and is never in the mix. A null source is a
source of its own, the last. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, field, id_key, located
from panelweave.session import materialize

SEED = 20240229
WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0  # words of the mix per word of input; passes over a source at most
BLOCK_WORDS = 4096
SHARD_WORDS = 1_000_000
MOST_BLOCKS = 1 << 28  # the draws need counts well below 1e9: blocks grow beyond that
LIMB = 256  # shards of one task of the tree
BUNDLE = 1024  # sources drawn for together
GROUP = 4096  # blocks of a running total
SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(rows: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """``(file, row, doc_id, source, size, point)``: the narrow rows, stored because all steps read them."""
    key = field(rows, doc_id).cast("bigint")
    narrow = rows.select("file", "row", key.alias("doc_id"), field(rows, source).cast("string").alias("source"), words(field(rows, text).cast("string")).alias("size"))
    return materialize(narrow.withColumn("point", F.xxhash64(id_key(F.col("doc_id")), "size", F.lit(SEED))), "sized")


def targets(narrow: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``(source, rank, source_size, target)``, one row per source.

    Sources stop at ``most`` times their size and the rest is shared by weight. With sources in
    order of cap / weight, those that stop come first, so one pass of running sums finds them.
    The windows see one row per source.
    """
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").cast("binary")
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), name)).cast("bigint") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    left = F.col("all_size") * total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    open_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    # The first source that its cap does not stop sets the level of all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap")))
    return materialize(per.select("source", "rank", "source_size", target.alias("target")), "targets")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def in_blocks(narrow: DataFrame, plan: DataFrame, block_words: int) -> DataFrame:
    """Narrow rows with rank, target and block of their source."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("bigint")
    sides = _salted(plan.withColumn("blocks", blocks))
    salted = narrow.withColumn("salt", F.pmod("point", F.lit(SALTS)).cast("int"))
    same = salted.source.eqNullSafe(sides.source) & (salted.salt == sides.salt)
    joined = salted.join(sides, same).drop(sides.source).drop("salt")
    return joined.withColumn("block", F.pmod(F.xxhash64("point", F.lit(SEED + 1)), F.col("blocks")))


def placed(blocked: DataFrame) -> DataFrame:
    """Narrow rows with ``start``, the words of their source before them in its permuted order."""
    order = F.xxhash64("block", "rank", F.lit(SEED + 2))
    per_block = blocked.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    per_block = per_block.withColumn("order", order)
    # Equal ranges of the hash hold about GROUP blocks each: their order is the order of the hash.
    groups = F.ceil(F.col("blocks") / GROUP)
    share = (F.col("order").cast("double") + 2.0**63) / 2.0**64
    per_block = per_block.withColumn("group", F.floor(share * groups))
    sums = per_block.groupBy("rank", "group").agg(F.sum("words").alias("group_words"), F.count("*").alias("group_blocks"))
    before = Window.partitionBy("rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "rank", "group",
        F.coalesce(F.sum("group_words").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("group_blocks").over(before), F.lit(0)).alias("blocks_before"),
    )
    inside = Window.partitionBy("rank", "group").orderBy("order", "block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.join(sums, ["rank", "group"]).select(
        "rank", "block",
        (F.col("words_before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("block_start"),
        (F.col("blocks_before") + F.row_number().over(inside) - 1).alias("position"),
        F.col("words").alias("block_size"),
    )
    per_block = materialize(per_block, "blocks")
    in_block = Window.partitionBy("rank", "block").orderBy("point", "doc_id", "size", "file", "row").rowsBetween(Window.unboundedPreceding, -1)
    with_start = blocked.withColumn("in_block", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    with_start = with_start.join(per_block, ["rank", "block"])
    return with_start.withColumn("start", F.col("block_start") + F.col("in_block"))


def _split(node: int, part: int, totals: np.ndarray, left: int) -> np.ndarray:
    """Blocks of each colour that go to the left half: one multivariate hypergeometric draw."""
    rng = np.random.default_rng([SEED, node, part])
    return rng.multivariate_hypergeometric(totals, left, method="marginals")


def shares(quotas: np.ndarray, bundle: int, bundles: np.ndarray, shards: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, first block, count)`` per source of a bundle, for the shards in [first, last).

    ``bundles`` are the totals of all bundles, which the draws of a node share out first; the
    bundle's part is then shared out among its sources.
    """
    every = int(bundles.sum())

    def room(a: int, b: int) -> int:
        return every * b // shards - every * a // shards

    def walk(node: int, a: int, b: int, start: np.ndarray, own: np.ndarray, totals: np.ndarray):
        if b <= first or a >= last:
            return
        if b - a == 1:
            yield a, start, own
            return
        middle = (a + b) // 2
        left = _split(node, 0, totals, room(a, middle))
        mine = _split(node, bundle + 1, own, int(left[bundle]))
        yield from walk(2 * node, a, middle, start, mine, left)
        yield from walk(2 * node + 1, middle, b, start + mine, own - mine, totals - left)

    yield from walk(1, 0, shards, np.zeros(len(quotas), np.int64), quotas, bundles)


def shard_table(quotas: DataFrame, shard_words: int, block_words: int) -> DataFrame:
    """``(rank, shard, first, n)``: the run of each source's drawn blocks that a shard owns."""
    spark = quotas.sparkSession
    totals = quotas.groupBy((F.col("rank") / BUNDLE).cast("int").alias("bundle")).agg(F.sum("quota").alias("n")).orderBy("bundle")
    sums = totals.collect()  # one number per BUNDLE sources
    bundles = np.zeros(max([0, *(r.bundle + 1 for r in sums)]), np.int64)
    for r in sums:
        bundles[r.bundle] = r.n
    shards = max(1, -(-int(bundles.sum()) * block_words // shard_words))
    limbs = -(-shards // LIMB)

    def draw(keys: tuple, own: pd.DataFrame) -> pd.DataFrame:
        bundle, limb = (int(k) for k in keys)
        own = own.sort_values("rank")
        ranks, out = own["rank"].to_numpy(), []
        for shard, start, n in shares(own.quota.to_numpy(np.int64), bundle, bundles, shards, limb * LIMB, min(shards, (limb + 1) * LIMB)):
            some = n > 0
            out.append(pd.DataFrame({"rank": ranks[some], "shard": shard, "first": start[some], "n": n[some]}))
        return pd.concat(out) if out else pd.DataFrame({"rank": [], "shard": [], "first": [], "n": []}).astype("int64")

    tasks = quotas.withColumn("limb", F.explode(F.sequence(F.lit(0), F.lit(limbs - 1)))).withColumn("bundle", (F.col("rank") / BUNDLE).cast("int"))
    return tasks.groupBy("bundle", "limb").applyInPandas(draw, "rank long, shard long, first long, n long")


def mix_plan(
    rows: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per located row: ``doc_id, size, source_size, target, taken, draws, file, row``.

    ``draws`` lists each time the mix takes the row: its words, shard and pass.
    """
    narrow = sized(rows, text, source, doc_id)
    plan = targets(narrow, weights, total, most)
    every = plan.agg(F.sum("target")).first()[0] or 0
    block_words = max(block_words, -(-int(every) // MOST_BLOCKS))
    starts = placed(in_blocks(narrow, plan, block_words))
    goal = F.rint("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = goal - passes * F.col("source_size")

    def reached(start: str, size: str) -> Column:
        """Words of the last pass that fall on this stretch."""
        return F.least(F.greatest(rest - F.col(start), F.lit(0)), F.col(size))

    starts = starts.withColumns({"passes": passes, "last": reached("start", "size"), "begun": F.col("block_start") < rest})
    starts = materialize(starts, "placed")
    # Permuted blocks are drawn from the front: position p of pass k is the source's draw k * blocks + p.
    drawn = starts.select("rank", "block", "position", "passes", "begun").distinct()
    drawn = drawn.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    drawn = drawn.filter((F.col("pass") < F.col("passes")) | F.col("begun"))
    in_pass = drawn.groupBy("rank", "pass").agg(F.count("*").alias("n"))
    quotas = materialize(in_pass.groupBy("rank").agg(F.sum("n").alias("quota"), F.max(F.when(F.col("pass") == 0, F.col("n"))).alias("whole")), "quotas")
    runs = shard_table(quotas.select("rank", "quota"), shard_words, block_words)
    number = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw")
    owners = runs.select("rank", "shard", number).join(quotas.select("rank", "whole"), "rank")
    owners = owners.select("rank", "shard", F.expr("draw div whole").alias("pass"), F.expr("draw % whole").alias("position"))
    per_block = drawn.join(owners, ["rank", "pass", "position"])
    per_block = per_block.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("turns"))
    turn = F.transform(
        F.coalesce("turns", F.array().cast("array<struct<pass:bigint,shard:bigint>>")),
        lambda t: F.struct(F.when(t["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("last")).alias("words"), t["shard"].alias("shard"), t["pass"].alias("pass")),
    )
    out = starts.join(per_block, ["rank", "block"], "left")
    out = out.withColumn("draws", F.filter(turn, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws", "file", "row")


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **plan) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are drawn, shard by shard in random order.

    The last document of a source's draw is cut after the word that meets the target.
    """
    rows = located(docs)
    chosen = mix_plan(rows, text, source, doc_id, **plan).filter("taken > 0")
    chosen = chosen.select("file", "row", "size", F.explode("draws").alias("draw"))
    body = field(rows, text).cast("string")
    piece = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    cut = F.array_join(F.slice(F.split(body, piece), 1, F.col("draw.words").cast("int")), "")
    out = rows.join(chosen, ["file", "row"])
    out = out.withColumn("body", F.when(F.col("draw.words") < F.col("size"), cut).otherwise(body))
    out = out.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", F.xxhash64("file", "row", "draw.pass", F.lit(SEED + 3)))
    return out.select(*[F.col("body").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
