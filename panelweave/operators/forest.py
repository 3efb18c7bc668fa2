"""Random forests, grown by Spark aggregations.

Rows lie in blocks with a byte per predictor, as for boosting. All trees grow side by side: a level is one pass in which
a task sums its rows per (tree, leaf, predictor, bin), a leaf's predictors being its own draw of them, and a shuffle by
leaf that adds the tasks' sums and finds the best cut of each leaf; only that cut reaches the driver. A task lays its rows
in the order of their leaves, so that it sums one leaf after another.

A tree sees each row as often as a Poisson draw with mean 1 says, which follows from the tree and the row's place in its
block: it is the same in every pass and not stored. A cut is the one that lowers the squared error most and leaves ``min_n``
draws on both sides. Ties go to the lower predictor, then the lower cut.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.boosting import (
    BLOCK,
    BLOCKS,
    CELLS_HELD,
    ROWS_AT_ONCE,
    Binned,
    BoostedTrees,
    Tree,
    _binned,
    _known,
    _matrix,
    _packed,
    _unpacked,
    quantile_edges,
)
from panelweave.session import materialize

# The sums travel to the workers with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_HELD = 1_000_000  # rows a task lays in the order of their leaves at a time
ROWS_SUMMED = 4096  # rows whose cells are summed at a time
LEAVES_A_PART = 64  # leaves whose sums travel together
NODES_IN_PLAN = 50_000  # trees of more nodes are no constants of a plan
CUTS = "part int, place int, predictor int, bin int, low_n double, low_g double, n double, g double"


@dataclass
class Forest(BoostedTrees):
    """Grown trees whose leaves are worth their share of the mean; rows walk them in Python tasks, as they are too many for a plan."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.arrow_udf(_mean_of(self), "double")(vector_to_array("features")))


@dataclass(frozen=True)
class _Open:
    """The leaves of one tree that a level may cut, with the predictors drawn for each; parts are numbered over all trees."""

    number: int
    tree: Tree
    leaves: list[int]
    predictors: np.ndarray
    first_part: int


@dataclass(frozen=True)
class RandomForest:
    """A forest to be fitted to rows of ``value`` and a ``features`` vector; a leaf's cut is among a third of the predictors."""

    trees: int = 500
    min_n: int = 5
    depth: int = 12
    bins: int = 32
    seed: int = 0

    def copy(self) -> "RandomForest":
        return self

    def prepare(self, rows: DataFrame) -> Binned:
        """Binned rows, dealt over as many tasks as run at once: each task sends sums of every leaf."""
        value = F.col("value").cast("double")
        odd = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(math.inf))
        base, n_odd = rows.agg(F.avg(value), F.count_if(odd)).first()
        if n_odd:
            raise ValueError(f"{n_odd} rows without a finite value")
        if base is None:
            raise ValueError("no rows to fit")
        known = _known(rows)
        edges = quantile_edges(known, None, self.bins, rare=True)
        blocks = known.mapInArrow(_finite_binned(edges, float(base)), BLOCKS)
        placed = blocks.select("value", "bins", F.monotonically_increasing_id().alias("draw"))
        width = rows.sparkSession.sparkContext.defaultParallelism
        return Binned(materialize(placed.repartition(width, "draw"), "forest"), edges, float(base), len(edges))

    def fit(self, rows: DataFrame) -> Forest:
        binned = self.prepare(rows)
        trees = [Tree() for _ in range(self.trees)]
        open_ = {number: [tree.add()] for number, tree in enumerate(trees)}
        for level in range(self.depth):
            open_ = self._cut(trees, open_, level, binned)
            if not open_:
                break
        for tree in trees:
            tree.cut = [binned.edges[f][int(c)] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
            tree.value = [v / self.trees for v in tree.value]
        return Forest(binned.base, trees, self.depth, binned.n_features)

    def _cut(self, trees: list[Tree], open_: dict[int, list[int]], level: int, binned: Binned) -> dict[int, list[int]]:
        """Cuts the open leaves where that gains; returns those of the next level."""
        jobs, part_of = [], []
        for number, leaves in open_.items():
            drawn = self._predictors(number, level, len(leaves), binned.n_features)
            jobs.append(_Open(number, trees[number], leaves, drawn, len(part_of)))
            part_of += [jobs[-1]] * -(-len(leaves) // LEAVES_A_PART)
        sums = binned.blocks.mapInArrow(_leaf_sums(jobs, level, binned, self.seed), "part int, n binary, g binary")
        cells = jobs[0].predictors.shape[1], binned.width
        found = sums.groupBy("part").applyInPandas(_best_cuts(cells, self.min_n), CUTS).collect()
        ahead: dict[int, list[int]] = {}
        for r in sorted(found, key=lambda r: (r.part, r.place)):
            job = part_of[r.part]
            at = (r.part - job.first_part) * LEAVES_A_PART + r.place
            tree, leaf = job.tree, job.leaves[at]
            tree.value[leaf] = r.g / r.n
            if r.predictor < 0:
                continue
            low, high = tree.add(), tree.add()
            tree.feature[leaf], tree.cut[leaf] = int(job.predictors[at, r.predictor]), r.bin
            tree.left[leaf], tree.right[leaf] = low, high
            for child, n, g in ((low, r.low_n, r.low_g), (high, r.n - r.low_n, r.g - r.low_g)):
                tree.value[child] = g / n
                if n >= 2 * self.min_n:
                    ahead.setdefault(job.number, []).append(child)
        return ahead

    def _predictors(self, number: int, level: int, leaves: int, n_features: int) -> np.ndarray:
        """A third of the predictors for each leaf, in order."""
        wanted = math.ceil(n_features / 3)
        drawn = np.random.default_rng([self.seed, number, level]).random((leaves, n_features))
        return np.sort(np.argsort(drawn, axis=1)[:, :wanted], axis=1)


# --- what a task does with its rows ---------------------------------------------


def _finite_binned(edges: list[list[float]], base: float) -> Callable:
    """Blocks of rows whose predictors are all finite."""
    binned = _binned(edges, base)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not np.isfinite(_matrix(batch.column("x"))).all():
                raise ValueError("a predictor is not finite")
            yield batch

    return lambda batches: binned(checked(batches))


def _mean_of(forest: Forest) -> Callable:
    """The mean of the trees for arrays of predictors."""
    one, roots = forest.joined()
    feature, left, right = (np.array(v, np.int64) for v in (one.feature, one.left, one.right))
    cut, value, base, depth = np.array(one.cut, float), np.array(one.value, float), float(forest.base), forest.depth

    def run(x: pa.Array) -> pa.Array:
        known = _matrix(x)
        flat, start = known.ravel(), np.arange(len(known)) * (known.shape[1] if known.size else 0)
        total = np.full(len(known), base)
        for root in roots:
            node = np.full(len(known), root)
            for _ in range(depth):
                own = feature[node]
                low = flat[start + np.maximum(own, 0)] <= cut[node]
                node = np.where(low | (own < 0), left[node], right[node])
            total += value[node]
        return pa.array(total)

    return run


def _draws(rows: np.ndarray, number: int, seed: int) -> np.ndarray:
    """How often a tree sees each row: a Poisson draw with mean 1 from a mix of the numbers of tree and row."""
    start = np.random.SeedSequence([seed, number]).generate_state(1, np.uint64)[0]
    mixed = (rows ^ start) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    share = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    times, below, chance = np.zeros(len(rows), np.uint8), 0.0, math.exp(-1)
    for k in range(1, 18):
        below += chance
        chance /= k
        times += share >= below
    return times


def _leaf_sums(jobs: list[_Open], level: int, binned: Binned, seed: int) -> Callable:
    """Per part of the open leaves the draws and the summed values of every (leaf, predictor drawn, bin), over the rows of a task."""
    n_features, width, kind, base = binned.n_features, binned.width, binned.kind, binned.base
    wanted = jobs[0].predictors.shape[1]
    first_cell = np.arange(wanted) * width  # of each predictor drawn
    at_once = max(1, CELLS_HELD // (wanted * width) // LEAVES_A_PART) * LEAVES_A_PART  # leaves
    plans = []
    for job in jobs:
        feature, cut, left = np.array(job.tree.feature), np.array(job.tree.cut, np.int64), np.array(job.tree.left)
        done = feature < 0
        place = np.full(len(feature), -1)
        place[job.leaves] = np.arange(len(job.leaves))
        # A leaf leads to itself: no bin lies above its cut. The right child follows the left one.
        nodes = np.array([np.where(done, 0, feature), np.where(done, 1 << 20, cut), left, place], np.int32)
        plans.append((job.number, nodes, job.predictors.astype(np.int32), job.first_part))

    def leaves_of(plan: tuple, flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The place of the open leaf of each row, or -1."""
        feature, cut, left, place = plan[1].astype(np.int64)
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            start = rows[at : at + ROWS_AT_ONCE] * n_features
            node = np.zeros(len(start), np.int64)
            for _ in range(level):
                node = left.take(node) + (flat.take(start + feature.take(node)) > cut.take(node))
            out[at : at + ROWS_AT_ONCE] = place.take(node)
        return out

    def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        value, flat, number = (np.concatenate(some) for some in zip(*held))
        for plan in plans:
            predictors, first_part = plan[2].astype(np.int64), plan[3]
            times = _draws(number, plan[0], seed)
            rows = np.nonzero(times)[0]
            leaf = leaves_of(plan, flat, rows)
            rows, leaf = rows[leaf >= 0], leaf[leaf >= 0]
            order = np.argsort(leaf.astype(np.uint16) if len(predictors) < 1 << 16 else leaf, kind="stable")
            rows, leaf = rows[order], leaf[order]
            n, start = times[rows].astype(float), rows * n_features
            g = n * (value[rows] - base)
            for low in range(0, len(predictors), at_once):
                high = min(low + at_once, len(predictors))
                sums = np.zeros((2, high - low, wanted * width))
                begin, end = np.searchsorted(leaf, (low, high))
                for at in range(begin, end, ROWS_SUMMED):
                    some = slice(at, min(at + ROWS_SUMMED, end))
                    first, last = int(leaf[some][0]), int(leaf[some][-1])
                    place = predictors.take(leaf[some], axis=0)
                    place += start[some, None]
                    cell = flat.take(place) + first_cell
                    cell += (leaf[some, None] - first) * (wanted * width)
                    for total, each in zip(sums, (n, g)):
                        added = np.bincount(cell.ravel(), np.repeat(each[some], wanted), (last - first + 1) * wanted * width)
                        total[first - low : last - low + 1] += added.reshape(-1, wanted * width)
                ends = np.append(np.arange(LEAVES_A_PART, high - low, LEAVES_A_PART), high - low)
                part = np.arange(len(ends), dtype=np.int32) + first_part + low // LEAVES_A_PART
                columns = [pa.array(part, pa.int32()), _packed(sums[0].astype(np.uint32), ends), _packed(sums[1], ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pc.binary_length(batch.column("value")).to_numpy() // 8
            first = np.repeat(batch.column("draw").to_numpy() * BLOCK, rows)
            within = np.arange(len(first)) - np.repeat(np.cumsum(rows) - rows, rows)
            held.append((_unpacked(batch.column("value")), _unpacked(batch.column("bins"), kind), (first + within).astype(np.uint64)))
            size += len(first)
            if size >= ROWS_HELD:
                yield from out(held)
                held, size = [], 0
        if size:
            yield from out(held)

    return run


def _best_cuts(cells: tuple[int, int], min_n: int) -> Callable:
    """The best cut of each leaf of a part from the sums of all tasks; predictor -1 where no cut gains."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        n, g = 0.0, 0.0
        for its_n, its_g in zip(parts["n"], parts["g"]):
            n = n + np.frombuffer(its_n, np.uint32).reshape(-1, *cells)
            g = g + np.frombuffer(its_g).reshape(-1, *cells)
        low_n, low_g = np.cumsum(n, axis=2), np.cumsum(g, axis=2)
        all_n, all_g = low_n[:, :1, -1:], low_g[:, :1, -1:]
        high_n, high_g = all_n - low_n, all_g - low_g
        square = lambda s, k: np.divide(s * s, k, out=np.zeros_like(s), where=k > 0)
        whole, split = square(all_g, all_n), square(low_g, low_n) + square(high_g, high_n)
        gain = np.where((low_n >= min_n) & (high_n >= min_n) & (split - whole > 1e-12 * split), split - whole, 0.0)
        share, power = np.frexp(gain)
        ranked = np.ldexp(np.round(share * 2.0**30), power).reshape(len(gain), -1)  # what differs by the order of additions counts as equal
        at, leaf = ranked.argmax(axis=1), np.arange(len(gain))
        predictor, cut = np.divmod(at, cells[1])
        found = {
            "part": parts["part"].iloc[0], "place": leaf, "predictor": np.where(ranked[leaf, at] > 0, predictor, -1), "bin": cut,
            "low_n": low_n[leaf, predictor, cut], "low_g": low_g[leaf, predictor, cut], "n": all_n[:, 0, 0], "g": all_g[:, 0, 0],
        }
        return pd.DataFrame(found)[all_n[:, 0, 0] > 0]

    return run
