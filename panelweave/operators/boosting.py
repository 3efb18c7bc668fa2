"""Gradient-boosted trees of second order, grown by Spark aggregations.

Predictors are cut into bins at their quantiles once; rows are then kept in blocks, a byte per
predictor. A tree grows level by level: each task sums gradient and hessian of the loss per (leaf, predictor,
bin) over its rows, a shuffle by leaf adds the tasks' sums and finds the best cut of each leaf,
and only that cut reaches the driver. With G and H the sums and L the ``penalty``,

    gain = (Gl^2 / (Hl + L) + Gr^2 / (Hr + L) - G^2 / (H + L)) / 2 - loss_reduction

and a leaf is worth ``-learn_rate * G / (H + L)``. Two ways to grow:

* by depth: every leaf with a positive gain is cut, down to ``depth``;
* by leaf (``leaves`` set): leaves are cut in the order of their gain until there are ``leaves`` of
  them. The gain of a cut does not depend on other cuts, so the levels are worked out as above and
  the queue then takes from them.

Rows stay where they are: a row finds its leaf by walking arrays that hold the tree. They are
written once per ``TREES_PER_WRITE`` trees, which bounds plans and what a lost executor costs.
A level of more leaves than ``CELLS_HELD`` allows is summed in several passes, which bounds a task.
Ties go to the lower predictor, then the lower cut.

Where the rows, packed, are no more than ``TASK_BYTES``, one task holds them and grows the same trees alone
(:mod:`panelweave.operators.held_boosting`): a job for each level would be planning for the most part.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import held_boosting
from panelweave.operators.held_boosting import cut_gains
from panelweave.operators.held_boosting import rank as _rank
from panelweave.session import materialize

# The sums travel to the workers with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES_PER_WRITE = 10
QUANTILE_ROWS, QUANTILE_ACCURACY = 131_072, 10_000  # rows sorted at a time, and the points that stand for them
BLOCK = 512  # rows stored as one
ROWS_AT_ONCE = 65_536  # rows a task sums at a time
CELLS_HELD = 2_000_000  # (leaf, predictor, bin) sums a task holds at a time
TASK_BYTES = 256 << 20  # packed rows that one task grows all trees from; it copies them while it sorts out patterns

# What a row contributes: gradient and hessian of the loss at its prediction.
LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]] = {
    "squared": lambda value, guess: (guess - value, np.ones_like(guess)),
    "pseudo_huber": lambda value, guess: (
        (guess - value) / np.sqrt(1 + (guess - value) ** 2),
        1 / (1 + (guess - value) ** 2) ** 1.5,
    ),
    "poisson": lambda value, guess: (np.exp(guess) - value, np.exp(guess)),
}


def fixed_array(values: Sequence, kind: str) -> Column:
    """A constant array of any length; the optimizer folds it before the job starts."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass
class Tree:
    """Nodes in arrays; a leaf has predictor -1 and is its own child."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)  # a bin while growing, a value once grown
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        self.feature.append(-1)
        self.cut.append(0)
        self.left.append(len(self.left))
        self.right.append(len(self.right))
        self.value.append(0.0)
        return len(self.feature) - 1

    def walk(self, predictors: Column, depth: int, kind: str = "int", start: Column | None = None) -> Column:
        """The leaf that an array of predictors (bins or values) falls into."""
        feature, cut = fixed_array(self.feature, "int"), fixed_array(self.cut, kind)
        left, right = fixed_array(self.left, "int"), fixed_array(self.right, "int")

        def down(node: Column, _: Column) -> Column:
            low = F.get(predictors, F.get(feature, node)) <= F.get(cut, node)
            step = F.when(low, F.get(left, node)).otherwise(F.get(right, node))
            return F.when(F.get(feature, node) < 0, node).otherwise(step)

        start = F.lit(0) if start is None else start
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, down) if depth else start


@dataclass(frozen=True)
class Cut:
    """The best cut of a leaf, with the sums on both sides."""

    gain: float
    feature: int
    bin: int
    left: tuple[float, float, int]
    right: tuple[float, float, int]


@dataclass
class BoostedTrees:
    """A grown ensemble: predicts from the ``features`` vector like a Spark ML model."""

    base: float
    trees: list[Tree]
    depth: int
    n_features: int

    def joined(self) -> tuple[Tree, list[int]]:
        """All trees as one set of nodes, with the number of each tree's root."""
        one, roots = Tree(), []
        for tree in self.trees:
            at = len(one.feature)
            roots.append(at)
            one.feature += tree.feature
            one.cut += tree.cut
            one.left += [at + i for i in tree.left]
            one.right += [at + i for i in tree.right]
            one.value += tree.value
        return one, roots

    def value_of(self, predictors: Column) -> Column:
        """The prediction for an array of predictors, as one expression."""
        one, roots = self.joined()
        values = fixed_array(one.value, "double")

        def summed(known: Column) -> Column:
            step = lambda total, root: total + F.get(values, one.walk(known, self.depth, "double", root))
            return F.aggregate(fixed_array(roots, "int"), F.lit(float(self.base)), step)

        return F.get(F.transform(F.array(predictors), summed), F.lit(0))  # predictors are worked out once

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.value_of(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per node."""
        one, roots = self.joined()
        tree_of = [t for t, tree in enumerate(self.trees) for _ in tree.feature]
        rows = list(zip(tree_of, range(len(tree_of)), one.feature, map(float, one.cut), one.left, one.right, one.value))
        nodes = "tree int, node int, feature int, cut double, left int, right int, value double"
        spark.createDataFrame(rows, nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = [(float(self.base), len(self.trees), self.depth, self.n_features)]
        schema = "base double, trees int, depth int, n_features int"
        spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        about = spark.read.parquet(f"{path}/about").first()
        trees = [Tree() for _ in range(about["trees"])]
        first: dict[int, int] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("node").toLocalIterator():
            at = first.setdefault(r["tree"], r["node"])
            tree = trees[r["tree"]]
            tree.feature.append(r["feature"])
            tree.cut.append(r["cut"])
            tree.left.append(r["left"] - at)
            tree.right.append(r["right"] - at)
            tree.value.append(r["value"])
        return BoostedTrees(about["base"], trees, about["depth"], about["n_features"])


@dataclass(frozen=True)
class Binned:
    """Blocks of rows, and what their bins mean.

    A block packs ``value`` and ``guess`` as doubles and ``bins`` as a byte per row and predictor, two where bins are many.
    """

    blocks: DataFrame
    edges: list[list[float]]
    base: float
    n_features: int
    rows: int | None = None  # this many or fewer, where they were counted

    @property
    def width(self) -> int:
        return 1 + max((len(e) for e in self.edges), default=0)

    @property
    def kind(self) -> str:
        return bin_type(self.edges)

    def pack(self, rows: DataFrame) -> DataFrame:
        """Blocks of other rows of ``value`` and a ``features`` vector, in the same bins."""
        return _known(rows).mapInArrow(_binned(self.edges, self.base), BLOCKS)


@dataclass(frozen=True)
class Boosting:
    """An ensemble to be fitted to rows of ``value`` and a ``features`` vector."""

    trees: int = 500
    learn_rate: float = 0.05
    depth: int = 8
    min_n: int = 5
    loss_reduction: float = 0.0
    penalty: float = 1.0
    leaves: int | None = None
    bins: int = 64
    loss: str = "squared"

    def copy(self) -> "Boosting":
        return self

    def prepare(self, rows: DataFrame) -> Binned:
        """What every ensemble with these bins and this loss starts from."""
        base, n_rows = rows.agg(F.avg(F.col("value").cast("double")), F.count("*")).first()
        if base is None:
            raise ValueError("no rows to fit")
        if self.loss == "poisson":
            base = math.log(max(base, 1e-9))
        known = _known(rows)
        edges = quantile_edges(known, None, self.bins)
        blocks = known.mapInArrow(_binned(edges, float(base)), BLOCKS)
        return Binned(materialize(blocks, "boosting"), edges, float(base), len(edges), n_rows)

    def fit(self, rows: DataFrame) -> BoostedTrees:
        return self.fit_binned(self.prepare(rows))

    def first_cuts(self, binned: Binned) -> dict[int, Cut]:
        """The cuts of a first tree of this depth: whatever the rate, every shallower one begins with the same."""
        return self._levels(binned.blocks, binned)[1]

    def fit_binned(self, binned: Binned, first: dict[int, Cut] | None = None) -> BoostedTrees:
        """``first`` are the :meth:`first_cuts` of this depth or more, where they are known already."""
        edges, grown = binned.edges, (self._held if self.in_one_task(binned) else self._by_level)(binned, first)
        for tree in grown:
            tree.cut = [edges[f][int(c)] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        return BoostedTrees(binned.base, grown, self.depth, binned.n_features)

    def in_one_task(self, binned: Binned) -> bool:
        """Whether one task holds the rows, and the sums of the leaves it has yet to cut."""
        if binned.rows is None or not binned.n_features:
            return False
        size = binned.rows * (binned.n_features * np.dtype(binned.kind).itemsize + 16)
        return size <= TASK_BYTES and (self.leaves or self.depth) * binned.n_features * binned.width <= CELLS_HELD

    def _held(self, binned: Binned, first: dict[int, Cut] | None = None) -> list[Tree]:
        """All trees from one task; what is known of the first one spares it little."""
        widths = [1 + len(e) for e in binned.edges]
        run = held_boosting.grown(self, widths, LOSSES[self.loss], self.loss == "squared", _held_rows(binned))
        found = binned.blocks.coalesce(1).mapInArrow(run, held_boosting.TREES).collect()
        return [Tree(*map(list, r[1:])) for r in sorted(found, key=lambda r: r.number)]

    def _by_level(self, binned: Binned, first: dict[int, Cut] | None = None) -> list[Tree]:
        """Tree after tree, a job for each level."""
        state, kept, grown = binned.blocks, None, []
        for number in range(1, self.trees + 1):
            # The first level also loads what ``state`` keeps.
            tree = self._grow(state, binned, first if number == 1 else None)
            if kept is not None:
                kept.unpersist()
            kept = state if number > 1 else None  # the first blocks lie stored and may serve other fits
            if tree is None:
                break  # no cut gains anything any more
            grown.append(tree)
            if number < self.trees:
                ahead = state.mapInArrow(_moved(tree, self.depth, binned), BLOCKS)
                state = (materialize(ahead, "boosting") if number % TREES_PER_WRITE == 0 else ahead).persist()
        if kept is not None:
            kept.unpersist()
        return grown

    def _grow(self, state: DataFrame, binned: Binned, known: dict[int, Cut] | None = None) -> Tree | None:
        tree, cuts = self._levels(state, binned, known)
        if not cuts:
            return None
        return tree if self.leaves is None else self._by_leaf(tree, cuts)

    def _levels(self, state: DataFrame, binned: Binned, known: dict[int, Cut] | None = None) -> tuple[Tree, dict[int, Cut]]:
        """All cuts down to ``depth``, found or looked up among the known ones."""
        tree = Tree()
        open_, cuts = [tree.add()], {}
        for level in range(self.depth):
            if known is None:
                found = self._best_cuts(state, binned, tree, level, open_)
            else:
                found = {node: known[node] for node in open_ if node in known}
            cuts |= found
            open_ = []
            for node, cut in found.items():
                low, high = tree.add(), tree.add()
                tree.feature[node], tree.cut[node], tree.left[node], tree.right[node] = cut.feature, cut.bin, low, high
                tree.value[low], tree.value[high] = self._worth(cut.left), self._worth(cut.right)
                open_ += [child for child, side in ((low, cut.left), (high, cut.right)) if side[2] >= 2 * self.min_n]
            if not open_:
                break
        return tree, cuts

    def _worth(self, side: tuple[float, float, int]) -> float:
        return -self.learn_rate * side[0] / (side[1] + self.penalty)

    def _by_leaf(self, tree: Tree, cuts: dict[int, Cut]) -> Tree:
        """The cuts that a queue of leaves, best gain first, makes before there are enough leaves."""
        out = Tree()
        queue = [(-_rank(cuts[0].gain), 0, out.add())]
        n_leaves = 1
        while queue and n_leaves < self.leaves:
            _, node, at = heapq.heappop(queue)
            low, high = out.add(), out.add()
            out.feature[at], out.cut[at], out.left[at], out.right[at] = tree.feature[node], tree.cut[node], low, high
            for child, new in ((tree.left[node], low), (tree.right[node], high)):
                out.value[new] = tree.value[child]
                if child in cuts:
                    heapq.heappush(queue, (-_rank(cuts[child].gain), child, new))
            n_leaves += 1
        return out

    def _best_cuts(self, state: DataFrame, binned: Binned, tree: Tree, level: int, open_: list[int]) -> dict[int, Cut]:
        """The best cut of each open leaf that has one."""
        at_once = max(1, CELLS_HELD // max(1, binned.n_features * binned.width))
        found: dict[int, Cut] = {}
        for start in range(0, len(open_), at_once):
            wanted = open_[start : start + at_once]
            sums = state.mapInArrow(_summed(tree, level, wanted, binned, LOSSES[self.loss]), "node int, sums binary")
            best = sums.groupBy("node").applyInPandas(_best_of(self, binned), CUT)
            for r in best.collect():
                low, high = (r.low_g, r.low_h, r.low_n), (r.g - r.low_g, r.h - r.low_h, r.n - r.low_n)
                found[r.node] = Cut(r.gain, r.feature, r.bin, low, high)
        return {node: found[node] for node in sorted(found)}


def block_errors(models: Sequence[BoostedTrees], blocks: DataFrame, binned: Binned) -> DataFrame:
    """``(model, absolute, squared, n)``: summed errors of each model, by its place, over blocks in the bins of its training rows.

    One pass serves all models. There may be several rows a model, and one of zeros always.
    """
    zeros = blocks.sparkSession.range(len(models)).select(
        F.col("id").cast("int").alias("model"), F.lit(0.0).alias("absolute"), F.lit(0.0).alias("squared"), F.lit(0).cast("bigint").alias("n")
    )
    return blocks.mapInArrow(_errors(models, binned), ERRORS).unionByName(zeros)


def _known(rows: DataFrame) -> DataFrame:
    """Rows as ``value`` and an array ``x``; those without predictors left out."""
    return rows.select(F.col("value").cast("double").alias("value"), vector_to_array("features").alias("x")).filter("x is not null")


def quantile_edges(rows: DataFrame, n_features: int | None, bins: int, rare: bool = False) -> list[list[float]]:
    """Per predictor the values that part its bins: distinct quantiles, the largest value left out.

    With ``rare`` a predictor of no more than ``bins`` values has a bin for each, however few rows hold it.

    Tasks sort ``QUANTILE_ROWS`` rows at a time and send ``QUANTILE_ACCURACY`` points for them, or every value where these
    are few; ranks are off by one in ``QUANTILE_ACCURACY`` at most. No more than ``bins`` numbers a predictor reach the driver.
    """
    points = rows.select("x").mapInArrow(_points, "feature int, x binary, n binary")
    found = points.groupBy("feature").applyInPandas(_quantiles(bins, rare), "feature int, edges array<double>").collect()
    edges: list[list[float]] = [[] for _ in range(1 + max((r["feature"] for r in found), default=-1) if n_features is None else n_features)]
    for r in found:
        edges[r["feature"]] = list(r["edges"])
    return edges


# --- what a task does with its rows ---------------------------------------------

BLOCKS = "value binary, bins binary, guess binary"
ERRORS = "model int, absolute double, squared double, n long"
CUT = "node int, gain double, feature int, bin int, low_g double, low_h double, low_n long, g double, h double, n long"


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each predictor the values met and how many rows each stands for."""

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lines = np.ascontiguousarray(np.concatenate(held).T)
        for f in range(len(lines)):
            line = np.sort(lines[f][~np.isnan(lines[f])])
            last = np.nonzero(np.append(line[1:] != line[:-1], True))[0] if len(line) else np.empty(0, int)
            if len(last) > QUANTILE_ACCURACY:
                last = np.unique(len(line) * np.arange(1, QUANTILE_ACCURACY + 1) // QUANTILE_ACCURACY - 1)
            n = np.diff(last, prepend=-1).astype(float)
            columns = [pa.array([f], pa.int32()), pa.array([line[last].tobytes()]), pa.array([n.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "x", "n"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_matrix(batch.column(0)))
            size += batch.num_rows
        if size >= QUANTILE_ROWS:
            yield from out(held)
            held, size = [], 0
    if size:
        yield from out(held)


def _quantiles(bins: int, rare: bool = False) -> Callable:
    """The edges of one predictor: the value at the rank, rounded up, of each share of its rows."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        x, n = (np.concatenate([np.frombuffer(b) for b in parts[c]]) for c in ("x", "n"))
        order = np.argsort(x, kind="stable")
        x, below = x[order], np.cumsum(n[order])
        edges = np.empty(0)
        if len(x):
            ranks = np.ceil(np.arange(1, bins) / bins * below[-1])
            edges = np.unique(x[np.searchsorted(below, ranks)])
            if rare and len(every := np.unique(x)) <= bins:
                edges = every
            edges = edges[edges < x[-1]]
        return pd.DataFrame({"feature": parts["feature"].iloc[:1], "edges": [edges.tolist()]})

    return run


def bin_type(edges: list[list[float]]) -> str:
    return "u1" if max((len(e) for e in edges), default=0) < 256 else "u2"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of an array, packed into binary values that end at the given rows."""
    size = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    places = (np.append(0, ends) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str = "f8") -> np.ndarray:
    """The values of all blocks of a batch, one after another."""
    places = np.frombuffer(column.buffers()[1], np.int32)
    low, high = int(places[column.offset]), int(places[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], kind, (high - low) // np.dtype(kind).itemsize, low) if high > low else np.empty(0, kind)


def _binned(edges: list[list[float]], base: float) -> Callable:
    """Blocks of rows; a bin is how many edges of its predictor lie below a value."""
    every, kind = [np.array(e) for e in edges], bin_type(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(_matrix(batch.column("x")).T)
            bins = np.empty((batch.num_rows, len(every)), kind)
            for f, own in enumerate(every):
                bins[:, f] = np.searchsorted(own, x[f])
            ends = np.append(np.arange(BLOCK, batch.num_rows, BLOCK), batch.num_rows)
            value = batch.column("value").to_numpy(zero_copy_only=False)
            parts = [_packed(value, ends), _packed(bins, ends), _packed(np.full(len(value), base), ends)]
            yield pa.RecordBatch.from_arrays(parts, names=["value", "bins", "guess"])

    return run


def _leaves(tree: Tree, depth: int, bins: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    feature, cut, left, right = (np.array(v) for v in (tree.feature, tree.cut, tree.left, tree.right))
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        own = feature[node]
        low = bins[rows, np.maximum(own, 0)] <= cut[node]
        node = np.where(own < 0, node, np.where(low, left[node], right[node]))
    return node


def _held_rows(binned: Binned) -> Callable:
    """Values, predictions and bins of all blocks of a task."""
    n_features, kind = binned.n_features, binned.kind

    def run(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [[_unpacked(batch.column(c), k) for c, k in (("value", "f8"), ("guess", "f8"), ("bins", kind))] for batch in batches]
        value, guess, bins = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0), np.empty(0), np.empty(0, kind))
        return value, guess, bins.reshape(-1, n_features)

    return run


def _moved(tree: Tree, depth: int, binned: Binned) -> Callable:
    """Blocks with what the tree adds to the predictions of their rows."""
    n_features, kind = binned.n_features, binned.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(tree.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _unpacked(batch.column("bins"), kind).reshape(-1, n_features)
            guess = _unpacked(batch.column("guess"))
            moved = np.empty_like(guess)
            for at in range(0, len(guess), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                moved[some] = guess[some] + worth[_leaves(tree, depth, bins[some])]
            ends = np.cumsum(pc.binary_length(batch.column("guess")).to_numpy() // 8)
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("bins"), _packed(moved, ends)], names=["value", "bins", "guess"])

    return run


def _errors(models: Sequence[BoostedTrees], binned: Binned) -> Callable:
    """Summed errors of every model over the rows of a task; a cut is found again among the edges it was taken from."""
    n_features, kind = binned.n_features, binned.kind

    def in_bins(tree: Tree) -> Tree:
        cut = [int(np.searchsorted(binned.edges[f], c)) if f >= 0 else 0 for f, c in zip(tree.feature, tree.cut)]
        return Tree(tree.feature, cut, tree.left, tree.right, tree.value)

    grown = [(model.base, model.depth, [in_bins(tree) for tree in model.trees]) for model in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, len(grown))), 0
        for batch in batches:
            value = _unpacked(batch.column("value"))
            bins = _unpacked(batch.column("bins"), kind).reshape(len(value), n_features)
            n += len(value)
            for at in range(0, len(value), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                for i, (base, depth, trees) in enumerate(grown):
                    guess = np.full(len(value[some]), float(base))
                    for tree in trees:
                        guess = guess + np.array(tree.value)[_leaves(tree, depth, bins[some])]
                    miss = value[some] - guess
                    sums[:, i] += np.abs(miss).sum(), (miss * miss).sum()
        columns = [np.arange(len(grown), dtype=np.int32), *sums, np.full(len(grown), n, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "absolute", "squared", "n"])

    return run


def _summed(tree: Tree, level: int, wanted: list[int], binned: Binned, slopes: Callable) -> Callable:
    """Per wanted leaf the sums of g and h and the rows of every (predictor, bin), over the rows of a task."""
    n_features, width, kind = binned.n_features, binned.width, binned.kind
    size = len(wanted) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[wanted] = np.arange(len(wanted))
        sums = np.zeros((3, n_features, size))
        for batch in batches:
            value, guess = _unpacked(batch.column("value")), _unpacked(batch.column("guess"))
            every = _unpacked(batch.column("bins"), kind).reshape(-1, n_features)
            for at in range(0, len(value), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                leaf = place[_leaves(tree, level, every[some])]
                own = np.nonzero(leaf >= 0)[0]
                bins = np.ascontiguousarray(every[some][own].T)
                g, h = (np.nan_to_num(v[own], nan=0.0, posinf=np.inf, neginf=-np.inf) for v in slopes(value[some], guess[some]))
                start, same = leaf[own] * width, bool((h == 1.0).all())
                for f in range(n_features):
                    cell = start + bins[f]
                    n = np.bincount(cell, minlength=size)
                    sums[0, f] += np.bincount(cell, g, size)
                    sums[1, f] += n if same else np.bincount(cell, h, size)
                    sums[2, f] += n
        lines = sums.reshape(3, n_features, len(wanted), width).transpose(2, 0, 1, 3).reshape(len(wanted), 3 * n_features * width)
        seen = np.nonzero(lines[:, 2 * n_features * width :].any(axis=1))[0]
        for at in range(0, len(seen), 64):
            some = seen[at : at + 64]
            parts = [pa.array(np.array(wanted, np.int32)[some]), _packed(lines[some], np.arange(1, len(some) + 1))]
            yield pa.RecordBatch.from_arrays(parts, names=["node", "sums"])

    return run


def _best_of(settings: Boosting, binned: Binned) -> Callable:
    """The best cut of one leaf from the sums of all tasks, lowest bins first; no row where no cut gains."""
    shape = (3, binned.n_features, binned.width)
    limits = float(settings.penalty), settings.min_n, float(settings.loss_reduction)

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(shape)
        for part in parts["sums"]:
            sums += np.frombuffer(part).reshape(shape)
        gain, low = cut_gains(sums, *limits)
        at = gain.argmax(axis=1)
        best = [(-_rank(gain[f, b]), f, b) for f, b in enumerate(at) if gain[f, b] > 0]
        if not best:
            return pd.DataFrame()
        _, f, b = min(best)
        (low_g, low_h, low_n), (g, h, n) = low[:, f, b], low[:, f, -1]
        row = (parts["node"].iloc[0], gain[f, b], f, b, low_g, low_h, int(low_n), g, h, int(n))
        return pd.DataFrame([row], columns=[c.split()[0] for c in CUT.split(", ")])

    return run
