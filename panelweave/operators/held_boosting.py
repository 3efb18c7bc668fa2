"""All trees of a boosted ensemble, grown in one task over rows it holds.

The trees are those of :mod:`panelweave.operators.boosting`; only the sums are taken otherwise. Rows lie in the order of
their leaves. A cut sums the smaller side alone: the larger one has what is left of the sums of both (unless the loss has
hessians of its own, whose sizes may differ too much for that). Neighbouring predictors whose bins make no more than
``PATTERNS`` patterns in these rows are summed once, by pattern, and the patterns then by bin: dates have few of them.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATTERNS = 256  # bins of several predictors that are told apart by one byte
SUMMED_AT_ONCE = 65_536  # rows
FEW_ROWS = 4096  # whose cells are summed for all predictors at once
TREES = "number int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"


def rank(gain: float) -> float:
    """Gains that differ only by the order of additions count as equal."""
    return float(f"{gain:.9e}")


def cut_gains(sums: np.ndarray, penalty: float, min_n: int, loss_reduction: float) -> tuple[np.ndarray, np.ndarray]:
    """The gain of a cut after each bin, 0 where there is none, and the sums up to it; ``sums`` are g, h and n, bins last."""

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        weight = h + penalty
        return np.divide(g * g, weight, out=np.zeros_like(g), where=weight != 0)

    low = np.cumsum(sums, axis=-1)
    all_ = low[..., -1:]
    gain = (score(low[0], low[1]) + score(all_[0] - low[0], all_[1] - low[1]) - score(all_[0], all_[1])) / 2 - loss_reduction
    gain[~((low[2] >= min_n) & (all_[2] - low[2] >= min_n) & (gain > 0))] = 0.0
    return gain, low


class _Columns:
    """The bins of held rows: a column for one predictor, or for the patterns of a few."""

    def __init__(self, bins: np.ndarray, widths: list[int]):
        self.shape = (len(widths), max(widths))
        columns, self.place, tables = [], [], []  # of a predictor: its column; of a column: bins by predictor and pattern
        for f, width in enumerate(widths):
            own = np.ascontiguousarray(bins[:, f])
            if columns and width <= PATTERNS and tables[-1].shape[1] <= PATTERNS:
                both = columns[-1].astype(np.intp) * width + own
                seen = np.nonzero(np.bincount(both, minlength=tables[-1].shape[1] * width))[0]
                if len(seen) <= PATTERNS:
                    number = np.zeros(tables[-1].shape[1] * width, np.uint8)
                    number[seen] = np.arange(len(seen))
                    columns[-1] = number[both]
                    tables[-1] = np.vstack([tables[-1][:, seen // width], seen % width])
                    self.place.append((len(columns) - 1, len(tables[-1]) - 1))
                    continue
            columns.append(own)
            tables.append(np.arange(width)[None])
            self.place.append((len(columns) - 1, 0))
        self.codes, self.tables = np.stack(columns), tables
        self.first = np.cumsum([0, *(t.shape[1] for t in tables)])
        self._plain, self._mixed = self._spread()

    def _spread(self) -> tuple[tuple[np.ndarray, np.ndarray], list]:
        """Where cells go among (predictor, bin): one to one, or patterns added up."""
        width, plain, mixed = self.shape[1], [], []
        features = [[f for f, (c, _) in enumerate(self.place) if c == column] for column in range(len(self.tables))]
        for own, table, low in zip(features, self.tables, self.first):
            if len(own) == 1:
                plain.append((low + np.arange(table.shape[1]), own[0] * width + table[0]))
                continue
            goes = np.array(own)[:, None] * width + table
            to, at = np.unique(goes, return_inverse=True)
            add = np.zeros((table.shape[1], len(to)))
            add[np.tile(np.arange(table.shape[1]), len(own)), at.ravel()] = 1.0
            mixed.append((slice(low, low + table.shape[1]), to, add))
        parts = [np.concatenate(p) for p in zip(*plain)] if plain else [np.empty(0, int)] * 2
        return (parts[0], parts[1]), mixed

    def sums(self, rows: np.ndarray | None, weights: list[np.ndarray]) -> np.ndarray:
        """Number of rows, and their summed weights, of every cell; all rows if none are named."""
        size, n_columns = int(self.first[-1]), len(self.codes)
        out = np.zeros((1 + len(weights), size))
        if rows is not None and len(rows) <= FEW_ROWS:
            cell = (self.codes[:, rows] + self.first[:-1, None]).ravel()
            out[0] = np.bincount(cell, minlength=size)
            for total, weight in zip(out[1:], weights):
                total[:] = np.bincount(cell, np.tile(weight[rows], n_columns), size)
            return out
        for at in range(0, self.codes.shape[1] if rows is None else len(rows), SUMMED_AT_ONCE):
            some = slice(at, at + SUMMED_AT_ONCE) if rows is None else rows[at : at + SUMMED_AT_ONCE]
            each = [weight[some] for weight in weights]
            for codes, low, high in zip(self.codes, self.first, self.first[1:]):
                cell = codes[some].astype(np.intp)
                out[0, low:high] += np.bincount(cell, minlength=high - low)
                for total, weight in zip(out[1:], each):
                    total[low:high] += np.bincount(cell, weight, high - low)
        return out

    def by_bin(self, cells: np.ndarray) -> np.ndarray:
        """Sums by predictor and bin from sums by cell."""
        out = np.zeros((*cells.shape[:-1], self.shape[0] * self.shape[1]))
        out[..., self._plain[1]] = cells[..., self._plain[0]]
        for cell, to, add in self._mixed:
            out[..., to] = cells[..., cell] @ add
        return out.reshape(*cells.shape[:-1], *self.shape)

    def low_side(self, feature: int, cut: int, rows: np.ndarray) -> np.ndarray:
        """Which rows lie in the cut's bin or a lower one."""
        column, line = self.place[feature]
        return (self.tables[column][line] <= cut)[self.codes[column, rows]]


class _Growth:
    """One tree over held rows; ``settings`` as of a :class:`panelweave.operators.boosting.Boosting`."""

    def __init__(self, settings, columns: _Columns, g: np.ndarray, h: np.ndarray, alike: bool):
        self.settings, self.columns, self.alike = settings, columns, alike
        self.weights = [g] if alike else [g, h]
        self.order = np.arange(len(g), dtype=np.int32)
        self.feature, self.cut, self.left, self.right, self.value, self.span = [], [], [], [], [], []
        self.queue = []
        self._grow()

    def _add(self, value: float, span: tuple[int, int]) -> int:
        at = len(self.feature)
        for line, entry in ((self.feature, -1), (self.cut, 0), (self.left, at), (self.right, at), (self.value, value), (self.span, span)):
            line.append(entry)
        return at

    def _offer(self, leaves: list[tuple[int, int, int]], cells: np.ndarray) -> None:
        """Queues the best cut of each leaf, given as node, depth and path from the root."""
        s = self.settings
        n, g, *h = np.moveaxis(self.columns.by_bin(cells), 1, 0)
        gain, low = cut_gains(np.stack([g, h[0] if h else n, n]), float(s.penalty), s.min_n, float(s.loss_reduction))
        at = gain.argmax(axis=-1)
        top = np.take_along_axis(gain, at[..., None], -1)[..., 0]
        for i, (node, depth, path) in enumerate(leaves):
            best = top[i].max()
            if not best > 0:
                continue
            near = np.nonzero(top[i] >= best * (1 - 1e-8))[0]
            f = int(min(near, key=lambda f: (-rank(top[i, f]), f)))
            below, both = low[:, i, f, at[i, f]], low[:, i, f, -1]
            # Leaf by leaf the best gain is cut first; by depth the order does not matter, and the deepest leaf keeps the queue short.
            first = -depth if s.leaves is None else -rank(top[i, f])
            heapq.heappush(self.queue, ((first, depth, path), node, f, int(at[i, f]), below, both - below, cells[i]))

    def _grow(self) -> None:
        s, columns = self.settings, self.columns
        root = self._add(0.0, (0, len(self.order)))
        n_leaves = 1
        if s.depth:
            self._offer([(root, 0, 0)], columns.sums(None, self.weights)[None])
        while self.queue and (s.leaves is None or n_leaves < s.leaves):
            (_, depth, path), node, f, cut, below, above, cells = heapq.heappop(self.queue)
            start, end = self.span[node]
            rows = self.order[start:end]
            low_side = columns.low_side(f, cut, rows)
            parts = rows[low_side], rows[~low_side]
            middle = start + len(parts[0])
            self.order[start:middle], self.order[middle:end] = parts
            spans = (start, middle), (middle, end)
            worth = [-s.learn_rate * float(g) / (float(h) + s.penalty) for g, h, _ in (below, above)]
            children = [self._add(w, span) for w, span in zip(worth, spans)]
            self.feature[node], self.cut[node], (self.left[node], self.right[node]) = f, cut, children
            n_leaves += 1
            if depth + 1 < s.depth and (s.leaves is None or n_leaves < s.leaves):
                self._open([(child, depth + 1, 2 * path + i) for i, child in enumerate(children)], parts, cells)

    def _open(self, leaves: list[tuple[int, int, int]], parts: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> None:
        """Sums both sides of a cut, where they may be cut again."""
        wanted = [i for i in (0, 1) if len(parts[i]) >= 2 * self.settings.min_n]
        if not wanted:
            return
        if self.alike:
            few = int(len(parts[1]) < len(parts[0]))
            found = [None, None]
            found[few] = self.columns.sums(parts[few], self.weights)
            rest = cells - found[few]
            rest[1:, rest[0] == 0] = 0.0
            found[1 - few] = rest
        else:
            found = [self.columns.sums(part, self.weights) if i in wanted else None for i, part in enumerate(parts)]
        self._offer([leaves[i] for i in wanted], np.stack([found[i] for i in wanted]))

    def move(self, guess: np.ndarray) -> None:
        """Adds to every row's prediction what its leaf is worth."""
        for feature, value, (start, end) in zip(self.feature, self.value, self.span):
            if feature < 0:
                guess[self.order[start:end]] += value


def grown(settings, widths: list[int], slopes: Callable, alike: bool, held: Callable) -> Callable:
    """Blocks to trees, one row a tree, until no cut gains anything any more; cuts are bins.

    ``held`` turns the blocks into values, predictions and bins; ``alike`` says that the loss has a hessian of 1 for every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, guess, bins = held(batches)
        if not len(value):
            return
        columns = _Columns(bins, widths)
        del bins
        for number in range(settings.trees):
            g, h = (np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf) for v in slopes(value, guess))
            tree = _Growth(settings, columns, g, h, alike)
            if len(tree.feature) == 1:
                return
            tree.move(guess)
            found = {"number": number, **{c: getattr(tree, c) for c in ("feature", "cut", "left", "right", "value")}}
            kinds = [pa.int32(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(found.values(), kinds)], names=list(found))

    return run
