"""Histogram gradient-boosted trees, fitted over rows that Spark holds in blocks and flattened into node arrays for vectorised scoring.

Binary log-loss, second-order gains over quantile bins, depth-limited trees grown a level at a time: in each level every block
sums the gradients of its rows by node, feature and bin, Spark adds the blocks' sums up, and the driver, which sees these sums
only, chooses the splits. Gradients are summed as whole multiples of 1 / UNIT, so that the sums, and with them the trees, do not depend on
how the rows are dealt. monotone gives for each feature -1, 0 or +1: a split on a constrained feature must order its
children that way, and the bounds their midpoint sets hold for every leaf below, so that the score is monotone in that feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import RDD, StorageLevel

#: Parts of a gradient of 1 that sums are exact in (below 2**53 for eight billion rows), and mantissa bits of a value that bin edges are found by.
UNIT, BITS = float(1 << 20), 11
#: Blocks keep their rows' sums of the trees so far; later trees are added each time, up to so many.
KEEP = 10


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points to itself, so `depth` steps settle every row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows x (n, features); NaN counts as 0."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for rows x."""
        x = np.nan_to_num(np.asarray(x, np.float64))
        total = np.full(len(x), self.base)
        for root in self.roots:
            total += self.value[_walked(x, self, root, self.depth)]
        return total


@dataclass
class _Trees:
    """Nodes as they grow; thresholds are bins here, so blocks of bins are walked."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def node(self, value: float) -> int:
        k = len(self.value)
        for of, v in zip((self.feature, self.threshold, self.left, self.right, self.value), (0, np.inf, k, k, value), strict=True):
            of.append(v)
        return k

    def since(self, first: int) -> _Trees:
        """The nodes from `first` on as arrays, which point to each other by their places among them."""
        part = [np.array(of[first:]) for of in (self.feature, self.threshold, self.left, self.right, self.value)]
        return _Trees(part[0].astype(np.int64), part[1].astype(float), part[2].astype(np.int64) - first, part[3].astype(np.int64) - first, part[4].astype(float))


def _walked(x: np.ndarray, trees: Forest | _Trees, root: int, depth: int) -> np.ndarray:
    """The node that each row is at after `depth` steps."""
    rows, at = np.arange(len(x)), np.full(len(x), root)
    for _ in range(depth):
        at = np.where(x[rows, trees.feature[at]] <= trees.threshold[at], trees.left[at], trees.right[at])
    return at


#: A block: bins (n, features) as bytes, labels, sums of the trees that are kept.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sums(block: Block, trees: _Trees, done: list[int], root: int, depth: int, level: int, nodes: list[int], bins: int) -> np.ndarray:
    """(nodes, 3, features, bins): gradients, curvatures and counts of the block's rows at the nodes, which are level steps below the root."""
    binned, y, kept = block
    score = kept + sum((trees.value[_walked(binned, trees, r, depth)] for r in done), np.zeros(len(y)))
    p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    grad, hess = np.round((p - y) * UNIT), np.round(p * (1 - p) * UNIT)
    place = np.full(len(trees.value), -1)
    place[nodes] = np.arange(len(nodes))
    at = place[_walked(binned, trees, root, level)]
    rows, width = at >= 0, binned.shape[1]
    cells = ((at[rows, None] * width + np.arange(width)) * bins + binned[rows]).ravel()
    per = lambda w: np.bincount(cells, w, len(nodes) * width * bins).reshape(len(nodes), width, bins)
    return np.stack([per(np.repeat(grad[rows], width)), per(np.repeat(hess[rows], width)), per(None)], axis=1)


def _grown(sums: Callable[[_Trees, list[int], int, int, list[int]], np.ndarray], kept: Callable[[_Trees, list[int]], None], base: float, cuts: list[np.ndarray], *, trees: int, depth: int, rate: float, bins: int, min_rows: int, ridge: float, sign: np.ndarray) -> Forest:
    """sums: of all rows at nodes, from the trees not kept yet. kept: adds those to what the blocks keep."""
    out, roots, fresh, first = _Trees(), [], [], 0
    for _ in range(trees):
        root = out.node(0.0)
        roots.append(root)
        level = [(root, -np.inf, np.inf)]
        for k in range(depth):
            if not level:
                break
            found = sums(out.since(first), [r - first for r in fresh], root - first, k, [n - first for n, _, _ in level])
            below = []
            for (n, low, high), (gs, hs, cs) in zip(level, found, strict=True):
                gs, hs, cs = gs.cumsum(axis=1) / UNIT, hs.cumsum(axis=1) / UNIT, cs.cumsum(axis=1)
                g, h, rows = gs[0, -1], hs[0, -1], cs[0, -1]
                gs, hs, cs = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                weight = float(np.clip(-g / (h + ridge), low, high))
                out.value[n] = weight * rate
                if rows < 2 * min_rows:
                    continue
                wl, wr = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
                # the loss drop of clipped child weights against the clipped parent weight
                drop = lambda g, h, w: -(g * w + 0.5 * (h + ridge) * w * w)
                gain = drop(gs, hs, wl) + drop(g - gs, h - hs, wr) - drop(g, h, weight)
                gain[(cs < min_rows) | (rows - cs < min_rows) | (sign[:, None] * (wr - wl) < 0)] = -np.inf
                j, b = (int(i) for i in np.unravel_index(np.argmax(gain), gain.shape))
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                lo, hi = (low, high), (low, high)
                if sign[j]:
                    middle = (wl[j, b] + wr[j, b]) / 2
                    lo, hi = ((low, middle), (middle, high)) if sign[j] > 0 else ((middle, high), (low, middle))
                # leaves of the last level need no sums of their own
                a, c = (out.node(float(np.clip(w, *of)) * rate) for w, of in ((wl[j, b], lo), (wr[j, b], hi)))
                out.feature[n], out.threshold[n], out.left[n], out.right[n], out.value[n] = j, b, a, c, 0.0
                below += [(child, *of) for child, of, size in ((a, lo, cs[j, b]), (c, hi, rows - cs[j, b])) if size >= 2 * min_rows]
            level = below
        fresh.append(root)
        if len(fresh) == KEEP:
            kept(out.since(first), [r - first for r in fresh])
            fresh, first = [], len(out.value)
    whole = [cuts[j][int(b)] if b != np.inf else b for j, b in zip(out.feature, out.threshold, strict=True)]
    return Forest(np.array(out.feature, np.int64), np.array(whole, np.float64), np.array(out.left, np.int64), np.array(out.right, np.int64), np.array(out.value, np.float64), np.array(roots, np.int64), depth, base)


def _prior(good: float, n: int) -> float:
    share = (good + 0.5) / (n + 1)
    return float(np.log(share / (1 - share)))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _kept(block: Block, trees: _Trees, done: list[int], depth: int) -> Block:
    binned, y, score = block
    return binned, y, score + sum((trees.value[_walked(binned, trees, r, depth)] for r in done), np.zeros(len(y)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, min_rows: int = 8, ridge: float = 2.0, monotone: np.ndarray | None = None) -> Forest:
    """x (n, features), y of 0 and 1, as one block. Without rows, or with one class only, the forest is that class's smoothed share."""
    x, y = np.nan_to_num(np.asarray(x, np.float64)), np.asarray(y, np.float64)
    n, width = x.shape
    base, state = _prior(y.sum(), n), []
    one = n and 0 < y.sum() < n
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)] if one else []
    if one:
        state.append((_binned(x, cuts), y, np.full(n, base)))

    def keep(grown: _Trees, done: list[int]) -> None:
        state[0] = _kept(state[0], grown, done, depth)

    return _grown(lambda grown, done, root, level, nodes: _sums(state[0], grown, done, root, depth, level, nodes, bins), keep, base, cuts, trees=trees if one else 0, depth=depth, rate=rate, bins=bins, min_rows=min_rows, ridge=ridge, sign=np.zeros(width, int) if monotone is None else np.asarray(monotone))


#: Cells of values by the leading bits of their doubles, in the order of the values.
_SHIFT = 52 - BITS


def _cells(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~(bits & np.int64(2**63 - 1)), bits) >> _SHIFT


def _edges(cells: np.ndarray) -> np.ndarray:
    """The greatest value of each cell."""
    last = ((cells + 1) << _SHIFT) - 1
    return np.where(last < 0, ~last | np.int64(-(2**63)), last).view(np.float64)


Counts = list[tuple[np.ndarray, np.ndarray]]


def _added(a: Counts, b: Counts) -> Counts:
    """Counts of cells by feature, added up."""
    out = []
    for (ka, na), (kb, nb) in zip(a, b, strict=True):
        cells, at = np.unique(np.concatenate((ka, kb)), return_inverse=True)
        out.append((cells, np.bincount(at, np.concatenate((na, nb)), len(cells)).astype(np.int64)))
    return out


def _all_added(a: tuple[int, float, Counts], b: tuple[int, float, Counts]) -> tuple[int, float, Counts]:
    return a[0] + b[0], a[1] + b[1], _added(a[2], b[2])


def _quantile_cuts(counts: Counts, bins: int) -> list[np.ndarray]:
    """Ends of the cells that hold the quantiles; the last cell's end separates nothing."""
    out = []
    for cells, n in counts:
        total = np.cumsum(n)
        at = np.searchsorted(total, np.ceil(np.linspace(0, 1, bins + 1)[1:-1] * total[-1]), "left")
        out.append(_edges(cells[np.unique(at[at < len(cells) - 1])]))
    return out


def _each(of: Callable, add: Callable) -> Callable[[Iterator], Iterator]:
    """A partition's values added up: one of them, or none of an empty partition."""

    def run(blocks: Iterator) -> Iterator:
        values = map(of, blocks)
        for first in values:
            yield reduce(add, values, first)

    return run


def _over(rdd: RDD, add: Callable, parts: int):
    """The partitions' values added up; many are added by executors first, so that the driver gets few."""
    return rdd.treeReduce(add, 2) if parts > 32 else rdd.reduce(add)


def _counted(block: tuple[np.ndarray, np.ndarray]) -> tuple[int, float, Counts]:
    x, y = block
    return len(y), y.sum(), [np.unique(_cells(np.ascontiguousarray(x[:, j])), return_counts=True) for j in range(x.shape[1])]


def fit_rows(rows: RDD, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, min_rows: int = 8, ridge: float = 2.0, monotone: np.ndarray | None = None) -> Forest:
    """fit() over all blocks (x, y) of an RDD, each a bounded number of rows. Bin edges are the values' quantiles to 1 / 2**BITS of a value."""
    parts = rows.getNumPartitions()
    clean = rows.map(lambda b: (np.nan_to_num(np.asarray(b[0], np.float64)), np.asarray(b[1], np.float64))).filter(lambda b: len(b[1]))
    counted = clean.mapPartitions(_each(_counted, _all_added))
    n, good, counts = (0, 0.0, []) if clean.isEmpty() else _over(counted, _all_added, parts)
    base, one = _prior(good, n), 0 < good < n
    cuts = _quantile_cuts(counts, bins) if one else []
    state = [clean.map(lambda b: (_binned(b[0], cuts), b[1], np.full(len(b[1]), base))).persist(StorageLevel.MEMORY_AND_DISK)]

    def sums(grown: _Trees, done: list[int], root: int, level: int, nodes: list[int]) -> np.ndarray:
        return _over(state[-1].mapPartitions(_each(lambda b: _sums(b, grown, done, root, depth, level, nodes, bins), np.add)), np.add, parts)

    def keep(grown: _Trees, done: list[int]) -> None:
        state.append(state[-1].map(lambda b: _kept(b, grown, done, depth)).persist(StorageLevel.MEMORY_AND_DISK))
        if len(state) > 2:
            state.pop(0).unpersist()

    try:
        return _grown(sums, keep, base, cuts, trees=trees if one else 0, depth=depth, rate=rate, bins=bins, min_rows=min_rows, ridge=ridge, sign=np.zeros(len(cuts), int) if monotone is None else np.asarray(monotone))
    finally:
        for kept in state:
            kept.unpersist()


def counted_margins(rows: RDD, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """The forest's log-odds of all rows in steps of 1 / 1024, ascending, and how many rows have each. rows: blocks x."""

    def count(x: np.ndarray) -> Counts:
        return [np.unique(np.floor(np.clip(forest.margin(x), -40, 40) * 1024).astype(np.int64), return_counts=True)]

    some = rows.filter(len)
    (cells, n), = [(np.zeros(0), np.zeros(0))] if some.isEmpty() else _over(some.mapPartitions(_each(count, _added)), _added, rows.getNumPartitions())
    return cells / 1024, n
