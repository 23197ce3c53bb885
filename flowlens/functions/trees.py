"""Decision trees on a 0/1 class over features cut into bins, grown level by level in one process (numpy).

The rules are those of the library's forests: a node looks at a random subset of the features, splits where the impurity falls most,
both sides keep ``min_leaf`` rows, and two leaves that say the same become one. Gini impurity and the variance
of a 0/1 target differ by a factor of two, so one search serves classes and regression.

A *cell* is ``2 * bin + class``. All open nodes of a level are split together: rows lie sorted by node, chunks of nodes
whose rows and tallies stay near the processor are counted by one pass for each feature, and the chunk's rows are dealt to the
children. Time goes with rows times levels; memory with the rows.

A table that is too large to be held is read block by block instead, for all nodes of a level at once, until every node is small;
then as many nodes as can be held are gathered by one more reading and finished in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Rows and tallies of a chunk of nodes.
_ROWS_AT_ONCE, _TALLIES_AT_ONCE = 1 << 17, 1 << 18
#: Least part of a node's impurity that a split takes away; less is rounding.
_LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Growth:
    """How trees grow: ``bins`` a feature, ``subset`` of all ``features`` a node, ``weights`` of a row of class 0 and 1."""

    bins: int
    features: int
    subset: int
    depth: int
    min_leaf: int
    weights: tuple[float, float] = (1.0, 1.0)
    regression: bool = False

    def prediction(self, tallies: np.ndarray) -> np.ndarray:
        if self.regression:
            return tallies[:, 1] / tallies.sum(axis=1)
        return (tallies[:, 1] * self.weights[1] > tallies[:, 0] * self.weights[0]).astype(float)


class Tree:
    """A tree while it grows: tallies of both classes for each node, and the splits found so far."""

    def __init__(self, root: np.ndarray):
        self.tallies, self.depths = [root.reshape(1, 2)], [np.zeros(1, np.int32)]
        self.size, self.splits = 1, []

    def split(self, ids: np.ndarray, depth: np.ndarray, feature: np.ndarray, border: np.ndarray, gain: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Splits nodes ``ids``; ``sides`` (nodes, 2, 2) holds the tallies of their children. The ids of the left children come back."""
        left = self.size + 2 * np.arange(len(ids))
        self.splits.append((ids, feature, border, gain, left))
        self.tallies.append(sides.reshape(-1, 2))
        self.depths.append(np.repeat(depth + 1, 2).astype(np.int32))
        self.size += 2 * len(ids)
        return left

    def finished(self, growth: Growth) -> dict[str, np.ndarray]:
        """Nodes, parents before children, without those that say no more than their parent."""
        tallies = np.concatenate(self.tallies)
        feature, border, left = (np.full(self.size, -1, np.int64) for _ in range(3))
        gain, alive, says = np.full(self.size, -1.0), np.ones(self.size, bool), growth.prediction(tallies)
        for ids, of, at, won, child in self.splits:
            feature[ids], border[ids], gain[ids], left[ids] = of, at, won, child
        for ids, *_, child in reversed(self.splits):  # children before parents
            same = (left[child] < 0) & (left[child + 1] < 0) & (says[child] == says[child + 1])
            left[ids[same]] = feature[ids[same]] = -1
            gain[ids[same]] = -1.0
            alive[child[same]] = alive[child[same] + 1] = False
        place = np.cumsum(alive) - 1
        inner = left >= 0
        right = np.where(inner, place[left + 1], -1)
        left = np.where(inner, place[left], -1)
        return {n: v[alive] for n, v in {"tallies": tallies, "feature": feature, "border": border, "gain": gain, "left": left, "right": right, "says": says}.items()}


class _Best:
    """The best split seen so far of each of some nodes."""

    def __init__(self, tallies: np.ndarray, growth: Growth):
        self.growth, self.all, self.n = growth, tallies * growth.weights, tallies.sum(axis=1)
        total = self.all.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.impure = np.nan_to_num(self.all[:, 0] * self.all[:, 1] / total)
        self.left_over = self.impure * (1 - _LEAST_GAIN)
        self.feature, self.border = np.full(len(tallies), -1, np.int64), np.zeros(len(tallies), np.int64)
        self.left, self.total = np.zeros((len(tallies), 2)), total

    def offer(self, feature: np.ndarray, cells: np.ndarray) -> None:
        """``cells``: (nodes, bins, 2) tallies of one feature a node."""
        w0, w1 = self.growth.weights
        below = cells[:, :-1].cumsum(axis=1)
        n0, n1 = below[:, :, 0], below[:, :, 1]
        n = n0 + n1
        least = self.growth.min_leaf
        l0, l1 = (n0, n1) if w0 == w1 == 1.0 else (n0 * w0, n1 * w1)
        r0, r1 = self.all[:, :1] - l0, self.all[:, 1:] - l1
        with np.errstate(invalid="ignore", divide="ignore"):
            rest = l0 * l1 / (l0 + l1)
            rest += r0 * r1 / (r0 + r1)
        rest[(n < least) | (self.n[:, None] - n < least)] = np.inf
        at = rest.argmin(axis=1)
        row = np.arange(len(at))
        found = rest[row, at]
        better = np.flatnonzero(found < self.left_over)
        self.left_over[better], self.feature[better], self.border[better] = found[better], feature[better], at[better]
        self.left[better] = below[better, at[better]]

    def gain(self) -> np.ndarray:
        return (self.impure - self.left_over) / self.total * (1.0 if self.growth.regression else 2.0)


def _cells_of(cells: np.ndarray, feature: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The cell of each row for its node's feature; rows lie sorted by node."""
    if len(sizes) == 1:
        return cells[feature[0]].take(rows)
    at = np.repeat(feature * cells.shape[1], sizes)
    at += rows
    return cells.reshape(-1).take(at)


def _tallied(cells: np.ndarray, feature: np.ndarray, rows: np.ndarray, times: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """(nodes, bins, 2): how often each cell of one feature a node comes."""
    width, out = 2 * bins, None
    for at in range(0, max(1, len(rows)), _ROWS_AT_ONCE) if len(sizes) == 1 else [0]:
        part = slice(at, at + _ROWS_AT_ONCE) if len(sizes) == 1 else slice(None)
        key = _cells_of(cells, feature, rows[part], sizes).astype(np.intp)
        if len(sizes) > 1:
            key += np.repeat(np.arange(len(sizes)) * width, sizes)
        found = np.bincount(key, times[part], len(sizes) * width)
        out = found if out is None else out + found
    return out.reshape(len(sizes), bins, 2)


def _subsets(nodes: int, features: int, subset: int, rng: np.random.Generator) -> np.ndarray:
    """For each node ``subset`` different features."""
    return rng.random((nodes, features)).argsort(axis=1)[:, :subset]


def _open(tallies: np.ndarray, depth: np.ndarray, growth: Growth) -> np.ndarray:
    return (tallies > 0).all(axis=1) & (tallies.sum(axis=1) >= 2 * growth.min_leaf) & (depth < growth.depth)


def _chunks(sizes: np.ndarray, bins: int) -> Iterator[tuple[int, int]]:
    """Ranges of nodes of a bounded number of rows and tallies, or of one node."""
    ends, most, first = np.cumsum(sizes), max(1, _TALLIES_AT_ONCE // (2 * bins)), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, before + _ROWS_AT_ONCE, side="right"))
        last = min(max(last, first + 1), first + most, len(sizes))
        yield first, last
        first = last


def grow(tree: Tree, cells: np.ndarray, rows: np.ndarray, times: np.ndarray, ids: np.ndarray, sizes: np.ndarray, growth: Growth, rng: np.random.Generator) -> None:
    """Grows the nodes ``ids`` to their leaves. ``rows`` (columns of ``cells``) lie sorted by node, ``sizes`` for each, and count ``times``."""
    tallies, depth = np.concatenate(tree.tallies)[ids], np.concatenate(tree.depths)[ids]
    while len(ids):
        subsets, starts, level = _subsets(len(ids), len(cells), growth.subset, rng), np.concatenate([[0], np.cumsum(sizes)]), []
        for a, b in _chunks(sizes, growth.bins):
            own, own_times, own_sizes = rows[starts[a] : starts[b]], times[starts[a] : starts[b]].astype(float), sizes[a:b]
            best = _Best(tallies[a:b], growth)
            for feature in subsets[a:b].T:
                best.offer(feature, _tallied(cells, feature, own, own_times, own_sizes, growth.bins))
            taken = np.flatnonzero(best.feature >= 0)
            sides = np.stack([best.left[taken], tallies[a:b][taken] - best.left[taken]], axis=1)
            left = tree.split(ids[a:b][taken], depth[a:b][taken], best.feature[taken], best.border[taken], best.gain()[taken], sides)
            # children in the order of their ids, and the rows of those that go on
            child, child_depth = np.column_stack([left, left + 1]).ravel(), np.repeat(depth[a:b][taken] + 1, 2)
            goes_on = _open(sides.reshape(-1, 2), child_depth, growth)
            if goes_on.any():
                slot = np.full(b - a, -1)
                slot[taken] = np.arange(len(taken))
                cell = _cells_of(cells, np.maximum(best.feature, 0), own, own_sizes)
                right = cell >= np.repeat(2 * (best.border + 1), own_sizes)
                key = np.repeat(2 * slot, own_sizes) + right
                kept = np.flatnonzero((key >= 0) & goes_on[key])
                key = key[kept]
                order = kept[key.astype(np.uint16 if len(child) < 1 << 16 else np.int64).argsort(kind="stable")]
                counted = np.bincount(key, minlength=len(child))[goes_on]
                level.append((child[goes_on], sides.reshape(-1, 2)[goes_on], child_depth[goes_on], counted, own[order], times[starts[a] : starts[b]][order]))
        if not level:
            return
        ids, tallies, depth, sizes, rows, times = (np.concatenate(x) for x in zip(*level))


def bag(rows: int, draws: tuple[int, ...]) -> np.ndarray:
    """How often each of some rows comes in a tree's sample with replacement; the same for the same ``draws``."""
    return np.minimum(np.random.default_rng([*draws, 0]).poisson(1.0, rows), 255).astype(np.uint8)


#: Reads a table: for each block its cells (features, rows), in the same order each time.
Blocks = Callable[[], Iterator[np.ndarray]]


def grow_trees(blocks: Blocks, rows: list[int], growth: Growth, draws: list[tuple[int, ...]], held_rows: int) -> Iterator[dict[str, np.ndarray]]:
    """A tree for each of ``draws`` over a table of blocks of so many ``rows``, of which no more than ``held_rows`` lie in memory at a time, but for a block."""
    if sum(rows) > held_rows:
        yield from (_grow_streamed(blocks, rows, growth, draw, held_rows) for draw in draws)
        return
    cells, at = None, 0
    for block in blocks():
        if cells is None:
            cells = np.empty((len(block), sum(rows)), block.dtype)
        cells[:, at : at + block.shape[1]] = block
        at += block.shape[1]
    for draw in draws:
        times = np.concatenate([bag(n, (*draw, i)) for i, n in enumerate(rows)])
        yield grow_held(cells, times, growth, np.random.default_rng([*draw, 1]))


def _grow_streamed(blocks: Blocks, rows: list[int], growth: Growth, draw: tuple[int, ...], held_rows: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng([*draw, 1])

    def times(i: int) -> np.ndarray:
        return bag(rows[i], (*draw, i))

    tally = np.zeros(2)
    for i, cells in enumerate(blocks()):
        tally += np.bincount(cells[0] & 1, times(i), 2)
    tree = Tree(tally)
    # where each row lies: a node, or -1 outside the sample and in leaves
    node = [np.where(times(i) > 0, 0, -1).astype(np.int32) for i in range(len(rows))]
    small, sizes = _top(tree, blocks, times, node, growth, rng, held_rows)
    first, ends = 0, np.cumsum(sizes)
    while first < len(small):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + held_rows, side="right")))
        cells, counts, where, at = None, np.empty(ends[last - 1] - before, np.uint8), np.empty(ends[last - 1] - before, np.int32), 0
        for i, block in enumerate(blocks()):
            here = np.flatnonzero(np.isin(node[i], small[first:last]))
            part = slice(at, at + len(here))
            if cells is None:
                cells = np.empty((len(block), len(counts)), block.dtype)
            cells[:, part], counts[part], where[part], at = block[:, here], times(i)[here], node[i][here], at + len(here)
        order = where.argsort(kind="stable").astype(np.int32)
        grow(tree, cells, order, counts[order], small[first:last], sizes[first:last], growth, rng)
        first = last
    return tree.finished(growth)


def grow_held(cells: np.ndarray, times: np.ndarray, growth: Growth, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over cells in memory, each row ``times`` times."""
    rows = np.flatnonzero(times).astype(np.int32)
    tree = Tree(np.bincount(cells[0] & 1, times, 2))
    if len(rows) and _open(tree.tallies[0], tree.depths[0], growth)[0]:
        grow(tree, cells, rows, times[rows], np.zeros(1, np.int64), np.array([len(rows)]), growth, rng)
    return tree.finished(growth)


def _top(tree: Tree, blocks: Blocks, times: Callable, node: list[np.ndarray], growth: Growth, rng: np.random.Generator, held_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits nodes of more than ``held_rows`` rows, a level at each reading; the smaller ones that are left to grow and their rows."""
    small, small_sizes = [], []
    ids, sizes = np.zeros(1, np.int64), np.array([sum(int((n >= 0).sum()) for n in node)])
    if not _open(tree.tallies[0], tree.depths[0], growth)[0]:
        ids, sizes = ids[:0], sizes[:0]
    while True:
        fits = sizes <= held_rows
        small.append(ids[fits])
        small_sizes.append(sizes[fits])
        ids = ids[~fits]
        if not len(ids):
            return np.concatenate(small), np.concatenate(small_sizes)
        tallies, depth = np.concatenate(tree.tallies)[ids], np.concatenate(tree.depths)[ids]
        subsets = _subsets(len(ids), growth.features, growth.subset, rng)
        sums = np.zeros((growth.subset, len(ids), growth.bins, 2))
        place = np.full(tree.size + 1, -1, np.int64)
        place[ids] = np.arange(len(ids))
        for i, cells in enumerate(blocks()):
            rows, of = _sorted_by(place[node[i]], len(ids))
            counts = times(i)[rows].astype(float)
            for s, feature in enumerate(subsets.T):
                sums[s] += _tallied(cells, feature, rows, counts, of, growth.bins)
        best = _Best(tallies, growth)
        for feature, found in zip(subsets.T, sums):
            best.offer(feature, found)
        taken = best.feature >= 0
        sides = np.stack([best.left[taken], tallies[taken] - best.left[taken]], axis=1)
        left = tree.split(ids[taken], depth[taken], best.feature[taken], best.border[taken], best.gain()[taken], sides)
        child = np.column_stack([left, left + 1]).ravel()
        goes_on = _open(sides.reshape(-1, 2), np.repeat(depth[taken] + 1, 2), growth)
        first = np.full(len(ids), -1, np.int64)
        first[taken] = 2 * np.arange(len(left))
        counted = np.zeros(len(child), np.int64)
        for i, cells in enumerate(blocks()):
            rows, of = _sorted_by(place[node[i]], len(ids))
            right = _cells_of(cells, np.maximum(best.feature, 0), rows, of) >= np.repeat(2 * (best.border + 1), of)
            key = np.repeat(first, of)
            key[key >= 0] += right[key >= 0]
            counted += np.bincount(key[key >= 0], minlength=len(child))
            node[i][rows] = np.where((key >= 0) & goes_on[key], child[key], -1) if len(child) else -1
        ids, sizes = child[goes_on], counted[goes_on]


def _sorted_by(place: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a place, sorted by it, and how many have each."""
    rows = np.flatnonzero(place >= 0)
    own = place[rows]
    return rows[own.argsort(kind="stable")], np.bincount(own, minlength=nodes)
