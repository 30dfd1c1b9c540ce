"""Trees without a limit of depth, for scoring other rows: no tree is ever held whole.

The library adds up a table of all features for each open node in each task, and keeps the trees on the driver. Without
a limit the open nodes are as many as the rows, so time and memory grow with rows times tasks times features.

Here a row goes to each tree as often as a hash of its id says. Nodes of very many rows are split by cells
(node, feature, bin) that are summed over all rows, one pass for a level; the driver holds these few splits alone. Then
each node's rows meet in a task, which grows all that is below the node. The rows to be scored travel along with
weight 0 and leave with their predictions.

A tree sees bins alone, so rows with the same bins (and class) take the same way. Where these are much fewer than the
rows, as with few columns or columns of few values, they are what a tree is grown from: one row for all alike, with the sums of
their weights and labels. So is a forest of classes with a limit of depth, which becomes a model of the library.

Splits, bins, impurities and the drawing of features follow the library: the feature's bin borders come from a sample
of rows, one-hot columns are numbers, a split must gain, leaves that predict the same class are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.constants import SEED
from gridwright.functions.storage import staged

#: Bins of a feature, and rows that their borders are drawn from.
BINS, BORDER_ROWS = 32, 10_000
#: Rows of a node that meet in one task, and the numbers in their vectors.
NODE_ROWS, NODE_ENTRIES = 100_000, 4_000_000
#: Cells and numbers that a task holds at once.
HELD_CELLS, HELD_NUMBERS = 1 << 23, 1 << 22
#: Rows that differ in their bins from which a limited forest is grown, or that a task holds, and how many times as many rows there must be.
ALIKE, TIMES = 400_000, 4
#: A gain below this share of a node's impurity is rounding.
ROUNDING = 1e-10
#: The chance of being drawn so many times or fewer, for as many draws as there are rows.
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


@dataclass(frozen=True)
class SpreadTrees:
    """The training rows themselves, with what growing the trees needs to know."""

    train: DataFrame  # row id, features, label
    rows: int
    trees: int
    classes: int  # 0 for numbers
    least: int  # rows of a leaf
    depth: int
    some: bool  # each node draws the root of the number of features


@dataclass(frozen=True)
class Plan:
    width: int  # features
    zero: np.ndarray  # of each feature, the bin of 0
    classes: int
    least: int
    depth: int
    tried: int  # features that a node tries
    draws: bool  # rows are drawn, not taken once each
    codes: np.ndarray  # feature * BINS + bin of all bins that there are, rising
    place: np.ndarray  # the place of each code among them


@dataclass
class Top:
    """The splits of one tree down to nodes that fit in a task; the right child follows the left one."""

    feature: list[int]  # -1: none
    border: list[int]
    left: list[int]
    depth: list[int]
    path: list[int]
    leaf: dict[int, list[float]]  # sums of the nodes that no split improves


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _children(path: np.ndarray) -> np.ndarray:
    """A number for each child of the nodes with these numbers: left, right, left, right."""
    return _mixed(np.repeat(path, 2) * np.uint64(3) + np.tile(np.array([1, 2], np.uint64), len(path)))


def _weights(ids: np.ndarray, tree: int, plan: Plan) -> np.ndarray:
    """How often a tree draws each row."""
    if not plan.draws:
        return np.ones(len(ids))
    seed = _mixed(np.array([SEED * 1_000_003 + tree], np.uint64))
    share = (_mixed(ids.astype(np.uint64) + seed) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(DRAWN, share, side="right").astype(float)


def _last_tried(path: np.ndarray, plan: Plan) -> np.ndarray | None:
    """The features that a node tries have a draw up to this number; None: all are tried."""
    if plan.tried >= plan.width:
        return None
    step = max(1, HELD_NUMBERS // plan.width)
    every = np.arange(plan.width)
    return np.concatenate([
        np.partition(_draw(path[i : i + step, None], every[None, :]), plan.tried - 1, axis=1)[:, plan.tried - 1]
        for i in range(0, len(path), step)
    ])


def _draw(path: np.ndarray, feature: np.ndarray) -> np.ndarray:
    return _mixed(path + (feature.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


# -- cells and splits ---------------------------------------------------------------


def _sums(group: np.ndarray, weight: np.ndarray, label: np.ndarray, groups: int, classes: int) -> np.ndarray:
    """Per group: the weight of each class, or weight and weighted label."""
    if classes:
        return np.bincount(group * classes + label.astype(np.int64), weight, groups * classes).reshape(groups, classes)
    return np.stack([np.bincount(group, weight, groups), np.bincount(group, weight * label, groups)], axis=1)


def _weight(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(axis=1) if classes else sums[:, 0]


def _purity(sums: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """Weight less impurity, but for a term that all splits of a node share."""
    squares = (sums**2).sum(axis=1) if classes else sums[:, 1] ** 2
    return np.divide(squares, weight, out=np.zeros(len(weight)), where=weight > 0)


def _cells(node: np.ndarray, code: np.ndarray, nodes: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The different (node, feature, bin) as rising numbers, and the place of each entry's one among them."""
    size = nodes * len(plan.codes)
    if size > max(HELD_NUMBERS, 4 * len(code)):
        return np.unique(node * (plan.width * BINS) + code, return_inverse=True)
    slot = node * len(plan.codes) + plan.place[code]
    there = np.zeros(size, bool)
    there[slot] = True
    cell = np.flatnonzero(there)
    number, at = np.divmod(cell, max(1, len(plan.codes)))
    return number * (plan.width * BINS) + plan.codes[at], (np.cumsum(there) - 1)[slot]


def _best(cell: np.ndarray, sums: np.ndarray, totals: np.ndarray, impurity: np.ndarray, plan: Plan):
    """(feature, border) of the best split of each node, feature -1 where none gains.

    ``cell`` numbers (node, feature, bin) and rises; cells of a feature's bin of 0 are left out. For numbers, labels are
    counted from the node's mean.
    """
    feature, border = np.full(len(totals), -1), np.zeros(len(totals), int)
    if not len(cell):
        return feature, border
    pair = cell // BINS
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    rest = totals[pair[first] // plan.width] - np.add.reduceat(sums, first, axis=0)
    some = _weight(rest, plan.classes) > 0.5
    cell = np.concatenate([cell, (pair[first] * BINS + plan.zero[pair[first] % plan.width])[some]])
    sums = np.concatenate([sums, rest[some]])
    order = np.argsort(cell, kind="stable")
    cell, sums = cell[order], sums[order]
    pair = cell // BINS
    node = pair // plan.width
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    upto = np.cumsum(sums, axis=0)
    before = np.concatenate([np.zeros((1, sums.shape[1])), upto])[first]
    left = upto - np.repeat(before, np.diff(first, append=len(cell)), axis=0)
    right = totals[node] - left
    a, b = _weight(left, plan.classes), _weight(right, plan.classes)
    gain = _purity(left, a, plan.classes) + _purity(right, b, plan.classes)
    gain -= _purity(totals, _weight(totals, plan.classes), plan.classes)[node]
    gain[(a < plan.least) | (b < plan.least) | (gain <= ROUNDING * impurity[node])] = -1.0
    start = np.flatnonzero(np.diff(node, prepend=-1))
    most = np.repeat(np.maximum.reduceat(gain, start), np.diff(start, append=len(cell)))
    at = np.flatnonzero((gain == most) & (gain > 0))
    found, place = np.unique(node[at], return_index=True)
    chosen = at[place]
    feature[found], border[found] = pair[chosen] % plan.width, cell[chosen] % BINS
    return feature, border


def _right(feature: np.ndarray, border: np.ndarray, row: np.ndarray, code: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether each row goes right, by the feature and border of its node."""
    own = plan.zero[feature]
    hit = code // BINS == feature[row]
    own[row[hit]] = code[hit] % BINS
    return own > border


def grow(weight: np.ndarray, label: np.ndarray, row: np.ndarray, code: np.ndarray, depth: int, path: int, plan: Plan, within: np.ndarray | None = None):
    """The subtree of one node: (number of each row's leaf, sums of all nodes by number).

    ``row`` and ``code`` list the numbers of the rows' vectors (feature * BINS + bin). Rows of weight 0 only follow.
    ``within`` holds the squares of the labels around the one that stands for them, where a row stands for some.
    """
    at, sums, _, _, children = _grown(weight, label, row, code, depth, path, plan, within)
    if plan.classes:
        at = _joined(sums, children)[at]
    return at, np.concatenate(sums)


def _grown(weight, label, row, code, depth, path, plan, within=None):
    """Number of each row's leaf, and by level the sums, features, borders and left children of the nodes, before leaves are joined."""
    at = np.zeros(len(weight), np.int64)
    live, base, paths = np.arange(len(weight)), 0, np.array([path], np.uint64)
    sums, features, borders_, children = [], [], [], []
    while True:
        here, w, y = at[live] - base, weight[live], label[live]
        totals = _sums(here, w, y, len(paths), plan.classes)
        sums.append(totals)
        if plan.classes:
            centred, shifted = y, totals
            impurity = _weight(totals, plan.classes) - _purity(totals, _weight(totals, plan.classes), plan.classes)
        else:
            centred = y - (totals[:, 1] / totals[:, 0])[here]
            shifted = _sums(here, w, centred, len(paths), 0)
            impurity = np.bincount(here, w * centred**2 + (0.0 if within is None else within[live]), len(paths))
        feature, border = np.full(len(paths), -1), np.zeros(len(paths), int)
        if depth < plan.depth:
            place = np.zeros(len(at), np.int64)
            place[live] = np.arange(len(live))
            taken = place[row]
            open_ = (impurity > 0) & (_weight(totals, plan.classes) >= 2 * plan.least)
            use = (w[taken] > 0) & open_[here[taken]]
            last = _last_tried(paths, plan)
            if last is not None:
                use[use] = _draw(paths[here[taken[use]]], code[use] // BINS) <= last[here[taken[use]]]
            taken, codes = taken[use], code[use]
            cell, inverse = _cells(here[taken], codes, len(paths), plan)
            found = _sums(inverse, w[taken], centred[taken], len(cell), plan.classes)
            feature, border = _best(cell, found, shifted, impurity, plan)
        split = feature >= 0
        left = np.where(split, base + len(paths) + 2 * (np.cumsum(split) - 1), -1)
        features.append(feature)
        borders_.append(border)
        children.append(left)
        if not split.any():
            return at, sums, features, borders_, children
        moving = split[here]
        live, here = live[moving], here[moving]
        place = np.full(len(at), -1)
        place[live] = np.arange(len(live))
        kept = place[row] >= 0
        row, code = row[kept], code[kept]
        at[live] = left[here] + _right(feature[here], border[here], place[row], code, plan)
        base, paths, depth = base + len(paths), _children(paths[split]), depth + 1


def _joined(sums: list[np.ndarray], children: list[np.ndarray]) -> np.ndarray:
    """The node that stands for each node once leaves that predict the same class are joined."""
    says = np.concatenate([s.argmax(axis=1) for s in sums])
    left = np.concatenate(children)
    starts = np.cumsum([0, *(len(c) for c in children)])
    for lo, hi in zip(starts[-2::-1], starts[:0:-1]):
        inner = np.flatnonzero(left[lo:hi] >= 0) + lo
        a = left[inner]
        same = (left[a] < 0) & (left[a + 1] < 0) & (says[a] == says[a + 1])
        left[inner[same]] = -2
    stands = np.arange(len(left))
    first = np.concatenate(children)
    for lo, hi in zip(starts[:-1], starts[1:]):
        inner = np.flatnonzero(first[lo:hi] >= 0) + lo
        gone = (left[inner] == -2) | (stands[inner] != inner)
        for side in (0, 1):
            stands[first[inner[gone]] + side] = stands[inner[gone]]
    return stands


# -- steps over the rows ------------------------------------------------------------


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all numbers but 0 in a batch of vectors."""
    held = batch.column("v")
    kind, listed, numbers = (held.field(n) for n in ("type", "indices", "values"))
    sizes = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = numbers.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # the places of a dense vector
    sparse = (kind.to_numpy(zero_copy_only=False) == 0)[row]
    feature[sparse] = listed.flatten().to_numpy(zero_copy_only=False)
    some = value != 0
    return row[some], feature[some], value[some]


def borders(values: list[float], zeros: int) -> list[float]:
    """The borders between the bins of a feature, as the library draws them."""
    found, counts = np.unique(np.array([*values, *[0.0] * min(zeros, 1)]), return_counts=True)
    counts = counts.astype(float)
    if zeros:
        counts[np.searchsorted(found, 0.0)] = zeros
    middle = ((found[:-1] + found[1:]) / 2.0).tolist()
    if len(middle) < BINS:
        return middle
    step = counts.sum() / BINS
    upto, target, taken = counts[0], step, []
    for i in range(1, len(found)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            taken.append(middle[i - 1])
            target += step
    return taken[: BINS - 1]


def _borders(drawn_rows: DataFrame, vector: str) -> tuple[int, dict[int, list[float]]]:
    """The width of the vectors, and the borders of each feature that has any."""
    sample = staged(drawn_rows.select(F.col(vector).alias("v")))
    rows, width = sample.agg(F.count("*"), F.max(F.size(vector_to_array("v")))).first()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, feature, value = _vectors(batch)
            yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(value, pa.float64())], ["f", "x"])

    def drawn(part: pa.Table) -> pa.Table:
        found = borders(part["x"].to_pylist(), rows - part.num_rows)
        return pa.table({"f": part["f"][:1].combine_chunks(), "at": pa.array([found], pa.list_(pa.float64()))})

    table = sample.mapInArrow(listed, "f int, x double").groupBy("f").applyInArrow(drawn, "f int, at array<double>")
    return width, {r["f"]: r["at"] for r in table.collect() if r["at"]}


def _planned(width: int, found: dict[int, list[float]], classes: int, least: int, depth: int, some: bool, draws: bool) -> Plan:
    zero = np.zeros(width, np.int64)
    for f, at in found.items():
        zero[f] = np.searchsorted(np.array(at), 0.0)
    codes = np.array([f * BINS + i for f in sorted(found) for i in range(len(found[f]) + 1)], np.int64)
    place = np.zeros(width * BINS, np.int64)
    place[codes] = np.arange(len(codes))
    return Plan(width, zero, classes, least, depth, int(np.ceil(np.sqrt(width))) if some else width, draws, codes, place)


def _binning(found: dict[int, list[float]], zero: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes of ``id, y, v`` the row's ``id, y, e``: its numbers as feature * BINS + bin, but for those in the bin of 0."""
    names = np.array(sorted(found), np.int64)
    sizes = np.array([len(found[f]) for f in names], np.int64)
    flat = np.array([x for f in names for x in found[f]])
    start = np.zeros(len(zero), np.int64)
    count = np.zeros(len(zero), np.int64)
    start[names], count[names] = np.cumsum(sizes) - sizes, sizes

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, value = _vectors(batch)
            low, high = start[feature], start[feature] + count[feature]
            for _ in range(int(count.max(initial=0)).bit_length()):  # halving: how many borders are below the value
                middle = (low + high) // 2
                more = low < high
                more[more] = value[more] > flat[middle[more]]
                low, high = np.where(more, middle + 1, low), np.where(more, high, np.maximum(middle, low))
            place = low - start[feature]
            kept = place != zero[feature]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))])
            e = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((feature * BINS + place)[kept], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), e], ["id", "y", "e"])

    return bins


def _binned(df: DataFrame, vector: str, key: str, label: str, found: dict[int, list[float]], zero: np.ndarray, fresh: bool) -> DataFrame:
    """``id, y, e, fresh``: the row's id, label (0 if ``fresh``), and its bins."""
    y = F.lit(0.0) if fresh else F.col(label).cast("double")
    rows = df.select(F.col(key).alias("id"), y.alias("y"), F.col(vector).alias("v"))
    return staged(rows.mapInArrow(_binning(found, zero), "id long, y double, e array<int>").withColumn("fresh", F.lit(fresh)))


def _entries(listed) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of a column of lists."""
    listed = listed.combine_chunks() if isinstance(listed, pa.ChunkedArray) else listed
    sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _bins(rows: int, row: np.ndarray, code: np.ndarray, plan: Plan) -> np.ndarray | None:
    """The bins of all features of each row, if they are few enough to be held."""
    if rows * plan.width > HELD_NUMBERS:
        return None
    bins = np.tile(plan.zero.astype(np.uint8), (rows, 1))
    bins[row, code // BINS] = code % BINS
    return bins


def _routed(
    top: Top, rows: int, row: np.ndarray, code: np.ndarray, plan: Plan, bins: np.ndarray | None = None, live: np.ndarray | None = None
) -> np.ndarray:
    """The node of each row that the splits so far lead to; with ``bins`` only rows that are ``live`` need move."""
    feature, border, left = (np.array(x, np.int64) for x in (top.feature, top.border, top.left))
    at = np.zeros(rows, np.int64)
    if bins is not None:
        live = np.arange(rows) if live is None else live
        while True:
            here = at[live]
            inner = feature[here] >= 0
            live, here = live[inner], here[inner]
            if not len(live):
                return at
            at[live] = left[here] + (bins[live, feature[here]] > border[here])
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        goes = _right(np.where(inner, feature[at], 0), border[at], row, code, plan)
        at = np.where(inner, left[at] + goes, at)


def _split_once(train: DataFrame, tops: list[Top], open_: list[tuple[int, int]], mean: float, plan: Plan) -> list:
    """(tree, node, feature, border, sums, weight to the left, weight to the right) of the open nodes, by one pass over the rows."""
    number = {one: i for i, one in enumerate(open_)}
    cells = len(plan.codes) + 1  # the last one is the node's total
    slots = plan.classes or 3
    first = {tree: min(i for i, (t, _) in enumerate(open_) if t == tree) for tree in {t for t, _ in open_}}
    count = {tree: sum(t == tree for t, _ in open_) for tree in first}
    dense = len(open_) * cells * slots <= HELD_CELLS

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate([s for _, s in parts]), len(key))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        table = np.zeros(len(open_) * cells * slots if dense else 0)
        names, paths, lasts = {}, {}, {}
        for tree in sorted(first):
            names[tree] = np.full(len(tops[tree].feature), -1)
            paths[tree] = np.array(tops[tree].path, np.uint64)
            lasts[tree] = _last_tried(paths[tree], plan)
        for t, n in open_:
            names[t][n] = number[t, n]
        for batch in batches:
            ids, label = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "y"))
            row, code = _entries(batch.column("e"))
            bins = _bins(len(ids), row, code, plan)
            for tree in sorted(first):
                w = _weights(ids, tree, plan)
                at = _routed(tops[tree], len(ids), row, code, plan, bins, np.flatnonzero(w > 0))
                mine = np.where(w > 0, names[tree][at], -1)
                use = mine[row] >= 0
                last = lasts[tree]
                if last is not None:
                    node = at[row[use]]
                    use[use] = _draw(paths[tree][node], code[use] // BINS) <= last[node]
                rows = np.concatenate([row[use], np.flatnonzero(mine >= 0)])
                key = mine[rows] * cells + np.concatenate([plan.place[code[use]], np.full(len(rows) - use.sum(), cells - 1)])
                if plan.classes:
                    pairs = [(key * slots + label[rows].astype(np.int64), w[rows])]
                else:
                    y = label[rows] - mean
                    pairs = [(key * slots + i, w[rows] * y**i) for i in range(3)]
                if dense:  # the nodes of a tree have numbers next to each other
                    lo, size = first[tree] * cells * slots, count[tree] * cells * slots
                    for k, x in pairs:
                        table[lo : lo + size] += np.bincount(k - lo, x, size)
                    continue
                parts.append(merged(pairs))
                held += len(parts[-1][0])
            if held > HELD_CELLS:
                parts = [merged(parts)]
                held = 0
        if dense:
            key = np.flatnonzero(table)
            parts = [(key, table[key])]
        if parts:
            key, s = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key // slots // cells, pa.int32()), pa.array(key // slots % cells, pa.int64()), pa.array(key % slots, pa.int32()), pa.array(s, pa.float64())],
                ["n", "cell", "slot", "s"],
            )

    def chosen(part: pa.Table) -> pa.Table:
        cell, slot, s = (part[n].to_numpy() for n in ("cell", "slot", "s"))
        found, inverse = np.unique(cell, return_inverse=True)
        table = np.zeros((len(found), slots))
        table[inverse, slot] = s
        totals, table, found = table[-1:], table[:-1], plan.codes[found[:-1]]
        shifted = totals
        if not plan.classes:
            average = totals[0, 1] / totals[0, 0]
            table, shifted = (np.stack([t[:, 0], t[:, 1] - average * t[:, 0]], axis=1) for t in (table, totals))
            impurity = totals[:, 2] - totals[:, 1] * average
        else:
            weight = _weight(totals, plan.classes)
            impurity = weight - _purity(totals, weight, plan.classes)
        feature, border = _best(found, table, shifted, impurity, plan)
        mine = np.flatnonzero(found // BINS == feature[0])
        # Cells of the feature's bin of 0 are not listed: what they weigh follows from the total.
        listed = _weight(table[mine], plan.classes)
        goes = found[mine] % BINS > border[0]
        whole = float(_weight(totals, plan.classes)[0])
        over = float(listed[goes].sum())
        if feature[0] >= 0 and plan.zero[feature[0]] > border[0]:
            over += whole - float(listed.sum())
        return pa.table({
            "n": part["n"][:1].combine_chunks(), "f": pa.array(feature, pa.int32()), "b": pa.array(border, pa.int32()),
            "sums": pa.array([totals[0].tolist()], pa.list_(pa.float64())), "right": pa.array([over]), "all": pa.array([whole]),
        })

    table = train.mapInArrow(summed, "n int, cell long, slot int, s double").groupBy("n", "cell", "slot").agg(F.sum("s").alias("s"))
    found = table.groupBy("n").applyInArrow(chosen, "n int, f int, b int, sums array<double>, right double, all double").collect()
    return [(*open_[r["n"]], r["f"], r["b"], r["sums"], r["all"] - r["right"], r["right"]) for r in found]


def _tops(train: DataFrame, rows: int, trees: int, most: int, mean: float, plan: Plan) -> list[Top]:
    """The trees down to nodes of at most ``most`` rows. They are few: rows over ``most`` for each tree, and as many levels."""
    tops = [Top([-1], [0], [-1], [0], _mixed(np.array([tree + 1], np.uint64)).tolist(), {}) for tree in range(trees)]
    open_ = [(tree, 0) for tree in range(trees)] if rows > most else []
    while open_:
        following = []
        for tree, node, feature, border, sums, left, right in _split_once(train, tops, open_, mean, plan):
            top = tops[tree]
            if feature < 0 or top.depth[node] >= plan.depth:
                top.leaf[node] = sums
                continue
            top.feature[node], top.border[node], top.left[node] = feature, border, len(top.feature)
            for path, weight in zip(_children(np.array([top.path[node]], np.uint64)).tolist(), (left, right)):
                if weight > most:
                    following.append((tree, len(top.feature)))
                top.feature.append(-1)
                top.border.append(0)
                top.left.append(-1)
                top.depth.append(top.depth[node] + 1)
                top.path.append(path)
        open_ = sorted(following)
    return tops


# -- rows that are alike ------------------------------------------------------------


def _alike(batches: Iterator[pa.RecordBatch], weighed: Callable, slots: int, classes: int) -> Iterator[tuple[pa.ListArray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a task's rows with the same bins (and class): (bins, class, least id, sums by slot); more than once for very many.

    ``weighed`` gives, for ids and labels, what is summed as (slot, numbers).
    """
    held: dict[tuple[bytes, int], int] = {}
    table, least = np.zeros((slots, 0)), np.zeros(0, np.int64)

    def ended():
        flat = np.frombuffer(b"".join(name for name, _ in held), np.int32)
        ends = np.cumsum([0, *(len(name) // 4 for name, _ in held)])
        e = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return e, np.array([float(c) for _, c in held]), least[: len(held)], table[:, : len(held)]

    for batch in batches:
        ids, label = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "y"))
        listed = batch.column("e")
        ends = np.concatenate([[0], 4 * np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = np.ascontiguousarray(listed.flatten().to_numpy(zero_copy_only=False), np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if classes:
            number = number * classes + label.astype(np.int64)
        seen, place = np.unique(number, return_inverse=True)
        pairs = [(names[i // classes], i % classes) if classes else (names[i], 0) for i in seen.tolist()]
        at = np.array([held.setdefault(p, len(held)) for p in pairs], np.int64)
        if len(held) > len(least):
            more = 2 * len(held) - len(least)
            table, least = np.pad(table, ((0, 0), (0, more))), np.pad(least, (0, more), constant_values=np.iinfo(np.int64).max)
        np.minimum.at(least, at[place], ids)
        for slot, numbers in weighed(ids, label):
            table[slot, at] += np.bincount(place, numbers, len(at))
        if len(held) > ALIKE or len(held) * slots > HELD_CELLS:
            yield ended()
            held, table, least = {}, np.zeros((slots, 0)), np.zeros(0, np.int64)
    if held:
        yield ended()


def _drawn_alike(train: DataFrame, trees: int, mean: float, plan: Plan) -> DataFrame:
    """``tree, id, y, w, q, e``: for each tree the rows with the same bins (and class) as one.

    ``w`` sums how often the rows are drawn; ``y`` is the class or the mean label, ``q`` the squares of labels around it.
    """
    kinds = 1 if plan.classes else 3

    def weighed(ids: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        y = None if plan.classes else label - mean
        for tree in range(trees):
            w = _weights(ids, tree, plan)
            for i in range(kinds):
                yield tree * kinds + i, w * y**i if i else w

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, c, ids, table in _alike(batches, weighed, trees * kinds, plan.classes):
            for tree in range(trees):
                own = table[tree * kinds : (tree + 1) * kinds]
                at = np.flatnonzero(own[0])
                w, s, q = (own[i, at] if i < kinds else np.zeros(len(at)) for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), tree), pa.int32()), pa.array(ids[at]), pa.array(c[at]), pa.array(w), pa.array(s), pa.array(q), e.take(pa.array(at))],
                    ["tree", "id", "y", "w", "s", "q", "e"],
                )

    parts = train.mapInArrow(summed, "tree int, id long, y double, w double, s double, q double, e array<int>")
    sums = parts.repartition(min(trees, 1_000), "tree").groupBy("tree", "e", "y").agg(
        F.min("id").alias("id"), *(F.sum(c).alias(c) for c in ("w", "s", "q"))
    )
    if plan.classes:
        return sums.select("tree", "id", "y", "w", "q", "e")
    average = F.col("s") / F.col("w")
    return sums.select("tree", "id", (F.lit(mean) + average).alias("y"), "w", F.greatest(F.col("q") - F.col("s") * average, F.lit(0.0)).alias("q"), "e")


def _nodes(weight: np.ndarray, label: np.ndarray, row: np.ndarray, code: np.ndarray, tree: int, found: dict[int, list[float]], plan: Plan) -> pa.RecordBatch:
    """A tree for classes as the library's table of nodes."""
    path = int(_mixed(np.array([tree + 1], np.uint64))[0])
    _, sums, *rest = _grown(weight, label, row, code, 0, path, plan)
    stands = _joined(sums, rest[2])
    sums, feature, border, left = (np.concatenate(x) for x in (sums, *rest))
    kept = stands == np.arange(len(stands))
    inner = (left >= 0) & kept
    inner[inner] = kept[left[inner]]
    number = np.cumsum(kept) - 1
    whole = sums.sum(axis=1)
    impurity = 1.0 - (sums**2).sum(axis=1) / whole**2
    gain, a, b = np.full(len(left), -1.0), left[inner], left[inner] + 1
    gain[inner] = impurity[inner] - (whole[a] * impurity[a] + whole[b] * impurity[b]) / whole[inner]
    child = [np.full(len(left), -1) for _ in range(2)]
    child[0][inner], child[1][inner] = number[a], number[b]
    split = [
        {"featureIndex": int(f), "leftCategoriesOrThreshold": [found[f][b]], "numCategories": -1} if i else {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        for f, b, i in zip(feature[kept].tolist(), border[kept].tolist(), inner[kept].tolist())
    ]
    columns = {
        "treeID": np.full(kept.sum(), tree, np.int32), "id": number[kept].astype(np.int32), "prediction": sums[kept].argmax(axis=1).astype(float),
        "impurity": impurity[kept], "impurityStats": sums[kept].tolist(), "rawCount": whole[kept].astype(np.int64), "gain": gain[kept],
        "leftChild": child[0][kept].astype(np.int32), "rightChild": child[1][kept].astype(np.int32),
        "split": pa.array(split, pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    }
    return pa.RecordBatch.from_pydict(columns)


def forest_nodes(train: DataFrame, vector: str, label: str, rows: int, trees: int, classes: int, least: int, depth: int) -> tuple[DataFrame | None, dict]:
    """The library's table of nodes of a forest for classes, grown from the bins, and their borders; None where too many rows differ in them.

    How often a tree draws the rows that are alike is one number: a sum of as many draws as there are rows.
    """
    sample = train.sample(fraction=min(1.0, BORDER_ROWS / rows), seed=SEED) if rows > BORDER_ROWS else train
    width, found = _borders(sample, vector)
    plan = _planned(width, found, classes, least, depth, True, True)
    bins = _binning(found, plan.zero)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, c, _, table in _alike(bins(batches), lambda ids, label: [(0, np.ones(len(ids)))], 1, classes):
            yield pa.RecordBatch.from_arrays([e, pa.array(c), pa.array(table[0])], ["e", "y", "n"])

    slim = train.select(F.lit(0).cast("long").alias("id"), F.col(label).cast("double").alias("y"), F.col(vector).alias("v"))
    cells = staged(slim.mapInArrow(counted, "e array<int>, y double, n double").groupBy("e", "y").agg(F.sum("n").alias("n")))
    alike, entries = cells.agg(F.count("*"), F.sum(F.size("e"))).first()
    if not alike or alike > min(ALIKE, rows / TIMES) or entries > NODE_ENTRIES:
        return None, found
    table = cells.orderBy("e", "y").toArrow()
    row, code = _entries(table["e"])
    y, n = (table[c].to_numpy() for c in ("y", "n"))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                weight = np.random.default_rng([SEED, tree]).poisson(n).astype(float)
                if not weight.any():
                    weight = n
                drawn = weight > 0
                at, use = np.cumsum(drawn) - 1, drawn[row]
                yield _nodes(weight[drawn], y[drawn], at[row[use]], code[use], tree, found, plan)

    kind = (
        "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int,"
        " split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
    )
    numbers = train.sparkSession.range(0, trees, 1, min(trees, 1_000))
    return staged(numbers.mapInArrow(grown, kind)), found


def said_by_bins(model, rows: DataFrame, vector: str, label: str) -> DataFrame | None:
    """Label and prediction of each row by a model with ``borders``, asked once for rows that are alike; None where few are."""
    found, width = model.borders, model.numFeatures
    zero = _planned(width, found, 0, 1, 0, False, False).zero
    asked = _binned(rows.select("*", F.lit(0).cast("long").alias("id")), vector, "id", label, found, zero, False)
    kinds = staged(asked.select("e").distinct())
    alike, all_rows = kinds.count(), asked.count()
    if alike > min(ALIKE, all_rows / TIMES):
        return None

    @F.udf(VectorUDT())
    def inside(e):
        """A vector with these bins."""
        places = sorted(divmod(code, BINS) for code in e)
        values = [found[f][b] if b < len(found[f]) else np.nextafter(found[f][-1], np.inf) for f, b in places]
        return Vectors.sparse(width, [f for f, _ in places], values)

    said = model.transform(kinds.select("e", inside("e").alias(vector))).select("e", model.getPredictionCol())
    # So many rows at most as were counted.
    return asked.select(F.col("y").alias(label), "e").join(F.broadcast(staged(said)), "e").drop("e")


def _said(ids: np.ndarray, leaf: np.ndarray, sums: np.ndarray, plan: Plan) -> pa.Table:
    if not plan.classes:
        value = (sums[:, 1] / sums[:, 0])[leaf]
        return pa.table({"id": pa.array(ids, pa.int64()), "c": pa.array(np.zeros(len(ids)), pa.float64()), "x": pa.array(value)})
    share = sums / sums.sum(axis=1, keepdims=True)
    at, c = np.nonzero(share[leaf])
    return pa.table({"id": pa.array(ids[at], pa.int64()), "c": pa.array(c.astype(float)), "x": pa.array(share[leaf[at], c])})


def _voted(votes: DataFrame, plan: Plan) -> DataFrame:
    """``id, prediction`` from what the trees say."""
    if not plan.classes:
        return votes.groupBy("id").agg(F.avg("x").alias("prediction"))
    sums = votes.groupBy("id", "c").agg(F.sum("x").alias("x"))
    best = F.max(F.struct(F.round("x", 9).alias("x"), (-F.col("c")).alias("minus")))["minus"]
    return sums.groupBy("id").agg((-best).alias("prediction"))


def _of_alike(train: DataFrame, asked: DataFrame, model: SpreadTrees, mean: float, plan: Plan, key: str) -> DataFrame:
    """What ``predictions`` gives, where rows that are alike are few enough to meet in one task for each tree."""
    kinds = staged(asked.groupBy("e").agg(F.min("id").alias("id")))
    every = F.explode(F.sequence(F.lit(0), F.lit(model.trees - 1))).alias("tree")
    fresh = kinds.select(every, "id", *(F.lit(0.0).alias(c) for c in ("y", "w", "q")), "e")

    def grown(part: pa.Table) -> pa.Table:
        part = part.sort_by([("id", "ascending"), ("w", "ascending")])  # sums do not depend on the order of arrival
        ids, w, y, q = (part[n].to_numpy() for n in ("id", "w", "y", "q"))
        row, code = _entries(part["e"])
        path = int(_mixed(np.array([part["tree"][0].as_py() + 1], np.uint64))[0])
        leaf, sums = grow(w, y, row, code, 0, path, plan, q)
        return _said(ids[w == 0], leaf[w == 0], sums, plan)

    spread = _drawn_alike(train, model.trees, mean, plan).unionAll(fresh)
    found = _voted(spread.repartition(min(model.trees, 1_000), "tree").groupBy("tree").applyInArrow(grown, "id long, c double, x double"), plan)
    of_kind = kinds.join(found, "id").select("e", "prediction")
    return asked.select(F.col("id").alias(key), "e").join(of_kind, "e").select(key, "prediction")


def predictions(model: SpreadTrees, rows: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """``key, prediction`` of ``rows``: the mean of the trees' leaves, or the class with most of their shares (smallest on a tie)."""
    ordered = model.train.orderBy(F.xxhash64(key, F.lit(SEED)), key)
    width, found = _borders(ordered.limit(BORDER_ROWS), vector)
    plan = _planned(width, found, model.classes, model.least, model.depth, model.some, model.trees > 1)
    train, asked = (_binned(df, vector, key, label, found, plan.zero, fresh) for df, fresh in ((model.train, False), (rows, True)))
    unknown = F.count_if(F.col("y").isNull() | F.col("y").isin(*map(float, ("nan", "inf", "-inf"))))
    kinds = F.approx_count_distinct(F.xxhash64("e", *(["y"] if model.classes else [])))
    mean, entries, bad, alike = train.agg(F.avg("y"), F.avg(F.size("e")), unknown, kinds).first()
    if bad:
        raise ValueError(f"{bad} training rows have no label.")
    most = int(min(NODE_ROWS, max(1_000, NODE_ENTRIES / max(1.0, entries))))
    if alike <= min(most, model.rows / TIMES) and asked.agg(F.approx_count_distinct(F.xxhash64("e"))).first()[0] <= most:
        return _of_alike(train, asked, model, mean, plan, key)
    tops = _tops(train, model.rows, model.trees, most, mean, plan)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fresh = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "fresh"))
            row, code = _entries(batch.column("e"))
            bins = _bins(len(ids), row, code, plan)
            for tree, top in enumerate(tops):
                w = np.where(fresh, 0.0, _weights(ids, tree, plan))
                at = _routed(top, len(ids), row, code, plan, bins)
                taken = np.flatnonzero((fresh | (w > 0)) & ~np.isin(at, list(top.leaf)))
                if len(taken):
                    part = batch.take(pa.array(taken))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(taken), tree), pa.int32()), pa.array(at[taken], pa.int32()), pa.array(w[taken]), part.column("id"), part.column("y"), part.column("e")],
                        ["tree", "node", "w", "id", "y", "e"],
                    )

    def grown(key: tuple, part: pa.Table) -> pa.Table:
        top, node = tops[key[0].as_py()], key[1].as_py()
        part = part.sort_by("id")  # sums do not depend on the order of arrival
        ids, w, y = (part[n].to_numpy() for n in ("id", "w", "y"))
        row, code = _entries(part["e"])
        leaf, sums = grow(w, y, row, code, top.depth[node], top.path[node], plan)
        asked = w == 0
        return _said(ids[asked], leaf[asked], sums, plan)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            row, code = _entries(batch.column("e"))
            bins = _bins(len(ids), row, code, plan)
            for top in tops:
                if top.leaf:
                    at = _routed(top, len(ids), row, code, plan, bins)
                    names = np.array(sorted(top.leaf))
                    here = np.isin(at, names)
                    sums = np.array([top.leaf[n] for n in names.tolist()])
                    if not plan.classes:
                        sums[:, 1] += mean * sums[:, 0]
                    yield from _said(ids[here], np.searchsorted(names, at[here]), sums, plan).to_batches()

    nodes = sum(f < 0 for top in tops for f in top.feature)
    parts = min(nodes, 1_000)
    spread = train.unionAll(asked).mapInArrow(dealt, "tree int, node int, w double, id long, y double, e array<int>")
    votes = spread.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(grown, "id long, c double, x double")
    if any(top.leaf for top in tops):
        votes = votes.unionAll(asked.mapInArrow(ended, "id long, c double, x double"))
    return _voted(votes, plan).withColumnRenamed("id", key)
