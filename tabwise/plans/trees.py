"""Boosted trees (M5, M6) over binned features.

Features are cut at quantiles into at most ``BINS`` bins and the rows packed into blocks (bin codes, label, folds), which are kept
for the passes of a training. A pass is per-partition array work without a schema, and a training makes hundreds of
them, so they run on the blocks' RDD: a job without a plan of its own costs a third of one with. Boosting grows a level a pass: every task sums gradients and counts by (model, node, feature, bin), the
sums are merged in two levels, and the driver picks the best cut of each node. The models of a K-fold
resampling share each pass, as a block's rows are added to the histograms of every model that trains on them. A row's margins are
carried in its block; the first pass of a round brings them up to date, so that is no job of its own. Rows of equal bins are one cell of their block:
margins, nodes and histograms are formed for cells, from the cells' sums of rows and labels by fold, which a pass counts from the rows (without
a bag, once for all passes). Where all rows differ, a cell is a row.

Features of few bins are bundled: a bundle's code is the number of the combination of its features' bins, at most ``JOINT`` of them. One histogram a bundle
holds those of all its features, which are its marginal sums, and the same key tells to which side of a cut a row goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counted import groups
from ..functions.partials import summed_rdd
from ..functions.quantiles import as_double
from ..session import ensure_checkpoint_dir, ship_package

BINS = 256
BLOCK_ROWS = 1 << 15
CELL_ROWS = 1 << 20  # rows of a partition's blocks that share their cells
REFRESH = 1  # rounds between two updates of the carried margins
CUT = 30  # updates between two checkpoints of the blocks
TIE = 1e-9  # gains this close are equal
JOINT = 1 << 10  # combinations of a bundle of features, unless one feature alone has more bins


# ---------------------------------------------------------------- bins and blocks

def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature (a value belongs to the first edge that is not below it): quantiles, all distinct."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(as_double(f), probs, 20 * bins).alias(f"q{i}") for i, f in enumerate(features)],
                 *[F.max(as_double(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    edges = [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(features))]
    return [e[e < row[f"m{i}"]] if row[f"m{i}"] is not None else e for i, e in enumerate(edges)]


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, x[:, i], "left")
    return out


def bundles(widths: list[int], most: int | None = None) -> list[list[int]]:
    """The features dealt into bundles of at most ``most`` combinations of bins: each goes to the first bundle that has room."""
    out, sizes = [], []
    for f, w in enumerate(widths):
        at = next((i for i, size in enumerate(sizes) if size * w <= (most or JOINT)), None)
        if at is None:
            out.append([f])
            sizes.append(w)
        else:
            out[at].append(f)
            sizes[at] *= w
    return out


def joint_codes(codes: np.ndarray, widths: list[int], dealt: list[list[int]]) -> np.ndarray:
    """A row a bundle: the first feature is the most significant digit."""
    out = np.zeros((len(dealt), len(codes)), np.uint16)
    for i, mine in enumerate(dealt):
        for f in mine:
            out[i] = out[i] * np.uint16(widths[f]) + codes[:, f]
    return out


def _packer(edges, n_folds: int):
    def block(part, number, x):
        codes = codes_of(x[:, :len(edges)], edges)
        y, folds = np.ascontiguousarray(x[:, len(edges)]), x[:, len(edges) + 1:].astype(np.int8)
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number]), pa.array([len(x)], pa.int64()), pa.array([codes.tobytes()], pa.binary()),
             pa.array([y.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(folds).tobytes()], pa.binary())],
            ["block", "n", "codes", "y", "folds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1))
                size += b.num_rows
            if size >= BLOCK_ROWS:
                yield block(part, number, np.concatenate(held))
                number, held, size = number + 1, [], 0
        if size:
            yield block(part, number, np.concatenate(held))

    return run


@dataclass
class Rows:
    """Arrays of neighbouring blocks. ``joint`` has a row a bundle and a column a cell, ``margin`` holds the carried part of each model's prediction
    of a cell. An entry is ``n`` rows of a ``cell`` and of the same ``folds`` with labels that sum to ``y`` and vary by ``spread`` (sum of squares about their mean);
    as long as a bag draws rows, an entry is a row."""

    draws: list  # (block, number of its rows)
    joint: np.ndarray
    cell: np.ndarray
    y: np.ndarray
    folds: np.ndarray
    n: np.ndarray
    spread: np.ndarray
    margin: np.ndarray

    @property
    def cells(self) -> int:
        return self.joint.shape[1]

    def grouped(self) -> "Rows":
        """Entries of equal cell and folds as one."""
        first, group = groups([self.cell, *self.folds.T])
        n, y = (np.bincount(group, a, len(first)) for a in (self.n, self.y))
        rest = self.y - self.n * (y / n).take(group)
        spread = np.bincount(group, self.spread + rest * rest / self.n, len(first))
        return replace(self, cell=self.cell[first], y=y, folds=np.ascontiguousarray(self.folds[first]), n=n, spread=spread)

    def sums(self, folds: list, k: int, chosen=None):
        """For each model, the number of rows of each cell that it trains on, and the sum of their labels."""
        cell, y, n, of = (a if chosen is None else a[chosen] for a in (self.cell, self.y, self.n, self.folds))
        size = self.cells
        if not folds:
            yield np.bincount(cell, n, size), np.bincount(cell, y, size)
            return
        for r in range(of.shape[1]):
            key = of[:, r] * np.int64(size) + cell
            count, total = (np.bincount(key, a, k * size).reshape(k, size) for a in (n, y))
            whole, all_y = count.sum(0), total.sum(0)
            if r == 0:
                yield whole, all_y
            for f in range(k):
                mine = whole - count[f]
                yield mine, np.where(mine > 0, all_y - total[f], 0.0)


@dataclass
class Blocks:
    """Packed rows of a training table: an RDD of ``Rows``, kept."""

    rdd: RDD
    edges: list
    folds: list  # (repeat, fold) of each held-out model

    @property
    def models(self) -> int:
        return 1 + len(self.folds)

    def summed(self, partial) -> np.ndarray:
        return summed_rdd(self.rdd, partial)


@contextmanager
def packed(prepared: DataFrame, features: list[str], label: str, fold_cols: list[str], k: int):
    """The table as kept blocks; model 0 trains on all rows, model 1 + r * k + f on those outside fold f of repeat r."""
    ship_package(prepared.sparkSession)
    edges = bin_edges(prepared, features)
    rows = prepared.select(*[as_double(f).alias(f"_x{i}") for i, f in enumerate(features)], as_double(label).alias("_y"),
                           *[F.col(c).cast("double") for c in fold_cols])
    rows = rows.na.drop("any", subset=[f"_x{i}" for i in range(len(features))] + ["_y"])
    blocks = rows.mapInArrow(_packer(edges, len(fold_cols)), "block long, n long, codes binary, y binary, folds binary")
    models, p, reps = 1 + len(fold_cols) * k, len(features), len(fold_cols)
    widths = [len(e) + 1 for e in edges]
    dealt = bundles(widths)

    def unpack(rows):
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += row.n
            if size >= CELL_ROWS:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    def joined(held):
        codes, y, folds = (np.concatenate([np.frombuffer(row[c], t) for row in held]) for c, t in (("codes", np.uint8), ("y", float), ("folds", np.int8)))
        joint = joint_codes(codes.reshape(-1, p), widths, dealt)
        first, cell = groups(list(joint))
        return Rows([(row["block"], row["n"]) for row in held], joint.take(first, 1), cell, y, folds.reshape(len(y), reps), np.ones(len(y)),
                    np.zeros(len(y)), np.zeros((models, len(first))))

    rdd = blocks.rdd.mapPartitions(unpack).persist()
    try:
        yield Blocks(rdd, edges, [(r, f) for r in range(reps) for f in range(k)])
    finally:
        rdd.unpersist()


# ---------------------------------------------------------------- level-wise trees

@dataclass
class LevelTree:
    """A tree of fixed depth in heap order; a node that is not cut sends all its rows left."""

    feature: np.ndarray
    cut: np.ndarray  # codes up to this one go left
    value: np.ndarray  # of the 2 ** depth last nodes

    @classmethod
    def empty(cls, depth: int) -> "LevelTree":
        return cls(np.zeros(2 ** depth - 1, np.int32), np.full(2 ** depth - 1, 255, np.int32), np.zeros(2 ** depth))

    def place(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Number, within its level, of the node that each row reaches after ``levels`` cuts."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            node = 2 * node + 1 + (codes[rows, self.feature[node]] > self.cut[node])
        return node - (2 ** levels - 1)

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.place(codes, int(math.log2(len(self.value))))]


def best_cuts(grad: np.ndarray, hess: np.ndarray, widths: list[int], l2: float, least: float):
    """``(gain, feature, cut, left gradient, left hessian)`` of the best cut of each node, from (nodes x bins) sums.

    The gain is G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2), both sides with a hessian of at least ``least``; ties go to
    the first feature and the lowest cut. No possible cut: gain 0.
    """
    n = len(grad)
    best, feature, cut = np.zeros(n), np.zeros(n, np.int32), np.full(n, 255, np.int32)
    left_g, left_h, at = np.zeros(n), np.zeros(n), 0
    total_g, total_h = grad[:, :widths[0]].sum(1), hess[:, :widths[0]].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(total_h + l2 > 0, total_g ** 2 / (total_h + l2), 0.0)
        for f, w in enumerate(widths):
            if w > 1:
                gl, hl = (np.cumsum(a[:, at:at + w - 1], 1) for a in (grad, hess))
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - whole[:, None]
                gain = np.where((hl >= least) & (hr >= least) & (hl > 0) & (hr > 0), gain, 0.0)
                j = gain.argmax(1)
                g = gain[np.arange(n), j]
                # rounding of sums is no gain, and does not tell two cuts into the same rows apart
                better = (g > best * (1 + TIE)) & (g > 1e-9 * np.maximum(whole, 1e-300)) & (g > 1e-12)
                best, feature, cut = np.where(better, g, best), np.where(better, f, feature), np.where(better, j, cut)
                left_g = np.where(better, gl[np.arange(n), j], left_g)
                left_h = np.where(better, hl[np.arange(n), j], left_h)
            at += w
    return best, feature.astype(np.int32), cut.astype(np.int32), left_g, left_h


class Sides:
    """Which way the rows go at each level of a tree, as tables over (node, combination) a bundle.

    Node ``2 ** level`` of a level, one more than there are, is that of the rows that take no part: they stay in it.
    """

    def __init__(self, tree: LevelTree, levels: int, widths: list[int], dealt: list[list[int]]):
        self.sizes = [math.prod(widths[f] for f in mine) for mine in dealt]
        digits = {}
        for mine, size in zip(dealt, self.sizes):
            step = size
            for f in mine:
                step //= widths[f]
                digits[f] = np.arange(size) // step % widths[f]
        of = {f: i for i, mine in enumerate(dealt) for f in mine}
        self.levels = []
        for level in range(levels):
            at = 2 ** level - 1
            tables = {}
            for j in range(2 ** level):
                f, cut = int(tree.feature[at + j]), int(tree.cut[at + j])
                if cut < widths[f] - 1:
                    i = of[f]
                    tables.setdefault(i, np.zeros((2 ** level + 1, self.sizes[i]), np.int64))[j] = digits[f] > cut
            self.levels.append([(i, t.ravel()) for i, t in tables.items()])

    def place(self, joint: np.ndarray, node: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Nodes of the last level of rows that begin in ``node`` (0, or 1: no part), which is changed."""
        for tables in self.levels:
            sides = []
            for i, table in tables:
                np.multiply(node, self.sizes[i], out=scratch)
                scratch += joint[i]
                sides.append(table.take(scratch))
            node += node
            for side in sides:
                node += side
        return node


def marginal(cells: np.ndarray, widths: list[int], dealt: list[list[int]], out: np.ndarray) -> None:
    """Add a bundle list's (node, combination) sums to ``out``, (node, bin) with the features side by side."""
    starts = np.cumsum([0, *widths])
    for mine, c in zip(dealt, cells):
        c = c.reshape(-1, *[widths[f] for f in mine])
        for j, f in enumerate(mine, 1):
            out[:, starts[f]:starts[f] + widths[f]] += c.sum(tuple(a for a in range(1, c.ndim) if a != j))


@dataclass
class Boosted:
    edges: list
    base: float
    trees: list
    gain: np.ndarray
    held_out: list  # RMSE of each fold

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = codes_of(x, self.edges)
        return self.base + sum((t.score(codes) for t in self.trees), np.zeros(len(x)))

    def expr(self, features: list[str]) -> Column:
        """The prediction as a column, scored a batch at a time."""
        model = self

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict(x.to_numpy(dtype=float)))

        return score(F.struct(*[as_double(f).alias(f"_x{i}") for i, f in enumerate(features)]))


def boost(blocks: Blocks, rounds: int, depth: int, rate: float, l2: float = 0.0, least: float = 1.0, bag: float = 1.0, seed: int = 42) -> Boosted:
    """Gradient boosting of squared errors by second-order cuts, all resampled models at once.

    ``l2`` is the penalty on leaf values, ``least`` the least hessian (rows) of a side, ``bag`` the share of each block's rows that a tree sees.
    """
    folds, models, widths = blocks.folds, blocks.models, [len(e) + 1 for e in blocks.edges]
    p, dealt, k = len(widths), bundles(widths), 1 + max((f for _, f in folds), default=0)
    sizes = [math.prod(widths[f] for f in mine) for mine in dealt]

    def sums(blocks):
        out = np.zeros((models, 2))
        for rows in blocks:
            for m, (n, y) in enumerate(rows.sums(folds, k)):
                out[m] += n.sum(), y.sum()
        return out

    count, total = blocks.summed(sums).T
    base = total / np.maximum(count, 1)
    recent: list = []  # trees that the carried margins do not have yet
    first: list = []  # trees of model 0
    gains = np.zeros(p)
    current, added = blocks, False  # whether the carried margins have the mean
    entries = Rows.grouped if bag >= 1 else lambda rows: rows
    updates = 0
    ensure_checkpoint_dir(SparkSession.getActiveSession())

    def sides_of(recent: list):
        return [[Sides(t[m], depth, widths, dealt) for m in range(models)] for t in recent]

    def margins(rows: Rows, m: int, recent: list, sides: list, added: bool) -> np.ndarray:
        """Of the cells."""
        out = rows.margin[m] if added else rows.margin[m] + base[m]
        if recent:
            scratch = np.empty(len(out), np.int64)
            for t, s in zip(recent, sides):
                out = out + t[m].value.take(s[m].place(rows.joint, np.zeros(len(out), np.int64), scratch))
        return out

    def bagged(rows: Rows, number: int) -> np.ndarray:
        chosen, at = np.zeros(len(rows.y), bool), 0
        for block, n in rows.draws:
            chosen[at + np.random.default_rng([seed, number, block]).permutation(n)[:round(bag * n)]] = True
            at += n
        return np.flatnonzero(chosen)

    def level_pass(number: int, level: int, trees: list, recent: list, added: bool):
        nodes = 2 ** level

        def partial(blocks):
            cells = [[[np.zeros(nodes * size) for size in sizes] for _ in range(2)] for _ in range(models)]
            upper, late = [Sides(t, level, widths, dealt) for t in trees], sides_of(recent)
            for rows in blocks:
                key = np.empty(rows.cells, np.int64)
                for m, (n, y) in enumerate(rows.sums(folds, k, bagged(rows, number) if bag < 1 else None)):
                    grad = n * margins(rows, m, recent, late, added) - y
                    node = upper[m].place(rows.joint, np.zeros(rows.cells, np.int64), key)
                    for i, size in enumerate(sizes):
                        np.multiply(node, size, out=key)
                        key += rows.joint[i]
                        cells[m][0][i] += np.bincount(key, grad, nodes * size)
                        cells[m][1][i] += np.bincount(key, n, nodes * size)
            out = np.zeros((models, 2, nodes, sum(widths)))
            for m in range(models):
                for a in range(2):
                    marginal(cells[m][a], widths, dealt, out[m, a])
            return out

        return partial

    def updated(recent: list, added: bool):
        def run(blocks):
            sides = sides_of(recent)
            for rows in blocks:
                rows = rows if added else entries(rows)
                yield replace(rows, margin=np.stack([margins(rows, m, recent, sides, added) for m in range(models)]))

        return run

    try:
        for number in range(rounds):
            old = None
            if not added or len(recent) >= REFRESH:
                rdd = current.rdd.mapPartitions(updated(list(recent), added)).persist()
                updates += 1
                if updates % CUT == 0:
                    rdd.checkpoint()
                old, current, recent, added = current, Blocks(rdd, blocks.edges, folds), [], True
            trees = [LevelTree.empty(depth) for _ in range(models)]
            live = [np.ones(1, bool) for _ in range(models)]  # nodes of the level that are still grown
            for level in range(depth):
                sums_ = current.summed(level_pass(number, level, trees, recent, added))
                if old is not None and old is not blocks:  # this pass has made the new blocks
                    old.rdd.unpersist()
                old = None
                at, more = 2 ** level - 1, False
                for m in range(models):
                    grad, hess = sums_[m]
                    gain, feature, cut, gl, hl = best_cuts(grad, hess, widths, l2, least)
                    gt, ht = grad[:, :widths[0]].sum(1), hess[:, :widths[0]].sum(1)
                    split = live[m] & (gain > 0)
                    t = trees[m]
                    t.feature[at:at + 2 ** level] = np.where(split, feature, 0)
                    t.cut[at:at + 2 ** level] = np.where(split, cut, 255)
                    # what each child would be worth; a child that is cut later overwrites it
                    span = 2 ** (depth - level - 1)
                    for j in np.flatnonzero(live[m]):
                        both = ((gl[j], hl[j]), (gt[j] - gl[j], ht[j] - hl[j])) if split[j] else ((gt[j], ht[j]), (0.0, 0.0))
                        for side, (g, h) in enumerate(both):
                            t.value[(2 * j + side) * span:(2 * j + side + 1) * span] = -rate * g / (h + l2) if h + l2 > 0 else 0.0
                    live[m] = np.repeat(split, 2)
                    more |= bool(split.any())
                    if m == 0:
                        np.add.at(gains, feature[split], gain[split])
                if not more:
                    break
            recent.append(trees)
            first.append(trees[0])

        def errors(blocks):
            out, sides = np.zeros((models, 2)), sides_of(recent)
            for rows in blocks:
                for m in range(1, models):
                    held = np.flatnonzero(rows.folds[:, folds[m - 1][0]] == folds[m - 1][1])
                    n = rows.n[held]
                    e = margins(rows, m, recent, sides, added).take(rows.cell[held]) - rows.y[held] / n
                    out[m] += n.sum(), (n * e * e + rows.spread[held]).sum()
            return out

        held = current.summed(errors)[1:] if folds else np.zeros((0, 2))
    finally:
        if current is not blocks:
            current.rdd.unpersist()
    return Boosted(blocks.edges, float(base[0]), first, gains, [math.sqrt(s / n) for n, s in held if n])
