"""Random forest of a class label (R3): rows of equal bins are one cell, each level of all trees is cut from one pass over the cells.

Features are cut into at most ``BINS`` bins: between all values where there are no more, else at quantiles. Rows of equal bins and
class become a cell with their count; the cells are dealt out by hash and kept packed. The bootstrap of a tree draws Poisson(count) for a
cell, which is how the sum of Poisson(1) over its rows is distributed, from (seed, tree, block); nothing is kept for a row and tree. A pass
sums the classes by (node, drawn feature, bin) for the open nodes, and the driver picks the cut of least Gini impurity. Two leaves of one cut
that predict the same class are merged. A prediction is the class of the largest summed share over the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partials import summed_arrays
from ..functions.quantiles import as_double
from ..session import ship_package
from .forest import Tree, child_paths, drawn, root_path
from .trees import bin_edges

BINS = 32
BLOCK_CELLS = 1 << 16
SUMS = 1 << 22  # sums that a pass makes at most (those of one node at least)
TIE = 1e-9  # gains this close are equal


# ---------------------------------------------------------------- bins and cells

def few_values(df: DataFrame, features: list[str], most: int) -> dict[int, np.ndarray]:
    """All values, ascending, of each feature that has at most ``most``; a partition hands over no more than that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0) for _ in features]
        for b in batches:
            for i, c in enumerate(b.columns):
                if seen[i] is not None:
                    there = np.union1d(seen[i], c.to_numpy(zero_copy_only=False))
                    seen[i] = there if len(there) <= most else None
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen, pa.list_(pa.float64()))], ["f", "seen"])

    out: dict = {}
    for r in df.select(*[as_double(f).alias(f"_x{i}") for i, f in enumerate(features)]).mapInArrow(run, "f int, seen array<double>").collect():
        out.setdefault(r["f"], []).append(r["seen"])
    out = {f: np.unique(np.concatenate(lists)) for f, lists in out.items() if all(s is not None for s in lists)}
    return {f: values for f, values in out.items() if len(values) <= most}


def class_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature; a value belongs to the first one that is not below it."""
    few = few_values(df, features, bins)
    many = [i for i in range(len(features)) if i not in few]
    found = dict(zip(many, bin_edges(df, [features[i] for i in many], bins))) if many else {}
    return [few[i][:-1] if i in few else found[i] for i in range(len(features))]


def _names(features) -> list[str]:
    return [f"_b{i}" for i in range(len(features))]


def binned(df: DataFrame, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """``df`` plus the bin of each feature, from 0, as ``_b0``, ``_b1`` and so on."""
    cut = [i for i, e in enumerate(edges) if len(e)]
    rows = df.select("*", *[as_double(f).alias(f"_x{i}") if i in cut else F.lit(0.0).alias(f"_b{i}") for i, f in enumerate(features)])
    if cut:
        splits = [[-math.inf, *np.nextafter(edges[i], np.inf).tolist(), math.inf] for i in cut]
        rows = Bucketizer(splitsArray=splits, inputCols=[f"_x{i}" for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(rows)
    return rows.drop(*[f"_x{i}" for i in cut])


def cells_of(df: DataFrame, features: list[str], label: str, edges: list[np.ndarray]) -> DataFrame:
    """(``_y``, bins, ``n``): the rows counted by class and bins."""
    return binned(df, features, edges).groupBy(as_double(label).alias("_y"), *_names(features)).agg(F.count(F.lit(1)).alias("n"))


@contextmanager
def _kept_cells(df: DataFrame, features: list[str], label: str, edges: list[np.ndarray]):
    """The cells dealt out by their hash, in order within a partition, so a block that is read again is the same; packed and kept."""
    p, keys = len(features), ["_y", *_names(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def block(number, held):
            y, *codes, n = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([np.array(codes).astype(np.uint8).tobytes()], pa.binary()),
                 pa.array([y.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(float).tobytes()], pa.binary())],
                ["block", "codes", "y", "n"])

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                size += b.num_rows
            if size >= BLOCK_CELLS:
                yield block(number, held)
                number, held, size = number + 1, [], 0
        if size:
            yield block(number, held)

    parts = df.rdd.getNumPartitions()
    cells = cells_of(df, features, label, edges).select(*keys, "n").repartition(parts, *keys).sortWithinPartitions(*keys)
    blocks = cells.mapInArrow(run, "block long, codes binary, y binary, n binary").persist()
    try:
        yield blocks, parts
    finally:
        blocks.unpersist()


def _unpacked(frames, p: int):
    for b in frames:
        for block, codes, y, n in zip(b["block"], b["codes"], b["y"], b["n"]):
            yield int(block), np.frombuffer(codes, np.uint8).reshape(p, -1), np.frombuffer(y, np.int32), np.frombuffer(n, float)


# ---------------------------------------------------------------- trees

class Growing:
    """A tree that is cut node by node; ``stats`` holds a node's weight of each class once it was summed."""

    def __init__(self, path: np.ndarray, classes: int):
        self.feature, self.cut, self.left, self.level, self.path = [-1], [0], [0], [0], [path]
        self.stats, self.open = [np.zeros(classes)], [0]

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int32), np.array(self.stats))

    def split(self, node: int, feature: int, cut: int, stats, open_: bool):
        """Cut ``node``; the children, whose class weights are ``stats``, stay open unless they are at the last level or pure."""
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for path, mine in zip(child_paths(self.path[node]), stats):
            if open_ and np.count_nonzero(mine) > 1:
                self.open.append(len(self.feature))
            for a, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.level, self.level[node] + 1),
                         (self.path, np.array([path])), (self.stats, mine)):
                a.append(v)

    def merged(self) -> Tree:
        """The finished tree, its leaves' class weights as shares; two leaves of the same class become their parent."""
        for node in reversed(range(len(self.feature))):  # children come after their parent
            l = self.left[node]
            if self.feature[node] >= 0 and self.feature[l] < 0 and self.feature[l + 1] < 0 and np.argmax(self.stats[l]) == np.argmax(
                    self.stats[l + 1]):
                self.feature[node] = -1
        tree = self.tree()
        tree.value = tree.value / np.maximum(tree.value.sum(1, keepdims=True), 1e-300)
        return tree


def class_cuts(sums: np.ndarray):
    """``(drawn feature, bin, gain, left weights)`` of the best cut of each node, from (nodes x drawn features x bins x classes) sums.

    The gain is the sum of squares over the weight, of both sides less that of the node, which is the Gini impurity removed; ties go
    to the first feature and the lowest cut. No possible cut: gain 0.
    """
    left = np.cumsum(sums, 2)
    whole = left[:, :1, -1:]
    right = whole - left
    lw, rw, w = left.sum(3), right.sum(3), whole.sum(3)
    with np.errstate(divide="ignore", invalid="ignore"):
        base = (whole ** 2).sum(3) / w
        gain = (left ** 2).sum(3) / lw + (right ** 2).sum(3) / rw - base
    gain = np.where((lw > 0) & (rw > 0) & (gain > 1e-12 * w), gain, 0.0).reshape(len(sums), -1)
    at = (gain >= gain.max(1, keepdims=True) * (1 - TIE)).argmax(1)
    j, c = np.divmod(at, sums.shape[2])
    nodes = np.arange(len(sums))
    return j, c, gain[nodes, at], left[nodes, j, c]


def _grow(blocks: DataFrame, parts: int, growing: list[Growing], p: int, mtry: int, classes: int, depth: int, seed: int):
    most = max(1, SUMS // (mtry * BINS * classes))
    while True:
        batch = [(t, node) for t, g in enumerate(growing) for node in g.open][:most]
        if not batch:
            return
        choice = np.concatenate([drawn(growing[t].path[node], p, mtry) for t, node in batch])
        trees = {t: growing[t].tree() for t, _ in batch}
        slots = {t: np.full(len(tree.feature), -1) for t, tree in trees.items()}
        for i, (t, node) in enumerate(batch):
            slots[t][node] = i

        def partial(frames):
            out = np.zeros((len(batch), mtry, BINS, classes))
            for block, columns, y, n in _unpacked(frames, p):
                flat, cells = columns.ravel(), columns.shape[1]
                for t, tree in trees.items():
                    w = np.random.default_rng([seed, t, block]).poisson(n)
                    slot = slots[t][tree.place_columns(columns)] if len(tree.feature) > 1 else np.full(cells, slots[t][0])
                    at = np.flatnonzero((slot >= 0) & (w > 0))
                    if not at.size:
                        continue
                    first = slots[t][slots[t] >= 0].min()  # a tree's nodes are neighbours in the batch
                    slot, w = slot.take(at) - first, w.take(at)
                    k = int((slots[t] >= 0).sum())
                    for j in range(mtry):
                        code = flat.take(choice[first:first + k, j].take(slot) * cells + at)
                        key = (slot * BINS + code) * classes + y.take(at)
                        out[first:first + k, j] += np.bincount(key, w, k * BINS * classes).reshape(k, BINS, classes)
            yield 0, out

        sums = summed_arrays(blocks, partial, parts)[0]
        for (t, node), mine, chosen, j, c, gain, left in zip(batch, sums, choice, *class_cuts(sums)):
            g = growing[t]
            g.open.remove(node)
            g.stats[node] = mine[0].sum(0)
            if gain > 0 and g.level[node] < depth:
                g.split(node, int(chosen[j]), int(c), (left, g.stats[node] - left), g.level[node] + 1 < depth)


# ---------------------------------------------------------------- forest

@dataclass
class VoteForest:
    features: list
    edges: list
    trees: list  # the value of a node: its share of each class
    classes: int

    def predict_codes(self, columns: np.ndarray) -> np.ndarray:
        """The class of each row, from its bins, a feature after the other."""
        votes = np.zeros((columns.shape[1], self.classes))
        for tree in self.trees:
            votes += tree.value.take(tree.place_columns(columns), 0)
        return votes.argmax(1).astype(float)

    def _scored(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        model = self

        @F.pandas_udf("double")
        def score(codes: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict_codes(np.ascontiguousarray(codes.to_numpy().T.astype(np.uint8))))

        return df.withColumn("_pred", score(F.struct(*_names(self.features))))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``_pred``, the number of the class."""
        return self._scored(binned(df, self.features, self.edges)).drop(*_names(self.features))

    def counted(self, df: DataFrame, label: str) -> DataFrame:
        """(``label``, ``_pred``, ``n``): the rows of ``df`` by class and prediction; rows of equal bins are scored once."""
        return self._scored(cells_of(df, self.features, label, self.edges)).select(F.col("_y").alias(label), "_pred", "n")


def fit_votes(df: DataFrame, features: list[str], label: str, classes: int, trees: int = 100, depth: int = 5, seed: int = 42) -> VoteForest:
    """A forest of ``trees`` trees of at most ``depth`` levels on ``label``, the number of a class from 0; a node draws root of p features."""
    if not features:
        raise ValueError("a forest needs a feature")
    ship_package(df.sparkSession)
    p = len(features)
    mtry = math.ceil(math.sqrt(p))
    edges = class_edges(df, features)
    growing = [Growing(root_path(seed, t), classes) for t in range(trees)]
    with _kept_cells(df, features, label, edges) as (blocks, parts):
        _grow(blocks, parts, growing, p, mtry, classes, depth, seed)
    return VoteForest(list(features), edges, [g.merged() for g in growing], classes)
