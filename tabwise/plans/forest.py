"""Random forest without a depth limit (M4): upper levels by histograms, subtrees handed over to tasks.

Features are cut at quantiles into at most 256 bins and the rows packed into blocks (``trees.py``). Each tree draws its own
weights, Poisson(1) a row (the bootstrap of a large table), from (seed, tree, block), so a block that is read again has the same. A
node with more than ``HAND_OFF`` rows is cut from summed histograms of the features it draws, ``NODES`` nodes of any trees a pass. As soon as a
node is at most that large, its rows are shuffled by (tree, node) and one task grows the rest of that subtree to the end. A node draws its features by a hash of its path, so the tree does not hang on
where a node was cut. Rows of equal bins are one cell of their partition once their weights are drawn: with its weight, mean and sum of squares a cell
grows the tree that its rows would, and is scored once. Where all rows differ, a cell is a row. Trees go as Parquet to the shared folder, one row a subtree; the driver holds the upper levels only. Scoring
reads the subtrees one at a time for each ``SCORE_ROWS`` rows, so neither the forest nor the table is ever whole in a task; the folder must be one
that pyarrow can open on the executors (a mount or a URI it knows).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.counted import groups
from ..functions.partials import summed_arrays
from ..functions.quantiles import as_double
from ..session import ensure_checkpoint_dir, ship_package
from .trees import _packer, bin_edges, codes_of

HAND_OFF = 1 << 20  # rows (or cells of the whole table) of a node that one task grows to the end
NODES = 1 << 12  # nodes that a histogram pass cuts
CELL_ROWS = 1 << 20  # rows of a partition that share their cells
GROUP_ROWS = 1 << 27  # cells times trees that are shuffled in one job (one tree at least)
SCORE_ROWS = 1 << 18
SLOTS = 256
PIECE_ROWS = 1 << 15  # rows of a subtree that are grown together where there are many nodes
PIECES = 16  # nodes of a level before its rows are dealt out
TIE = 1e-9  # gains this close are equal: they differ by the order of their sums
_SUBTREE = "tree int, node int, feature binary, cut binary, left binary, value binary, gain array<double>"


# ---------------------------------------------------------------- draws

def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def root_path(seed: int, tree: int) -> np.ndarray:
    return mixed(mixed(np.array([seed], np.uint64)) ^ np.uint64(tree))


def child_paths(paths: np.ndarray) -> np.ndarray:
    """The paths of the left and right children, side by side."""
    return np.stack([mixed(paths ^ np.uint64(1)), mixed(paths ^ np.uint64(2))], 1).ravel()


def drawn(paths: np.ndarray, p: int, mtry: int) -> np.ndarray:
    """``mtry`` of the features 0..p-1 of each node, ascending."""
    if mtry >= p:
        return np.tile(np.arange(p), (len(paths), 1))
    of, step = mixed(np.arange(1, p + 1)), max(1, (1 << 22) // p)
    parts = [np.argpartition(mixed(paths[i:i + step, None] ^ of), mtry - 1, 1)[:, :mtry] for i in range(0, len(paths), step)]
    return np.sort(np.concatenate(parts), 1) if parts else np.zeros((0, mtry), np.int64)


def weights_of(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(np.uint8)


# ---------------------------------------------------------------- one subtree

@dataclass
class Tree:
    """Nodes in the order they were made; ``feature`` -1: a leaf; the right child follows the left one."""

    feature: np.ndarray
    cut: np.ndarray  # codes up to this one go left
    left: np.ndarray
    value: np.ndarray

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches."""
        return self.place_columns(np.ascontiguousarray(codes.T))

    def place_columns(self, columns: np.ndarray) -> np.ndarray:
        """``place`` of codes that lie a feature after the other."""
        n, flat = columns.shape[1], columns.ravel()
        leaf = self.feature < 0
        # a leaf leads to itself: no code is above its cut
        packed = np.where(leaf, np.arange(len(leaf)), self.left).astype(np.int64) << 24
        packed |= np.where(leaf, 0, self.feature).astype(np.int64) << 8 | np.where(leaf, 255, self.cut).astype(np.int64)
        node, at, rows, step = np.zeros(n, np.int32), np.zeros(n, np.int64), np.arange(n), 0
        while rows.size:
            word = packed.take(at)
            code = flat.take((word >> 8 & 0xFFFF) * n + rows)
            at = (word >> 24) + (code > (word & 255))
            step += 1
            if step % 4 == 0 or len(leaf) < 64:
                inner = np.flatnonzero(~leaf.take(at))
                if inner.size < 0.8 * rows.size:
                    node[rows] = at
                    rows, at = rows.take(inner), at.take(inner)
        return node


def _cells(key: np.ndarray, w: np.ndarray, wr: np.ndarray, size: int):
    """The keys that occur, ascending, with their sums of ``w`` and ``wr``."""
    if size <= 8 * len(key):
        weight = np.bincount(key, w, size)
        keys = np.flatnonzero(weight)
        return keys, weight[keys], np.bincount(key, wr, size)[keys]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(w[order], first), np.add.reduceat(wr[order], first)


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, mtry: int, least: int, path: np.ndarray, depth: int | None = None,
         spread: np.ndarray | None = None):
    """``(tree, gain of each feature)`` of one subtree of rows, or of cells with their mean, weight and sum of squares (``spread``), grown level by level until no node has more than ``least`` rows (repeats
    counted) and a cut that lowers the squared error. Ties go to the first feature and the lowest cut.

    As soon as a level has many nodes, its rows are dealt out by node and pieces of about ``PIECE_ROWS`` rows are grown one after the other,
    so that a piece stays in the processor's cache."""
    p = codes.shape[1]
    made, gains, count = [], np.zeros(p), 1
    widths = codes.max(0, initial=0).astype(np.int64) + 1
    columns = np.ascontiguousarray(codes.T)
    spread = np.zeros(len(y)) if spread is None else spread
    todo = [(columns, np.asarray(y, float), w.astype(float), spread, np.zeros(len(y), np.int64), np.asarray(path, np.uint64), np.zeros(1, np.int64), 0)]
    top = float(np.abs(y).max(initial=0.0))
    while todo:
        columns, y, w, spread, slot, paths, ids, level = todo.pop()
        whole, flat = columns.shape[1], columns.ravel()
        rows = np.arange(whole)
        while len(paths):
            k = len(paths)
            if k >= PIECES and len(rows) > 2 * PIECE_ROWS:  # a piece of several nodes has fewer
                todo += _pieces(columns, rows, y, w, spread, slot, paths, ids, level)
                break
            weight = np.bincount(slot, w, k)
            value = np.bincount(slot, w * y, k) / weight
            rest = y - value.take(slot)
            wr = w * rest
            error = np.bincount(slot, wr * rest + spread, k)
            feature, cut, left = np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.zeros(k, np.int32)
            made.append((ids, feature, cut, left, value))
            open_ = (weight > least) & (error > 1e-24 * weight * top * top)  # below that it is rounding
            if depth is not None and level >= depth:
                open_[:] = False
            nodes = np.flatnonzero(open_)
            if not len(nodes):
                break
            if len(nodes) < k:
                kept = np.flatnonzero(open_.take(slot))
                slot = (np.cumsum(open_) - 1).take(slot.take(kept))
                rows, y, w, wr, spread = rows.take(kept), y.take(kept), w.take(kept), wr.take(kept), spread.take(kept)
                paths, weight, error = paths[nodes], weight[nodes], error[nodes]
            choice, k = drawn(paths, p, mtry), len(nodes)
            best, best_f, best_c = 1e-9 * error, np.full(k, -1), np.zeros(k, np.int64)
            for j in range(choice.shape[1]):
                f = choice[:, j]
                wide = widths[f]
                end = np.cumsum(wide)
                start = end - wide
                key = flat.take((f * whole).take(slot) + rows) + start.take(slot)
                keys, cw, cr = _cells(key, w, wr, int(end[-1]))
                at = np.repeat(np.arange(k), wide).take(keys)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                lw, lr = np.cumsum(cw), np.cumsum(cr)
                lw, lr = lw - (lw[first] - cw[first])[at], lr - (lr[first] - cr[first])[at]
                right = weight[at] - lw
                right[np.r_[first[1:] - 1, len(at) - 1]] = 0.0  # the last cell leaves nothing on the right
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(right > 0, lr * lr * (1 / lw + 1 / right), 0.0)  # the rests of a node add up to 0
                top_gain = np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain >= top_gain[at] * (1 - TIE))[::-1]
                where = np.zeros(k, np.int64)
                where[at[hit]] = hit
                better = top_gain > best * (1 + TIE)
                best = np.where(better, top_gain, best)
                best_f, best_c = np.where(better, f, best_f), np.where(better, keys[where] - start, best_c)
            split = best_f >= 0
            rank = np.cumsum(split) - 1
            mine, fresh = nodes[split], count + np.arange(2 * int(split.sum()))
            feature[mine], cut[mine], left[mine] = best_f[split], best_c[split], fresh[::2]
            np.add.at(gains, best_f[split], best[split])
            if not split.all():
                on = np.flatnonzero(split.take(slot))
                rows, slot, y, w, spread = rows.take(on), slot.take(on), y.take(on), w.take(on), spread.take(on)
            code = flat.take((best_f * whole).take(slot) + rows)
            slot = (2 * rank).take(slot) + (code > best_c.take(slot))
            paths, ids, count, level = child_paths(paths[split]), fresh, count + len(fresh), level + 1
    out = [np.zeros(count, a.dtype) for a in made[0][1:]]
    for ids, *arrays in made:
        for to, a in zip(out, arrays):
            to[ids] = a
    return Tree(*out), gains


def _pieces(columns, rows, y, w, spread, slot, paths, ids, level):
    """The rows dealt out by node, in their order: pieces of neighbouring nodes with about ``PIECE_ROWS`` rows, a large node alone."""
    sizes = np.bincount(slot, minlength=len(paths))
    ends = np.cumsum(sizes)
    order = np.argsort(slot.astype(np.uint16) if len(paths) <= 1 << 16 else slot, kind="stable")
    group, large = (ends - sizes) // PIECE_ROWS, sizes > PIECE_ROWS
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | large[1:] | large[:-1]])
    for a, b in zip(first, [*first[1:], len(paths)]):
        at = order[ends[a] - sizes[a]:ends[b - 1]]
        yield columns.take(rows.take(at), 1), y.take(at), w.take(at), spread.take(at), slot.take(at) - a, paths[a:b], ids[a:b], level


# ---------------------------------------------------------------- upper levels

class Upper:
    """The levels of one tree that are too large for a task; ``handed`` nodes are grown elsewhere."""

    def __init__(self, path: np.ndarray, large: bool):
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [0.0]
        self.path, self.level, self.handed = [path], [0], [not large]
        self.open = [0] if large else []

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int32), np.array(self.value, float))

    def split(self, node: int, feature: int, cut: int, sizes, hand_off: int):
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for path, size in zip(child_paths(self.path[node]), sizes):
            large = size > hand_off
            if large:
                self.open.append(len(self.feature))
            for a, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0), (self.path, np.array([path])),
                         (self.level, self.level[node] + 1), (self.handed, not large)):
                a.append(v)


def _unpacked(frames, p: int):
    for b in frames:
        for block, n, codes, y in zip(b["block"], b["n"], b["codes"], b["y"]):
            yield int(block), int(n), np.frombuffer(codes, np.uint8).reshape(n, p), np.frombuffer(y, float)


def _celled(frames, p: int):
    """(blocks with their numbers of rows, codes, label, first row of each cell, cell of each row) of neighbouring blocks."""
    def joined(held):
        codes, y = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        return [h[:2] for h in held], codes, y, *groups(list(codes.T))

    held, size = [], 0
    for h in _unpacked(frames, p):
        held.append(h)
        size += h[1]
        if size >= CELL_ROWS:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def _cut_upper(blocks, uppers: dict, p, mtry, least, seed, base, gains, hand_off, depth, parts):
    """Cut the nodes above ``hand_off`` rows, ``NODES`` a pass, until there are none."""
    while True:
        batch = [(t, node) for t, up in uppers.items() for node in up.open][:NODES]
        if not batch:
            return
        trees = {t: uppers[t].tree() for t, _ in batch}
        choice = {b: drawn(uppers[b[0]].path[b[1]], p, mtry)[0] for b in batch}

        def partial(frames):
            out = np.zeros((len(batch), mtry, SLOTS, 2))
            for block, n, codes, y in _unpacked(frames, p):
                last = None
                for i, (t, node) in enumerate(batch):
                    if t != last:
                        w, place, last = weights_of(seed, t, block, n), trees[t].place(codes), t
                    at = np.flatnonzero((place == node) & (w > 0))
                    for j, f in enumerate(choice[t, node]):
                        out[i, j, :, 0] += np.bincount(codes[at, f], w[at], SLOTS)
                        out[i, j, :, 1] += np.bincount(codes[at, f], w[at] * (y[at] - base), SLOTS)
            yield 0, out

        sums = summed_arrays(blocks, partial, parts)[0]
        for (t, node), cells in zip(batch, sums):
            up = uppers[t]
            up.open.remove(node)
            w, s = np.cumsum(cells[..., 0], 1), np.cumsum(cells[..., 1], 1)
            all_w, all_s = w[0, -1], s[0, -1]
            up.value[node] = base + all_s / all_w if all_w else base
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s ** 2 / w + (all_s - s) ** 2 / (all_w - w) - all_s ** 2 / all_w
            gain = np.where((w > 0) & (w < all_w), gain, 0.0)
            j, c = np.unravel_index(np.flatnonzero(gain >= gain.max() * (1 - TIE))[0], gain.shape)
            if all_w > least and (depth is None or up.level[node] < depth) and gain[j, c] > 1e-9 * max(all_s ** 2 / all_w, 1e-300):
                f = int(choice[t, node][j])
                gains[f] += gain[j, c]
                up.split(node, f, int(c), (w[j, c], all_w - w[j, c]), hand_off)


# ---------------------------------------------------------------- forest

@dataclass
class Forest:
    features: list
    edges: list
    uppers: list  # (tree, which nodes are handed over)
    files: list
    gain: np.ndarray

    def predict_codes(self, codes: np.ndarray) -> np.ndarray:
        """Mean of the trees, read one subtree at a time."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        total, columns = np.zeros(len(codes)), np.ascontiguousarray(codes.T)
        for tree, handed in self.uppers:
            if len(handed) > 1 or not handed[0]:
                place = tree.place_columns(columns)
                total += np.where(handed[place], 0.0, tree.value[place])
        for uri in self.files:
            system, path = fs.FileSystem.from_uri(uri)
            last, place = None, None
            with system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=4):
                    for row in batch.to_pylist():
                        sub = Tree(np.frombuffer(row["feature"], np.int16), np.frombuffer(row["cut"], np.uint8),
                                   np.frombuffer(row["left"], np.int32), np.frombuffer(row["value"], float))
                        if len(self.uppers[row["tree"]][1]) == 1:
                            for i in range(0, len(codes), PIECE_ROWS):  # as many rows as stay in the cache
                                total[i:i + PIECE_ROWS] += sub.value.take(sub.place_columns(columns[:, i:i + PIECE_ROWS]))
                            continue
                        if row["tree"] != last:
                            last, place = row["tree"], self.uppers[row["tree"]][0].place_columns(columns)
                        at = np.flatnonzero(place == row["node"])
                        total[at] += sub.value.take(sub.place_columns(columns.take(at, 1)))
        return total / len(self.uppers)

    def score(self, df: DataFrame, keep: list[str], out_col: str) -> DataFrame:
        """``keep`` of ``df`` and the prediction ``out_col``, in one pass without a shuffle."""
        ship_package(df.sparkSession)
        model, n, n_features = self, len(keep), len(self.features)
        kept = T.StructType([*[df.schema[c] for c in keep], T.StructField(out_col, T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(held):
                x = np.concatenate([np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[n:]], 1) for b in held])
                codes, at = codes_of(x, model.edges), 0
                first, group = groups(list(codes.T)) if n_features else (np.zeros(1, int), np.zeros(len(x), int))
                got = model.predict_codes(codes[first]).take(group)
                for b in held:
                    yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got[at:at + b.num_rows])], kept.names)
                    at += b.num_rows

            held, size = [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    size += b.num_rows
                if size >= SCORE_ROWS:
                    yield from done(held)
                    held, size = [], 0
            if held:
                yield from done(held)

        rows = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                         *[as_double(f).alias(f"_x{i}") for i, f in enumerate(self.features)])
        return rows.mapInArrow(run, kept)


@contextmanager
def _kept_blocks(prepared: DataFrame, features, label):
    edges = bin_edges(prepared, features)
    rows = prepared.select(*[as_double(f).alias(f"_x{i}") for i, f in enumerate(features)], as_double(label).alias("_y"))
    rows = rows.na.drop("any")
    blocks = rows.mapInArrow(_packer(edges, 0), "block long, n long, codes binary, y binary, folds binary").drop("folds").persist()
    try:
        yield blocks, edges
    finally:
        blocks.unpersist()


def fit_forest(prepared: DataFrame, features: list[str], label: str, trees: int, mtry: int, least: int = 5, seed: int = 42,
               depth: int | None = None, hand_off: int | None = None) -> Forest:
    """A regression forest of ``trees`` trees, ``mtry`` features a node; ``depth`` None: no limit."""
    spark = prepared.sparkSession
    ship_package(spark)
    p, mtry, hand_off = len(features), min(mtry, len(features)), hand_off or HAND_OFF
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    with _kept_blocks(prepared, features, label) as (blocks, edges):
        def size(frames):
            out = np.zeros(3)
            for _, codes, y, first, _ in _celled(frames, p):
                out += len(codes), y.sum(), len(first)
            yield 0, out

        rows, total, cells = summed_arrays(blocks, size)[0]
        if not rows:
            raise ValueError("no rows to train on")
        parts, gains = blocks.rdd.getNumPartitions(), np.zeros(p)
        step, done = max(1, int(GROUP_ROWS // cells)), []
        for start in range(0, trees, step):
            uppers = {t: Upper(root_path(seed, t), cells > hand_off) for t in range(start, min(start + step, trees))}
            _cut_upper(blocks, uppers, p, mtry, least, seed, total / rows, gains, hand_off, depth, parts)
            _hand_over(blocks, uppers, p, mtry, least, seed, depth).write.mode("append").parquet(path)
            done += [(up.tree(), np.array(up.handed)) for up in uppers.values()]
    table = spark.read.schema(_SUBTREE).parquet(path)
    there = {r["tree"] for r in table.select("tree").distinct().collect()}  # one row a tree
    for t in set(range(trees)) - there:  # a tree that drew no row, or whose upper levels have it all
        tree, handed = done[t]
        tree.value[handed], handed[:] = total / rows, False
    lower = table.agg(*[F.sum(F.col("gain")[i]) for i in range(p)]).first()
    return Forest(list(features), edges, done, sorted(table.inputFiles()), gains + np.array([g or 0.0 for g in lower]))


def _hand_over(blocks: DataFrame, uppers: dict, p, mtry, least, seed, depth) -> DataFrame:
    """The subtrees below the handed nodes: their rows shuffled by (tree, node), each grown in one task."""
    made = {t: (up.tree(), np.flatnonzero(up.handed)) for t, up in uppers.items()}
    paths = {(t, int(j)): (int(up.path[j][0]), up.level[j]) for t, up in uppers.items() for j in made[t][1]}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for draws, codes, y, first, cell in _celled((b.to_pandas() for b in batches), p):
            codes, size = codes[first], len(first)
            for t, (tree, handed) in made.items():
                drawn_ = np.concatenate([weights_of(seed, t, block, n) for block, n in draws])
                w, spread = np.bincount(cell, drawn_, size), np.zeros(size)
                mean = np.bincount(cell, drawn_ * y, size) / np.maximum(w, 1.0)
                if size < len(cell):
                    rest = y - mean.take(cell)
                    spread = np.bincount(cell, drawn_ * rest * rest, size)
                place = tree.place(codes) if len(tree.feature) > 1 else np.zeros(size, np.int32)
                for j in handed:
                    at = np.flatnonzero((place == j) & (w > 0))
                    if at.size:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t], pa.int32()), pa.array([j], pa.int32()), pa.array([draws[0][0]], pa.int64()),
                             *[pa.array([a[at].tobytes()], pa.binary()) for a in (codes, mean, w.astype(np.uint32), spread)]],
                            ["tree", "node", "block", "codes", "y", "w", "spread"])

    def grown(table: pa.Table) -> pa.Table:
        key = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        table = table.sort_by("block")  # so the sums do not hang on the order of the shuffle
        joined = {c: b"".join(v.as_py() for v in table.column(c)) for c in ("codes", "y", "w", "spread")}
        path, level = paths[key]
        codes, y, w = np.frombuffer(joined["codes"], np.uint8).reshape(-1, p), np.frombuffer(joined["y"], float), np.frombuffer(joined["w"], np.uint32)
        spread = np.frombuffer(joined["spread"], float)
        first, cell = groups(list(codes.T))
        if len(first) < len(codes):  # the cells of all partitions
            weight = np.bincount(cell, w)
            mean = np.bincount(cell, w * y) / weight
            rest = y - mean.take(cell)
            codes, y, w, spread = codes[first], mean, weight, np.bincount(cell, spread + w * rest * rest)
        tree, gain = grow(codes, y, w, mtry, least, np.array([path], np.uint64), None if depth is None else depth - level, spread)
        return pa.table([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                         *[pa.array([a.tobytes()], pa.binary()) for a in (tree.feature, tree.cut, tree.left, tree.value)],
                         pa.array([gain.tolist()], pa.list_(pa.float64()))],
                        names=["tree", "node", "feature", "cut", "left", "value", "gain"])

    rows = blocks.mapInArrow(pieces, "tree int, node int, block long, codes binary, y binary, w binary, spread binary")
    # growing is the work, not the bytes: a fixed number of partitions is not merged by AQE
    return rows.repartition(max(1, min(len(paths), 2000)), "tree", "node").groupBy("tree", "node").applyInArrow(grown, _SUBTREE)
