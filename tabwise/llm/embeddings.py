"""Near-duplicate embeddings by int8 tile products with error bounds (operator 7).

Every vector is scaled to length one and rounded to 8-bit codes: ``u = s * q + r``. The length
of the remainder ``r`` is kept, so the cosine of two vectors differs from ``s * t * (q . p)`` by
``e + f + e * f`` at most (``e`` and ``f`` the lengths of the two remainders). The vectors of a label
are dealt into blocks; a tile is a pair of blocks. A first pass multiplies the codes of each tile and
returns only the rows with a partner that the bound leaves possible. A second pass brings the full
vectors of those rows alone to the tile, and recomputes the possible pairs in double precision.

A tile returns a row's number of links and one link to the smallest row it reaches there, never
the pairs, so a group of copies costs one row a vector and tile.

Defined cases: null, empty and zero vectors, vectors with a null or non-finite component and vectors with
a null label link with nothing; vectors of different lengths do not link; repeated rows are vectors of
their own and link with each other; a null id is passed over when a class is named (null if it has no
other) and is never kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import components, local_roots, written

BLOCK = 2_048  # vectors in a block (about)
_EXACT = 1_024  # dimensions whose code products a float32 sum holds exactly (127 * 127 * 1024 < 2**24)
_SLACK = 1e-9  # more than double rounding can add


def quantise(x: np.ndarray):
    """``(codes, scale, remainder length)`` of finite, non-zero rows."""
    x = x / np.abs(x).max(1, keepdims=True)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None])
    rest = u - scale[:, None] * codes
    return codes.astype(np.int8), scale, np.sqrt((rest * rest).sum(1))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of code rows, by float32 matrix products of parts that cannot round."""
    out = None
    for lo in range(0, q.shape[1], _EXACT):
        part = q[:, lo:lo + _EXACT].astype(np.float32) @ p[:, lo:lo + _EXACT].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def possible_pairs(a, b, threshold: float):
    """Mask of pairs (rows of ``a`` times rows of ``b``) whose cosine may reach the threshold; each is what ``quantise`` gave."""
    (q, s, e), (p, t, f) = a, b
    about = _products(q, p) * s[:, None] * t[None, :]
    return about + (e[:, None] + f[None, :] + e[:, None] * f[None, :] + _SLACK) >= threshold


def _vectors(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _coder(batches):
    names = ["row", "label", "dim", "code", "scale", "error"]
    for b in batches:
        lists = b.column("vector")
        dims = np.array([len(v) if v.is_valid else 0 for v in lists], np.int64)
        for dim in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == dim)
            part = lists.take(pa.array(at))
            flat = part.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null component is NaN
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[good], x[good]
            if not len(at):
                continue
            codes, scale, error = quantise(x)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pick), b.column("label").take(pick), pa.array(np.full(len(at), dim), pa.int32()),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], names)


def _tiles(rows: DataFrame) -> DataFrame:
    """Each row of a block once for every tile that the block is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (rows.select("*", other.alias("other"))
            .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks"))


def _table(batches):
    batches = list(batches)
    return pa.Table.from_batches(batches).combine_chunks()


def _finder(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        dim = t["dim"][0].as_py()
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(-1, dim)
        scale, error, block = (t[c].to_numpy() for c in ("scale", "error", "block"))
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = np.zeros(len(codes), bool)
        for at in range(0, len(a), BLOCK):
            i = a[at:at + BLOCK]
            for to in range(0, len(b), BLOCK):
                j = b[to:to + BLOCK]
                near = possible_pairs((codes[i], scale[i], error[i]), (codes[j], scale[j], error[j]), threshold)
                if lo == hi:
                    near &= i[:, None] != j[None, :]
                found[i] |= near.any(1)
                found[j] |= near.any(0)
        pick = pa.array(np.flatnonzero(found))
        yield from t.select(["row", "label", "dim", "block", "lo", "hi"]).take(pick).combine_chunks().to_batches()

    return run


def _checker(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        rows, block = t["row"].to_numpy(), t["block"].to_numpy()
        order = np.argsort(rows, kind="stable")
        rows, block = rows[order], block[order]
        x = _vectors(t["vector"], t["dim"][0].as_py())[order]
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        codes, scale, error = quantise(x)
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        n_links, roots = np.zeros(len(rows), np.int64), np.arange(len(rows))
        step = 512
        for at in range(0, len(a), step):
            i = a[at:at + step]
            for to in range(0, len(b), step):
                j = b[to:to + step]
                near = possible_pairs((codes[i], scale[i], error[i]), (codes[j], scale[j], error[j]), threshold)
                if lo == hi:
                    near &= i[:, None] < j[None, :]
                k, m = np.nonzero(near)
                for part in range(0, len(k), 1 << 16):
                    left, right = i[k[part:part + (1 << 16)]], j[m[part:part + (1 << 16)]]
                    link = (x[left] * x[right]).sum(1) / (norm[left] * norm[right]) >= threshold
                    left, right = left[link], right[link]
                    n_links += np.bincount(left, minlength=len(rows)) + np.bincount(right, minlength=len(rows))
                    new = roots[left] != roots[right]
                    if new.any():
                        roots = local_roots(len(rows), roots[left[new]], roots[right[new]])[roots]
        some = np.flatnonzero(n_links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[some]), pa.array(n_links[some]), pa.array(rows[roots[some]])], ["row", "n_links", "root"])

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """``(key, n_links, component, kept)`` of every row of ``df``."""
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                             F.col(vector).alias("vector"), F.col(label).cast("string").alias("label")), "vectors")
    codes = rows.where("label IS NOT NULL AND vector IS NOT NULL").select("row", "label", "vector").mapInArrow(
        _coder, "row long, label string, dim int, code binary, scale double, error double")
    codes = written(codes, "codes")
    # tables of their own, here and below, so that a join shuffles both sides anew and AQE can split a frequent label or class
    blocks = written(codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = codes.join(blocks, ["label", "dim"]).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks").cast("long")).cast("int"))
    possible = written(_tiles(dealt).groupBy("label", "dim", "lo", "hi").applyInArrow(
        _finder(threshold), "row long, label string, dim int, block int, lo int, hi int"), "possible")
    found = written(possible.join(rows.select("row", "vector"), "row").groupBy("label", "dim", "lo", "hi").applyInArrow(
        _checker(threshold), "row long, n_links long, root long"), "tile-links")
    counts = found.groupBy("row").agg(F.sum("n_links").alias("n_links"))
    classes = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row")
    named = rows.select("row", "key").join(classes, "row", "left").withColumn("class", F.coalesce("component", "row")).drop("component")
    lowest = written(named.groupBy("class").agg(F.min("key").alias("component")), "lowest")
    return (named.join(lowest, "class").join(counts, "row", "left")
            .select("key", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component",
                    F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept")))
