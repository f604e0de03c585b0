"""Shared pieces of the operators: work tables in the shared folder, files in it, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new, not yet existing folder below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabwise-{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session (they may not have it installed).

    The archive is the driver's own file; Spark serves it to the executors as any ``--py-files`` entry.
    """
    import tabwise

    sc = spark.sparkContext
    if getattr(sc, "_tabwise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(tabwise.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tabwise-code-"), "tabwise_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tabwise", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tabwise_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(rows: DataFrame, share: Column, name: str) -> DataFrame:
    """``rows`` thinned to ``share`` (of 2**30) each, plus ``row``, a number of its own; the caller's shares bound the sample.

    A row is drawn by a checksum of its values and of its number among the rows equal to it, so the sample is the
    same however the rows lie, and no frequent row stands or falls with all its copies.
    """
    values = F.xxhash64(*rows.columns)
    counted = rows.select(values.alias("h"), share.alias("share")).groupBy("h", "share").agg(F.count("*").alias("n"))
    copies = counted.select("h", "share", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    chosen = copies.where(F.pmod(F.xxhash64("h", "copy"), F.lit(1 << 30)) < F.col("share")).groupBy("h").agg(F.count("*").alias("copies"))
    chosen = written(chosen, f"{name}-chosen")
    one = rows.withColumn("h", values).join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    return written(one.select("*", copy).select(*rows.columns, F.xxhash64("h", "copy").alias("row")), name)


def _file_system(uri: str):
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = _file_system(uri)
    if store is None:
        os.makedirs(path, exist_ok=True)
    else:
        store.create_dir(path, recursive=True)


def open_to_read(uri: str):
    """Seekable binary file of the shared folder, local mount or remote store."""
    store, path = _file_system(uri)
    return open(path, "rb") if store is None else store.open_input_file(path)


def open_to_write(uri: str):
    store, path = _file_system(uri)
    return open(path, "wb") if store is None else store.open_output_stream(path)


def mapped(uri: str, dtype, count: int) -> np.ndarray:
    """A file of the shared folder as a read-only array: memory-mapped where the folder is mounted.

    On a store without a mount the file is read whole.
    """
    if count == 0:
        return np.empty(0, dtype)
    store, path = _file_system(uri)
    if store is None:
        return np.memmap(path, dtype=dtype, mode="r", shape=(count,))
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20):
    """Cut a batch into row slices of about ``most_bytes`` of text (one row at least).

    Yields ``(first_row, n_rows, data, offsets)``: the UTF-8 bytes of the slice and its n + 1
    row offsets into them. Null texts are empty.
    """
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return
    wide = pa.types.is_large_string(col.type)
    _, raw, data = col.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        end = min(max(end, first + 1), n)
        lo, hi = offsets[first], offsets[end]
        yield first, end - first, data[lo:hi], offsets[first:end + 1] - lo
        first = end


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list ``(a, b)`` of longs: ``(node, component)``, component = smallest node.

    Alternating large-star and small-star steps (each a map-side combined minimum and a join that
    AQE may split at a hot node); every step is a written table, so a lost executor costs one step.
    Nodes without an edge do not appear; loops, nulls, repeated and reversed edges are harmless.
    """
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = written(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        e = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _mark(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``left[i] - right[i]`` (in memory)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = np.minimum(new, new[new])
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new
