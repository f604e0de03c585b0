"""Arrays summed over a table: one array a partition and group, merged in two levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

LANES = 32  # merged arrays of a group that reach the driver, at most


def summed_arrays(df: DataFrame, partial, parts: int | None = None) -> dict[int, np.ndarray]:
    """``{group: sum}`` of the arrays that ``partial`` yields as ``(group, array)`` for a partition's pandas batches.

    Each partition hands over one binary row a group; tasks add those of their lane, so the driver adds
    ``LANES`` arrays a group whatever the number of partitions. ``parts`` is that number where the caller knows it: up to ``LANES``
    partitions need no lanes.
    """
    lanes = LANES

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        got = [(int(g), np.ascontiguousarray(a, dtype="<f8")) for g, a in partial(b.to_pandas() for b in batches)]
        lane = TaskContext.get().partitionId() % lanes
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in got], pa.int64()), pa.array([lane] * len(got), pa.int32()),
             pa.array([",".join(map(str, a.shape)) for _, a in got], pa.string()),
             pa.array([a.tobytes() for _, a in got], pa.binary())], ["g", "lane", "shape", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        total, last = None, None
        for b in batches:
            for i in range(b.num_rows):
                a = np.frombuffer(b.column("v")[i].as_py(), "<f8")
                total, last = (a.copy() if total is None else total + a), (b, i)
        b, i = last
        one = b.slice(i, 1)
        yield pa.RecordBatch.from_arrays([one.column("g"), one.column("shape"), pa.array([total.tobytes()], pa.binary())],
                                         ["g", "shape", "v"])

    merge.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = df.mapInArrow(run, "g long, lane int, shape string, v binary")
    if parts is None or parts > lanes:
        rows = rows.groupBy("g", "lane").applyInArrow(merge, "g long, shape string, v binary")
    rows = rows.collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        a = np.frombuffer(bytes(r["v"]), "<f8").reshape([int(x) for x in r["shape"].split(",")])
        out[r["g"]] = out[r["g"]] + a if r["g"] in out else a.copy()
    return out


def summed_rdd(rdd: RDD, partial) -> np.ndarray:
    """Sum of the arrays that ``partial`` makes of each partition's elements; the executors add them up first where there are many."""
    arrays = rdd.mapPartitions(lambda rows: [partial(rows)])
    if arrays.getNumPartitions() <= LANES:
        return sum(arrays.collect())
    return arrays.treeReduce(lambda a, b: a + b)
