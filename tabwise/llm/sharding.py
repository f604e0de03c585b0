"""Sharding by global byte-size prefix sums (operator 1).

Rows are put in one global order (key, size, checksum), every partition of that order reports
its byte and row totals, the totals become offsets, and a row belongs to the shard in which its
first byte lies when all bytes are cut at equal targets. Shards are contiguous in the order and
their sizes differ by one row's size at most around each cut.

Only (key, size, checksum) is ever shuffled; the texts stay where they are. The per-partition
totals (one row a partition) and the shard starts (one row a shard) are what gets broadcast.

Defined cases: a null text has no bytes and counts 1, as an empty one does; a null key sorts
first; repeated keys are ordered by size and checksum, whole repeated rows are interchangeable, and a cut may divide them;
an empty table gives an empty result; other columns are ignored by ``assign_shards`` and kept by
``write_shards``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import written

ORDER = ("key", "size", "crc", "tie")


def _with_prefix(batches):
    """Running bytes and rows before each row of a sorted partition."""
    size_sum = rows = 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        before = size_sum + np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        index = rows + np.arange(len(size), dtype=np.int64)
        size_sum, rows = size_sum + int(size.sum()), rows + len(size)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in (*ORDER, "part")), pa.array(before, pa.int64()), pa.array(index, pa.int64())],
            [*ORDER, "part", "before", "index"])


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, crc, shard, slot)`` of every row of ``df``: size in bytes + 1, slot counted within the shard."""
    return _assign(df, n_shards, key, text, F.monotonically_increasing_id()).drop("tie")


def _row(key: str, text: str, tie: Column) -> list[Column]:
    """What a row is ordered by."""
    return [F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("crc"), tie.alias("tie")]


def _assign(df: DataFrame, n_shards: int, key: str, text: str, tie: Column) -> DataFrame:
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(*_row(key, text, tie))
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    local = written(ordered.mapInArrow(
        _with_prefix, f"key {key_type}, size long, crc long, tie long, part int, before long, index long"), "prefix")

    totals = sorted(local.groupBy("part").agg(F.sum("size"), F.count("*")).collect())  # one row a partition
    offsets, all_bytes, all_rows = [], 0, 0
    for part, size, count in totals:
        offsets.append((part, all_bytes, all_rows))
        all_bytes, all_rows = all_bytes + size, all_rows + count
    spark = df.sparkSession
    offset = spark.createDataFrame(offsets, "part int, part_bytes long, part_rows long")
    # whole numbers throughout: a decimal quotient is rounded to 6 digits before a floor, up to n_shards for the last bytes
    shard = F.expr(f"CAST(part_bytes + before AS decimal(38,0)) * {int(n_shards)} div {max(all_bytes, 1)}")
    placed = local.join(F.broadcast(offset), "part").select(
        *ORDER, shard.cast("int").alias("shard"), (F.col("part_rows") + F.col("index")).alias("rank"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # one row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        *ORDER, "shard", (F.col("rank") - F.col("start")).alias("slot"))


def write_shards(df: DataFrame, n_shards: int, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole rows of ``df`` as Parquet below ``path`` in one folder a shard; returns the assignment.

    The rows are written once with a number of their own, which orders equal ones. The last (key, size, crc, number) of every
    shard is then enough to place a row, so the texts are joined to nothing: each task writes its rows straight into the shard
    folders, exactly as the assignment says.
    """
    number, folder = _free(df, "_number"), _free(df, "_shard")
    rows = written(df.withColumn(number, F.monotonically_increasing_id()), "numbered-rows")
    plan = written(_assign(rows, n_shards, key, text, F.col(number)), "shards")
    cuts = plan.groupBy("shard").agg(F.max(F.struct(*ORDER)).alias("last")).orderBy("shard").collect()  # one row a shard
    row, shard = F.struct(*_row(key, text, F.col(number))), F.lit(n_shards - 1)
    for c in reversed(cuts):
        last = F.struct(*(F.lit(c["last"][f]).cast(plan.schema[f].dataType).alias(f) for f in ORDER))
        shard = F.when(row <= last, F.lit(c["shard"])).otherwise(shard)
    rows.withColumn(folder, shard).drop(number).write.partitionBy(folder).parquet(path)
    return plan.drop("tie")


def _free(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (names differ by more than case)."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
