"""Dense positions in an order, without a single-partition window.

``row_number() OVER (ORDER BY k)`` moves every row into one task. Instead the keys are
range-partitioned, sorted inside each partition and numbered there; the partitions' totals, one row
a partition, are broadcast back as offsets. ``key_positions`` groups equal keys first (with map-side
combine, so a hot value is one row); ``with_positions`` numbers whole rows.

The numbered keys are checkpointed in the shared folder, so the totals and the consumer see the
same rows, an executor can be lost, and nothing stays persisted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def _offsets(numbered: DataFrame, total: Column) -> DataFrame:
    """(_part, _off): rows before each range partition (one row a partition: the broadcast's size bound)."""
    counts = sorted((r["_part"], r["t"]) for r in numbered.groupBy("_part").agg(total.alias("t")).collect())
    offsets, run = [], 0
    for part, n in counts:
        offsets.append((int(part), run))
        run += int(n)
    return F.broadcast(numbered.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _off long"))


def with_positions(df: DataFrame, order_by: list[str | Column], pos_col: str = "_pos") -> DataFrame:
    """``df`` plus ``pos_col``, the 0-based position of each row in the order ``order_by``.

    Rows that tie are told apart by their place in the input, so a key of any frequency spreads over the
    range partitions; which of them comes first may differ between inputs dealt differently.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    keys = [f"_o{i}" for i in range(len(order))] + ["_tie"]
    tagged = cut_lineage(
        df.select("*", *named, F.monotonically_increasing_id().alias("_tie"))
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).drop("_mid"))
    return (tagged.join(_offsets(tagged, F.count(F.lit(1))), "_part")
            .withColumn(pos_col, F.col("_off") + F.col("_idx")).drop("_part", "_idx", "_off"))


def numbered(df: DataFrame, out: str = "_number") -> tuple[DataFrame, int]:
    """``df`` plus ``out``, a dense row number from 0, and the number of rows. No shuffle: each partition counts on from its offset.

    ``df`` must give the same partitions each time it is read, as a persisted, checkpointed or written frame does.
    """
    parts = df.select(F.spark_partition_id().alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("t"))
    rows = sorted((r["_part"], r["t"]) for r in parts.collect())
    offsets, n = [], 0
    for part, t in rows:
        offsets.append((int(part), n))
        n += int(t)
    table = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _off long"))  # one row a partition
    mid = F.monotonically_increasing_id()
    tagged = df.select("*", mid.alias("_mid")).withColumn("_part", F.shiftright("_mid", 33).cast("int"))
    return (tagged.join(table, "_part").withColumn(out, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
            .drop("_part", "_off", "_mid")), n


def key_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``_n`` (rows that have them) and ``_start`` (0-based position of the first such row)."""
    counted = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    cols = [F.col(f"`{c}`") for c in keys]
    ordered = (counted.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()))

    def before(batches):
        import numpy as np
        import pyarrow as pa

        run = 0
        for b in batches:
            n = b.column("_n").to_numpy()
            start = run + np.cumsum(n) - n
            run += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64())], [*b.schema.names, "_before"])

    local = cut_lineage(ordered.mapInArrow(before, T.StructType([*ordered.schema.fields, T.StructField("_before", T.LongType())])))
    return (local.join(_offsets(local, F.sum("_n")), "_part")
            .withColumn("_start", F.col("_off") + F.col("_before")).drop("_part", "_off", "_before"))
