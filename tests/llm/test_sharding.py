import zlib

import pytest
from pyspark.sql import functions as F

from tabwise.llm import sharding
from tabwise.llm.sharding import assign_shards, write_shards


def brute(rows, n):
    made = []
    for key, text in rows:
        data = (text or "").encode()
        made.append((key is not None, key or 0, len(data) + 1, zlib.crc32(data)))
    made.sort()
    total, before, out, slots = sum(m[2] for m in made), 0, [], {}
    for some, key, size, crc in made:
        shard = before * n // total
        out.append((key if some else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def check(spark, rows, n):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, shard string").repartition(5)
    got = sorted(map(tuple, assign_shards(df, n).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[4]))
    assert sorted(got, key=str) == sorted(brute(rows, n), key=str)


def test_against_brute_force(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(spark, rows, 8)
    check(spark, rows, 3)


def test_sizes_are_near_equal_and_contiguous(spark, documents):
    got = assign_shards(documents, 8).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes, longest = [sum(r["size"] for r in x) for x in by.values()], max(r["size"] for r in got)
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) <= 2 * longest
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    ends = [(min(r["key"] for r in by[s]), max(r["key"] for r in by[s])) for s in range(8)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_defined_cases(spark):
    rows = [(None, None), (None, ""), (1, "é" * 300), (1, "é" * 300), (1, "é" * 300), (2, None), (2, "b")]
    check(spark, rows, 4)
    check(spark, rows * 3, 2)
    check(spark, [(5, "only")], 8)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert assign_shards(empty, 8).collect() == []


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    rows = documents.withColumnRenamed("source", "_shard")
    plan = write_shards(rows, 4, path).groupBy("shard").count().orderBy("shard").collect()
    back = spark.read.parquet(path)
    name = (set(back.columns) - set(rows.columns)).pop()
    assert [(r["shard"], r["count"]) for r in plan] == [tuple(r) for r in back.groupBy(name).count().orderBy(name).collect()]
    assert back.count() == documents.count()


def test_equal_rows_are_written_as_the_plan_says(spark, tmp_path):
    rows = spark.range(1_000).selectExpr("7L AS doc_id", "'same text' AS text", "id % 3 AS _SHARD").repartition(5)
    path = str(tmp_path / "equal")
    plan = write_shards(rows, 4, path)
    assert sorted((r["shard"], r["count"]) for r in plan.groupBy("shard").count().collect()) == [(i, 250) for i in range(4)]
    back = spark.read.parquet(path)
    name = next(c for c in back.columns if c not in rows.columns)
    assert sorted((r[name], r["count"]) for r in back.groupBy(name).count().collect()) == [(i, 250) for i in range(4)]
    assert sorted(r["_SHARD"] for r in back.select("_SHARD").collect()) == sorted(i % 3 for i in range(1_000))


@pytest.mark.parametrize("first, last", [(30_000_000_000, 1_500), (500_000_000, 20), (10**15, 60_000_000), (9 * 10**17, 3)])
def test_last_bytes_of_a_large_table_stay_in_the_last_shard(spark, monkeypatch, first, last):
    """Each row as a partition of its own, the first of them as large as a table."""
    def large(df, name):
        df = df.withColumn("part", F.col("key").cast("int")).withColumn("before", F.lit(0).cast("long"))
        return df.withColumn("index", F.lit(0).cast("long")).withColumn(
            "size", F.when(F.col("key") == 0, F.lit(first - 3)).when(F.col("key") == 1, F.lit(3)).otherwise(F.lit(last)).cast("long"))

    monkeypatch.setattr(sharding, "written", large)
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    for n in (1, 3, 8, 1000):
        got = {r["key"]: r["shard"] for r in assign_shards(rows, n).collect()}
        total = first + last
        assert got == {0: 0, 1: (first - 3) * n // total, 2: first * n // total} and max(got.values()) < n
