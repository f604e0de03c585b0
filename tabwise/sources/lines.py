"""Records of CSV files in parallel, quoted line breaks included, and row positions in file order.

Spark's multi-line CSV reader takes a file in one task. Here the physical lines are read as text, in splits. A line break ends a record if the
quotes before it, from the start of the file, are even in number (a doubled quote counts twice, so it changes nothing). So one pass counts, for each split, its quotes' parity
and the records that end in it for either parity before it; from these, one row a split, the driver carries the parity and the
record number on from split to split. The next pass gives whole records; the pieces of those that cross splits are read by a third
and put together by record. No record is ever looked for from the start of its file, and no split is held in memory. Lines that are
blank outside quotes are no records; a quote that is never closed makes the rest of its file one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_BREAK = "\n"


def _physical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", _BREAK).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]):
    """((file, start), values) of the stretches of one split, in their order."""
    for b in batches:
        if b.num_rows:
            starts, files = b.column("start").to_numpy(), b.column("file").dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                yield (b.column("file")[int(lo)].as_py(), int(starts[lo])), b.column("value").slice(int(lo), int(hi - lo))


def _quotes(values) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _blank(values) -> np.ndarray:
    return pc.equal(pc.binary_length(pc.utf8_trim_whitespace(values)), 0).to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: its quotes modulo 2, and the records that end in it where the quotes before it are even or odd."""
    def row(split, parity, ends):
        return pa.RecordBatch.from_pylist([{"file": split[0], "start": split[1], "parity": parity, "even": int(ends[0]), "odd": int(ends[1])}],
                                          pa.schema([("file", pa.string()), ("start", pa.int64()), ("parity", pa.int32()),
                                                     ("even", pa.int64()), ("odd", pa.int64())]))

    split, parity, ends = None, 0, [0, 0]
    for at, values in _runs(batches):
        if at != split:
            if split is not None:
                yield row(split, parity, ends)
            split, parity, ends = at, 0, [0, 0]
        after, said = (parity + np.cumsum(_quotes(values))) & 1, ~_blank(values)
        for s in (0, 1):
            ends[s] += (said & (after == s)).sum()
        parity = int(after[-1])
    if split is not None:
        yield row(split, parity, ends)


def _carried(splits) -> dict:
    """{(file, start): (parity before the split, number of the first record that ends in it, its file's first record number)}"""
    out, number, last, parity, first = {}, 0, None, 0, 0
    for r in sorted(splits, key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            number += parity  # a quote left open made the rest of the last file a record
            last, parity, first = r["file"], 0, number
        out[r["file"], r["start"]] = parity, number, first
        number += r["odd" if parity else "even"]
        parity ^= r["parity"]
    return out


def _records(known: dict, pieces: bool):
    """Whole records of each split or (``pieces``) the parts of those that cross its ends."""
    schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("first", pa.int64()), ("start", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(numbers, texts):
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array([split[0]] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array([first] * n, pa.int64()),
                 pa.array([split[1]] * n, pa.int64()), pa.array(texts, pa.string())], schema=schema)

        split, held = None, []
        for at, values in _runs(batches):
            if at != split:
                if held and pieces:
                    yield rows([number], [_BREAK.join(held)])
                if at not in known:
                    raise RuntimeError("the files or their splits changed between two passes; read them again")
                split, held = at, []
                parity, number, first = known[at]
                carried = bool(parity)  # the record that is open has begun in an earlier split
            after = (parity + np.cumsum(_quotes(values))) & 1
            before = np.r_[parity, after[:-1]]
            kept = ~(_blank(values) & (before == 0))
            ends = kept & (after == 0)
            numbers = number + np.cumsum(ends) - ends
            single = ends & (before == 0)
            if not pieces and single.any():
                yield rows(numbers[single], values.filter(pa.array(single)))
            joined = []
            for i in np.flatnonzero(kept & ~single):
                held.append(values[int(i)].as_py())
                if ends[i]:
                    if carried == pieces:
                        joined.append((int(numbers[i]), _BREAK.join(held)))
                    held, carried = [], False
            if joined:
                yield rows(*map(list, zip(*joined)))
            number, parity = number + int(ends.sum()), int(after[-1])
        if held and pieces:
            yield rows([number], [_BREAK.join(held)])

    return run


_RECORD = "file string, number long, first long, start long, text string"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text, position, file) of every record of the CSV files at ``path``, each file's header with position -1.

    ``position`` counts the records below the headers from 0, in the order of the files' names and of the records in them. A
    record's text has its inner line breaks; a carriage return before its last line break is left out.
    """
    ship_package(spark)
    lines = _physical(spark, path)
    splits = lines.mapInArrow(_count, "file string, start long, parity int, even long, odd long").collect()  # one row a split
    known = _carried(splits)
    whole = lines.mapInArrow(_records(known, False), _RECORD)
    crossing = lines.mapInArrow(_records(known, True), _RECORD).groupBy("file", "number", "first").agg(
        F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts")).select(  # the parts of one record
        "file", "number", "first", F.array_join(F.transform("parts", lambda x: x["text"]), _BREAK).alias("text"))
    files = {f: i for i, f in enumerate(sorted({s["file"] for s in splits}))}
    ranks = spark.createDataFrame(list(files.items()) or [("", 0)], "file string, rank int")  # one row a file
    both = whole.select("file", "number", "first", "text").unionByName(crossing)
    place = F.when(F.col("number") == F.col("first"), F.lit(-1).cast("long")).otherwise(F.col("number") - F.col("rank") - 1)
    return both.join(F.broadcast(ranks), "file").select(
        F.regexp_replace("text", r"\r\z", "").alias("text"), place.alias("position"), "file")


def parquet_positions(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """The Parquet table at ``path`` plus ``out``, each row's number from 0 in the order of the files' names and of the rows in them.

    The number is the file's offset plus the row's index in its file, which Parquet's reader knows: no sort and no shuffle.
    """
    table = spark.read.parquet(path)
    if out in table.columns:
        raise ValueError(f"the table has a column {out}")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = table.select(file.alias("f"), row.alias("i")).groupBy("f").agg((F.max("i") + 1).alias("n")).collect()  # one row a file
    offsets, run = [], 0
    for f, n in sorted(tuple(r) for r in sizes):
        offsets.append((f, run))
        run += n
    known = F.broadcast(spark.createDataFrame(offsets or [("", 0)], "_file string, _offset long"))
    rows = table.select(*[F.col(f"`{c}`") for c in table.columns], file.alias("_file"), row.alias("_row"))
    return rows.join(known, "_file").select(*[F.col(f"`{c}`") for c in table.columns], (F.col("_offset") + F.col("_row")).alias(out))
