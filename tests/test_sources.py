import os
import tempfile

import pytest

from tabwise.operators.schema import column_names, normalize_names, numeric_column_list
from tabwise.sources.csv import EmptyTableError, empty_guard, read_table_csv, table_of_lines

FX_CSV = "a,b,c,d\n1,NA,x,TRUE\n?,2.5,,FALSE\n3,,?,NA\n 4,1e3,y,T\n"


def _write(text):
    d = tempfile.mkdtemp(prefix="tabwise-csv-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_fx_csv_types_after_nulling(spark):
    df = read_table_csv(spark, _write(FX_CSV))
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    assert types == {"a": "int", "b": "double", "c": "string", "d": "boolean"}
    rows = df.collect()
    assert [r.a for r in rows] == [1, None, 3, 4]
    assert [r.b for r in rows] == [None, 2.5, None, 1000.0]
    assert [r.c for r in rows] == ["x", None, None, "y"]
    assert [r.d for r in rows] == [True, False, None, True]


def test_empty_csv_rejected(spark):
    with pytest.raises(EmptyTableError):
        read_table_csv(spark, _write("a,b\n"))
    with pytest.raises(EmptyTableError):
        empty_guard(spark.createDataFrame([], "a int"))


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x", 2.0, True)], "a int, s string, d double, b boolean")
    assert numeric_column_list(df) == "a, d"
    assert [tuple(r) for r in column_names(df).collect()][:2] == [(1, "a", "int"), (2, "s", "string")]
    odd = spark.createDataFrame([(1, 2, 3)], "`a b` int, `1x` int, `a_b` int")
    assert normalize_names(odd).columns == ["a_b", "X1x", "a_b_1"]


QUOTED = 'a,b c,a\n1,"he said ""hi"", ok",x\n2,"line\nbreak",NaN\n3,short\n4,wide,y,extra\n'


def test_quotes_breaks_names_and_damaged_rows(spark):
    got = read_table_csv(spark, _write(QUOTED), multi_line=True, report=True)
    assert got.header == ["a", "b c", "a"] and got.table.columns == ["a", "b_c", "a_1"]
    rows = sorted(map(tuple, got.table.collect()))
    assert rows == [(1, 'he said "hi", ok', "x"), (2, "line\nbreak", None), (3, "short", None), (4, "wide", "y")]
    assert got.damaged == 2 and {r["line"] for r in got.damaged_lines.collect()} == {"3,short", "4,wide,y,extra"}


def test_nan_is_null_and_types_hold_beside_a_damaged_row(spark):
    got = read_table_csv(spark, _write("n,v\n1,NaN\n2,1.5\n3\n"), report=True)
    assert [f.dataType.simpleString() for f in got.table.schema.fields] == ["int", "double"]
    assert [r["v"] for r in got.table.orderBy("n").collect()] == [None, 1.5, None] and got.damaged == 1


def test_lines_of_a_frame(spark):
    lines = spark.createDataFrame([('1,"a ""b"", c"',), ("?,NA",), ("3,x,y",)], "value string")
    got = table_of_lines(lines, ["n", "t"], report=True)
    assert sorted(map(tuple, got.table.collect()), key=str) == [(1, 'a "b", c'), (3, "x"), (None, None)] and got.damaged == 1


def _files(texts):
    d = tempfile.mkdtemp(prefix="tabwise-csv-test-")
    for name, text in texts.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    return d


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_records_across_splits_equal_the_whole_read(spark, split):
    """Every place of a split's end: inside a quoted field, at a break, in a record longer than several splits."""
    import random

    rng = random.Random(split)
    files = {}
    for name in ("a.csv", "b.csv"):
        lines = ['id,"no\nte",v']
        for i in range(60):
            text = rng.choice(["plain", "a,b", 'he said ""hi""', "two\nlines", "\n\nmany\r\n\nlines\n", "x" * 40 + "\n" + "y" * 40, ""])
            lines.append(f'{i},"{text}",{rng.choice(["1", "NA", "2.5"])}' + rng.choice(["", "\r"]))
            if i % 9 == 0:
                lines.append(rng.choice(["", "  "]))
        files[name] = "\n".join(lines) + "\n"
    path = _files(files)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        table = read_table_csv(spark, path, multi_line=True, position="at")
        got = [tuple(r) for r in table.orderBy("at").collect()]
        from tabwise.sources.lines import csv_records
        tasks = csv_records(spark, path).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = []
    for name in sorted(files):
        records, text, open_ = [], "", False
        for line in files[name].split("\n"):
            if not open_ and not line.strip():
                continue
            text = text + "\n" + line if open_ else line
            open_ ^= line.count('"') % 2 == 1
            if not open_:
                records.append(_fields(text))
        want += records[1:]
    want = [(int(a), b.strip(" ") if b.strip(" ") else None, None if c == "NA" else float(c), i) for i, (a, b, c) in enumerate(want)]
    assert got == want and table.columns == ["id", "no_te", "v", "at"]
    if split == 7:
        assert tasks > 8


def _fields(text):
    """The fields of one record, quotes doubled."""
    out, field, quoted, i = [], "", False, 0
    text = text[:-1] if text.endswith("\r") else text
    while i < len(text):
        c = text[i]
        if c == '"' and quoted and text[i + 1:i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out, field = [*out, field], ""
        else:
            field += c
        i += 1
    return [*out, field]


def test_open_quote_blank_files_and_headers(spark):
    from tabwise.sources.lines import csv_records

    path = _files({"a.csv": 'n,t\n1,"open\nto the end\n', "b.csv": "n,t\n", "c.csv": "", "d.csv": "n,t\n2,x\n3,y"})
    got = sorted((r["position"], r["text"]) for r in csv_records(spark, path).collect())
    assert got == [(-1, "n,t")] * 3 + [(0, '1,"open\nto the end'), (1, "2,x"), (2, "3,y")]
    with pytest.raises(EmptyTableError):
        read_table_csv(spark, _files({"a.csv": ""}), multi_line=True)
    with pytest.raises(EmptyTableError):
        read_table_csv(spark, _files({"a.csv": "n,t\n"}), multi_line=True)
    with pytest.raises(ValueError):
        read_table_csv(spark, path, multi_line=True, position="N")


def test_parquet_positions(spark):
    from tabwise.sources.lines import parquet_positions

    d = tempfile.mkdtemp(prefix="tabwise-csv-test-")
    spark.range(1000).selectExpr("id * 3 AS v").repartition(4).write.parquet(os.path.join(d, "t"))
    table = parquet_positions(spark, os.path.join(d, "t"))
    assert sorted(r["position"] for r in table.collect()) == list(range(1000))
    again = spark.read.parquet(os.path.join(d, "t")).select("*", "_metadata.file_path", "_metadata.row_index")
    want = [r["v"] for r in again.orderBy("file_path", "row_index").collect()]
    assert [r["v"] for r in table.orderBy("position").collect()] == want


def test_operators_in_file_order(spark):
    from tabwise.operators.clean import drop_rows
    from tabwise.operators.profile import distinct_values
    from tabwise.plans.features import fill_score_row

    table = read_table_csv(spark, _write("n,t\n5,NA\n1,z\n3,b\n1,z\n"), multi_line=True, position="at")
    assert sorted(r["n"] for r in drop_rows(table, "2, 9, 4", position="at").collect()) == [3, 5]
    assert drop_rows(table, "", position="at").columns == ["n", "t"]
    assert [tuple(r) for r in distinct_values(table, "t", position="at").collect()] == [("z", 1), ("b", 2)]
    assert [tuple(r) for r in distinct_values(table, "n", position="at").collect()] == [(5, 0), (1, 1), (3, 2)]
    assert fill_score_row(table, "n", position="at").first().asDict() == {"t": "z"}
    with pytest.raises(ValueError):
        drop_rows(table, "1")
