"""CSV ingest (S1) and the empty-table guard (S3).

Every field is read as text; the null tokens become NULL;
then one aggregate decides each column's type from the smallest and largest
per-value type code (int, bigint, double, logical, text), and a projection
casts. Types are thus inferred *after* nulling, which
Spark's single-token ``nullValue`` cannot do. A doubled quote inside a quoted field is a quote; with
``multi_line`` a quoted field may hold line breaks. Rows with more or fewer fields than the header are kept
as far as the header goes (missing fields are NULL), and reported with their lines.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import normalized_names
from .lines import csv_records

# The null tokens and the logical spellings the reference's reader accepts.
NULL_TOKENS = ("", "NA", "?")
TRUE_WORDS = ("TRUE", "true", "True", "T")
FALSE_WORDS = ("FALSE", "false", "False", "F")
INT_PATTERN = r"^[+-]?[0-9]+$"
NUMBER_PATTERN = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|Inf|inf|NaN)$"


NAN_WORDS = ("NaN",)


class EmptyTableError(ValueError):
    pass


@dataclass
class CsvRead:
    """A typed table, and which lines did not fit its header."""

    table: DataFrame
    header: list  # as written; ``table`` has syntactic, unique names
    damaged: int
    damaged_lines: DataFrame


def empty_guard(df: DataFrame) -> DataFrame:
    """S3: error when the table has no columns or no rows (``isEmpty`` reads one row at most)."""
    if not df.columns or df.isEmpty():
        raise EmptyTableError("the table has no rows")
    return df


def read_table_csv(spark: SparkSession, path: str, na=NULL_TOKENS, trim: bool = True, guard: bool = True,
                   multi_line: bool = False, report: bool = False, position: str | None = None):
    """Header CSV, several null tokens, types inferred after nulling, names made syntactic and unique.

    With ``report`` returns a ``CsvRead`` with the counts of rows that do not fit the header. ``multi_line`` lets a
    quoted field span lines; a file is still read in as many tasks as it has splits (``lines.py``). ``position`` (with
    ``multi_line``) names a column with each row's number in file order."""
    if multi_line:
        return _read_records(spark, path, na, trim, guard, report, position)
    if position:
        raise ValueError("positions need multi_line=True")
    reader = spark.read.option("inferSchema", False).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    head = reader.option("header", False).csv(path).limit(1).collect()
    if not head:
        raise EmptyTableError("the file is empty")
    header = [v if v is not None else "" for v in head[0]]
    p = len(header)
    raw = reader.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad") \
        .schema(_text_schema(p)).csv(path)
    return typed_table(raw, header, na, trim, guard, report)


def _read_records(spark, path, na, trim, guard, report, position):
    records = csv_records(spark, path)
    head = records.where("position = -1").orderBy("file").limit(1).collect()
    if not head:
        raise EmptyTableError("the file is empty")
    header = next(csv.reader([head[0]["text"]]))
    return table_of_lines(records.where("position >= 0").select("text", "position"), header, na, trim, guard, report, position)


def _text_schema(p: int) -> str:
    return ", ".join(f"_f{i} string" for i in range(p)) + ", _bad string"


def table_of_lines(lines: DataFrame, header: list, na=NULL_TOKENS, trim: bool = True, guard: bool = True, report: bool = False,
                   position: str | None = None):
    """S1 on CSV lines in the first column of a DataFrame (no header line; a quoted field may hold line breaks). ``position``:
    a name for the second column, which is then kept as the last one."""
    fields = F.from_csv(F.col(f"`{lines.columns[0]}`"), _text_schema(len(header)), {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": "true"})
    place = [F.col(f"`{lines.columns[1]}`").alias("_place")] if position else []
    raw = lines.select(fields.alias("f"), *place).select("f.*", *(["_place"] if position else []))
    return typed_table(raw, header, na, trim, guard, report, position)


def typed_table(raw: DataFrame, header: list, na, trim: bool, guard: bool, report: bool, position: str | None = None):
    """The typed table of text fields ``_f0``, ``_f1``, ... whose damaged lines are in ``_bad``."""
    cols = normalized_names([h.strip() if trim else h for h in header])
    if position and position.lower() in [c.lower() for c in cols]:
        raise ValueError(f"the file has a column {position}")
    place = [F.col("_place").alias(position)] if position else []

    def cleaned(i):
        v = F.trim(F.col(f"_f{i}")) if trim else F.col(f"_f{i}")
        return F.when(v.isin(*na, *NAN_WORDS), F.lit(None)).otherwise(v)

    text = raw.select(*[cleaned(i).alias(c) for i, c in enumerate(cols)], *place)
    with_bad = raw.select(*[cleaned(i).alias(c) for i, c in enumerate(cols)], "_bad")
    # one type code per value: 0 int, 1 bigint, 2 double, 3 logical, 4 text. The
    # patterns gate the casts, so no value reaches a failing number parse.
    aggs = [F.count(F.lit(1)).alias("rows"), F.count("_bad").alias("bad")]
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        integral = v.rlike(INT_PATTERN)
        code = (
            F.when(v.isNull(), F.lit(None))
            .when(integral & F.expr(f"try_cast(`{c}` AS INT)").isNotNull(), F.lit(0))
            .when(integral & F.expr(f"try_cast(`{c}` AS BIGINT)").isNotNull(), F.lit(1))
            .when(v.rlike(NUMBER_PATTERN), F.lit(2))
            .when(v.isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(3))
            .otherwise(F.lit(4))
        )
        aggs += [F.min(code).alias(f"lo{i}"), F.max(code).alias(f"hi{i}")]
    r = with_bad.agg(*aggs).first()
    if guard and not r["rows"]:
        raise EmptyTableError("the file has no rows below its header")
    out = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if hi is None:
            out.append(F.lit(None).cast("boolean").alias(c))  # an all-NA column reads as logical
        elif hi <= 2:
            out.append(F.expr(f"try_cast(`{c}` AS {('INT', 'BIGINT', 'DOUBLE')[hi]})").alias(c))
        elif lo == hi == 3:
            out.append(F.when(v.isin(*TRUE_WORDS), F.lit(True)).when(v.isin(*FALSE_WORDS), F.lit(False)).alias(c))
        else:
            out.append(v.alias(c))
    table = text.select(*out, *([F.col(f"`{position}`")] if position else []))
    if not report:
        return table
    # the first field is read beside the line: Spark refuses to read the corrupt record's column alone
    lines = with_bad.where(F.col("_bad").isNotNull()).select(F.col("_bad").alias("line"), F.col(f"`{cols[0]}`").alias("first_field"))
    return CsvRead(table, list(header), r["bad"], lines)
