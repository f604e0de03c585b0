"""Schema-level operators: column classes, names, projections by type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """A3: names of numeric columns, in table order (booleans are not numeric, as in R)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    """Names of string columns, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that training treats as categories: everything not numeric (text, boolean, dates)."""
    return [f.name for f in df.schema.fields if f.name not in exclude and not is_numeric_type(f.dataType)]


def select_numeric(df: DataFrame) -> DataFrame:
    """Projection onto the numeric columns."""
    return df.select(*[f"`{c}`" for c in numeric_columns(df)])


def select_text(df: DataFrame) -> DataFrame:
    """C4: projection onto the string columns."""
    return df.select(*[f"`{c}`" for c in text_columns(df)])


def column_names(df: DataFrame) -> DataFrame:
    """A2: (position, column_name, data_type), one row per column."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def numeric_column_list(df: DataFrame) -> str:
    """A3 as the reference prints it: comma-joined numeric names."""
    return ", ".join(numeric_columns(df))


_INVALID = re.compile(r"[^0-9A-Za-z_]")


def syntactic_name(name: str) -> str:
    """One name made syntactic: invalid characters become ``_``; a name that does
    not start with a letter gets an ``X`` prefix (dots, used by R, would need
    backticks in Spark SQL, so ``_`` stands in for them)."""
    s = _INVALID.sub("_", name)
    if not s or not s[0].isalpha():
        s = "X" + s
    return s


def unique_names(names: list[str]) -> list[str]:
    """Make names unique by suffixing ``_1``, ``_2``, ... to later repeats."""
    seen: set[str] = set()
    out = []
    for n in names:
        cand, k = n, 0
        while cand.lower() in seen:
            k += 1
            cand = f"{n}_{k}"
        seen.add(cand.lower())
        out.append(cand)
    return out


def normalized_names(names: list[str]) -> list[str]:
    return unique_names([syntactic_name(n) for n in names])


def normalize_names(df: DataFrame) -> DataFrame:
    """Rename all columns to syntactic, unique names (a pure projection)."""
    return df.toDF(*normalized_names(df.columns))
