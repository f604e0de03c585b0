"""Profiling operators.

Every statistic over all columns is one aggregate (one scan, partial
aggregation map-side); per-column results are reshaped with ``stack`` on the
one-row aggregate, never by a per-column loop of jobs. Operators whose exact
answer needs several passes (quantiles) return a small DataFrame built from
per-column numbers computed by Spark jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import as_double, exact_quantiles, missing
from ..functions.stats import correlation_values, stack_rows
from .schema import numeric_columns


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def shape(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """A1: row and column counts before and after cleaning, long format (table, n_rows, n_cols)."""

    def one(df, label):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(label).alias("table"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols")
        )

    return one(original, "original").unionByName(one(cleaned, "cleaned"))


def null_counts(df: DataFrame) -> DataFrame:
    """A4: (column_name, null_count) in one aggregate; NaN counts as null."""
    one = df.agg(*[F.count_if(missing(df, c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return stack_rows(one, [(c, F.col(f"_n{i}")) for i, c in enumerate(df.columns)], "column_name", "null_count")


def null_fraction(df: DataFrame) -> DataFrame:
    """A5: (column_name, null_fraction) = mean of is-null per column, in one aggregate."""
    one = df.agg(
        *[F.avg(missing(df, c).cast("double")).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    )
    return stack_rows(one, [(c, F.col(f"_n{i}")) for i, c in enumerate(df.columns)], "column_name", "null_fraction")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row on all columns (nulls compare equal).

    One shuffle on all columns with map-side partial counts, so a value
    repeated in a third of the rows collapses before the exchange.
    """
    cols = [_q(c) for c in df.columns]
    return (
        df.groupBy(*cols).count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
    )


def quantiles(df: DataFrame, cols: list[str] | None = None, probs=(0.25, 0.5, 0.75), **kw) -> DataFrame:
    """Exact type-7 quantiles, nulls skipped: (column_name, prob, value)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    res = exact_quantiles(df, cols, list(probs), **kw)
    rows = [(c, float(p), res[c]["q"][j]) for c in cols for j, p in enumerate(probs)]
    return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")


def summary(df: DataFrame, **kw) -> DataFrame:
    """One row per column: type, count, nulls; numeric min/q1/median/mean/q3/max;
    boolean true/false counts; string length range."""
    fields = df.schema.fields
    num = numeric_columns(df)
    extra = []
    for i, f in enumerate(fields):
        c = _q(f.name)
        extra += [F.count_if(~missing(df, f.name)).alias(f"_c{i}"), F.count_if(missing(df, f.name)).alias(f"_z{i}")]
        if f.name in num:
            extra.append(F.avg(as_double(f.name)).alias(f"_m{i}"))
        elif f.dataType.simpleString() == "boolean":
            extra += [F.count_if(c).alias(f"_t{i}"), F.count_if(~c).alias(f"_f{i}")]
        elif f.dataType.simpleString() == "string":
            extra += [F.min(F.length(c)).alias(f"_lmin{i}"), F.max(F.length(c)).alias(f"_lmax{i}")]
    res, row = exact_quantiles(df, num, [0.25, 0.5, 0.75], extra=extra, **kw)
    out = []
    for i, f in enumerate(fields):
        r = dict(
            column_name=f.name, data_type=f.dataType.simpleString(), n=row[f"_c{i}"], nulls=row[f"_z{i}"],
            min=None, q1=None, median=None, mean=None, q3=None, max=None,
            n_true=None, n_false=None, min_length=None, max_length=None,
        )
        if f.name in num:
            q = res[f.name]
            r.update(min=q["min"], max=q["max"], q1=q["q"][0], median=q["q"][1], q3=q["q"][2], mean=row[f"_m{i}"])
        elif r["data_type"] == "boolean":
            r.update(n_true=row[f"_t{i}"], n_false=row[f"_f{i}"])
        elif r["data_type"] == "string":
            r.update(min_length=row[f"_lmin{i}"], max_length=row[f"_lmax{i}"])
        out.append(r)
    schema = (
        "column_name string, data_type string, n long, nulls long, min double, q1 double, median double, "
        "mean double, q3 double, max double, n_true long, n_false long, min_length int, max_length int"
    )
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in out], schema)


def distinct_values(df: DataFrame, col: str, sort: bool = True, position: str | None = None) -> DataFrame:
    """Non-null distinct values of ``col``, ascending when ``sort``.

    Where ``position`` names a column with each row's number in file order (``sources/lines.py``): (col, first_seen) in the order
    in which the values are first seen."""
    if position:
        first = df.where(_q(col).isNotNull()).groupBy(_q(col)).agg(F.min(_q(position)).alias("first_seen"))
        return first.orderBy("first_seen") if sort else first
    out = df.select(_q(col)).where(_q(col).isNotNull()).distinct()
    return out.orderBy(_q(col)) if sort else out


def column_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A10: (column_name, mean) with nulls skipped, one aggregate."""
    cols = numeric_columns(df) if cols is None else list(cols)
    one = df.agg(*[F.avg(as_double(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    return stack_rows(one, [(c, F.col(f"_m{i}")) for i, c in enumerate(cols)], "column_name", "mean")


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value; ties go to the smallest value.

    ``groupBy`` counts with map-side combine (a hot value collapses before the
    shuffle); ``min_by`` over (-count, value) is a bounded partial aggregate.
    """
    counts = df.where(_q(col).isNotNull()).groupBy(_q(col).alias("value")).count()
    key = F.struct((-F.col("count")).alias("neg"), F.col("value").alias("v"))
    return counts.agg(
        F.min_by(F.col("value"), key).cast("string").alias("mode"),
        F.max("count").alias("mode_count"),
    ).select(F.lit(col).alias("column_name"), "mode", "mode_count")


def value_counts_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, n): counts of every non-null value of every column.

    All columns go through one ``explode`` of (name, number, text) structs:
    numeric columns are counted as doubles (NaN is missing and -0.0 equals
    0.0, as in R), other columns as text, so no row pays a number-to-text
    cast. The count is partially aggregated before the shuffle on
    (column, value); only the distinct values are formatted as text afterwards.
    """
    cols = df.columns if cols is None else list(cols)
    num = set(numeric_columns(df))
    structs = []
    for c in cols:
        is_num = c in num
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            (as_double(c) if is_num else F.lit(None).cast("double")).alias("x"),
            (F.lit(None).cast("string") if is_num else _q(c).cast("string")).alias("s"),
        ))
    long = df.select(F.explode(F.array(*structs)).alias("kv")).select("kv.column_name", "kv.x", "kv.s")
    counts = long.where(F.col("x").isNotNull() | F.col("s").isNotNull()) \
        .groupBy("column_name", "x", "s").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("column_name", F.coalesce(F.col("s"), F.col("x").cast("string")).alias("value"), "n")


def near_zero_variance(df: DataFrame, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """(column_name, freq_ratio, percent_unique, zero_var, nzv) for every column.

    freq_ratio = top count / second count (0 with fewer than two distinct
    values); percent_unique = 100 * distinct / all rows (null rows included);
    zero_var = at most one distinct value; nzv = (freq_ratio > freq_cut and
    percent_unique <= unique_cut) or zero_var.

    The top count per column is one small aggregate (one row per column,
    broadcast back); the second count is the largest count below it, or the
    top again when the top is tied. No window over a column's values.
    """
    cols = df.columns
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    vc = value_counts_long(df, cols)
    top = vc.groupBy("column_name").agg(F.max("n").alias("top"))
    # at most one row per column: the size bound is the column count
    joined = vc.join(F.broadcast(top), "column_name")
    per = joined.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.first("top").alias("top"),
        F.count_if(F.col("n") == F.col("top")).alias("n_top"),
        F.max(F.when(F.col("n") < F.col("top"), F.col("n"))).alias("second"),
    )
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "column_name string, position int")
    second = F.when(F.col("n_top") >= 2, F.col("top")).otherwise(F.col("second"))
    distinct = F.coalesce(F.col("n_distinct"), F.lit(0))
    freq_ratio = F.when(distinct <= 1, F.lit(0.0)).otherwise(F.col("top").cast("double") / second)
    pct = F.lit(100.0) * distinct / n_rows
    res = (
        F.broadcast(names).join(per, "column_name", "left")
        .select(
            "column_name", "position",
            freq_ratio.alias("freq_ratio"),
            pct.alias("percent_unique"),
            (distinct <= 1).alias("zero_var"),
        )
        .withColumn("nzv", ((F.col("freq_ratio") > freq_cut) & (F.col("percent_unique") <= unique_cut)) | F.col("zero_var"))
    )
    return res.orderBy("position").drop("position")


def correlation_matrix_values(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlations over rows complete in *all* ``cols`` (R use="complete.obs").
    Only p x p numbers reach the driver."""
    return correlation_values(df, cols, complete=True)


def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Full correlation matrix in long form (col_a, col_b, corr), complete rows only;
    a constant column correlates as NULL (its diagonal too)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    vals = correlation_values(df, cols, complete=True)
    rows = [(a, b, vals[(a, b)]) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def find_correlated(matrix: dict[tuple[str, str], float | None], names: list[str], cutoff: float = 0.9,
                    exact: bool = True) -> list[str]:
    """A14 on a p x p matrix (driver side: p^2 numbers, not rows).

    Columns are taken in order of mean absolute correlation, descending. Of each pair above the
    cutoff whose columns both still stand, one goes: the first if its mean correlation with the standing columns
    is larger than the mean over the standing columns without the second's row, else the second.
    ``exact=False``: one pass over the pairs that compares the columns' means over the whole matrix.
    Missing correlations never exceed the cutoff.
    """
    import itertools

    import numpy as np

    size = np.array([[np.nan if matrix.get((a, b)) is None else abs(matrix[(a, b)]) for b in names] for a in names])
    size = size.reshape(len(names), len(names))
    if not exact:
        mean = np.nanmean(size, axis=0) if len(names) else size
        gone = dict.fromkeys(j if mean[j] > mean[i] else i for i, j in itertools.combinations(range(len(names)), 2)
                             if size[i, j] > cutoff)
        return [names[i] for i in gone]
    np.fill_diagonal(size, np.nan)
    here = ~np.isnan(size)
    value = np.where(here, size, 0.0)
    with np.errstate(all="ignore"):
        order = np.argsort(-value.sum(0) / here.sum(0), kind="stable")
    standing = np.ones(len(names))
    for i, j in itertools.combinations(order, 2):
        if not (standing[i] and standing[j] and value[i, j] > cutoff):
            continue
        rest = standing.copy()
        rest[j] = 0  # the rows of the standing columns but the second
        own = value[i] @ standing / (here[i] @ standing)
        others = rest @ value @ standing / (rest @ here @ standing)
        standing[i if own > others else j] = 0
    return [names[k] for k in order if not standing[k]]


def correlated_columns(df: DataFrame, cols: list[str] | None = None, cutoff: float = 0.9, rule: str = "exact") -> list[str]:
    """Names the correlation screen would remove, by the ``exact`` rule or in ``one_pass`` over the pairs (``find_correlated``;
    the rule meant for 100 columns and more)."""
    if rule not in ("exact", "one_pass"):
        raise ValueError("rule must be 'exact' or 'one_pass'")
    cols = numeric_columns(df) if cols is None else list(cols)
    if len(cols) < 2:
        return []
    return find_correlated(correlation_matrix_values(df, cols), cols, cutoff, exact=rule == "exact")


def outlier_fences(df: DataFrame, cols: list[str], k: float = 1.5, **kw) -> dict[str, tuple]:
    """Per column (q1, q3, lower, upper) with lower/upper = q1 -/+ k*IQR."""
    res = exact_quantiles(df, cols, [0.25, 0.75], **kw)
    out = {}
    for c in cols:
        q1, q3 = res[c]["q"]
        if q1 is None:
            out[c] = (None, None, None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def outlier_counts(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, **kw) -> DataFrame:
    """O1: per numeric column the rows outside [q1 - 1.5 IQR, q3 + 1.5 IQR]; nulls not counted.

    Quartiles by exact selection, then one aggregate with the fences as literals.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    fences = outlier_fences(df, cols, k, **kw)
    aggs = []
    for i, c in enumerate(cols):
        _, _, lo, hi = fences[c]
        x = as_double(c)
        aggs.append(F.lit(0).cast("bigint").alias(f"_o{i}") if lo is None
                    else F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"_o{i}"))
    row = df.agg(*aggs).first() if aggs else None
    rows = [(c, *fences[c], row[f"_o{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, q3 double, lower double, upper double, outliers long")


def profile(df: DataFrame, cols: list[str] | None = None, exact_distinct: bool = True, **kw) -> DataFrame:
    """A15 (flagship): one row per numeric column with nulls (NaN counts as null), distinct, min, q1, median,
    mean, q3, max and 1.5-IQR outlier count.

    Passes: (1) one aggregate with counts, nulls, means and the quantile
    sketches; (2) bracket counts; (3) bracket values; (4) exact distinct
    counts from (column, value) pairs, counted map-side first; (5) the outlier count with fences as
    literals. The number of passes does not depend on the number of columns.
    ``exact_distinct=False`` replaces pass (4) by HyperLogLog++ counts inside pass (1) (bounded
    memory, ~1% error).
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    extra = []
    for i, c in enumerate(cols):
        extra += [F.count_if(missing(df, c)).alias(f"_z{i}"), F.avg(as_double(c)).alias(f"_m{i}")]
        if not exact_distinct:
            extra.append(F.approx_count_distinct(as_double(c), 0.01).alias(f"_d{i}"))
    res, row = exact_quantiles(df, cols, [0.25, 0.5, 0.75], extra=extra, **kw)
    if exact_distinct and cols:
        found = {r["column_name"]: r["count"] for r in value_counts_long(df, cols).groupBy("column_name").count().collect()}
        dist = {f"_d{i}": found.get(c, 0) for i, c in enumerate(cols)}
    else:
        dist = row
    aggs = []
    for i, c in enumerate(cols):
        q1, _, q3 = res[c]["q"]
        x = as_double(c)
        if q1 is None:
            aggs.append(F.lit(0).cast("bigint").alias(f"_o{i}"))
        else:
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"_o{i}"))
    outl = df.agg(*aggs).first() if cols else {}
    rows = []
    for i, c in enumerate(cols):
        q = res[c]
        q1, med, q3 = q["q"]
        rows.append((c, row[f"_z{i}"], dist[f"_d{i}"], q["min"], q1, med, row[f"_m{i}"], q3, q["max"], outl[f"_o{i}"]))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, nulls long, n_distinct long, min double, q1 double, median double, "
              "mean double, q3 double, max double, outliers long")
