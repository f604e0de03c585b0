"""Cleaning operators.

Each operator returns a new DataFrame; statistics it needs are computed by
one aggregate over all affected columns and enter the plan as literals, so the
cleaned table stays a lazy projection/filter over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import key_positions
from ..functions.quantiles import as_double, exact_quantiles, missing
from .profile import correlated_columns, near_zero_variance
from .schema import categorical_columns, numeric_columns


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """Drop the named columns that exist; unknown names are ignored."""
    wanted = [c for c in ([cols] if isinstance(cols, str) else cols) if c in df.columns]
    return df.drop(*wanted) if wanted else df


def parse_positions(text) -> list[int]:
    """Comma list of 1-based positions; a fraction is cut off, as a subscript's is, and items that are not finite
    numbers are ignored."""
    out = []
    for item in text.split(",") if isinstance(text, str) else text:
        try:
            out.append(int(float(str(item).strip())))
        except (ValueError, OverflowError):  # no number, or not a finite one
            continue
    return out


def drop_rows(df: DataFrame, positions, order_by: list[str] | None = None, position: str | None = None) -> DataFrame:
    """Drop rows at 1-based ``positions`` of the order ``order_by`` (ties: by a hash of the other columns), or of the file order
    where ``position`` names a column with each row's number from 0 (``sources/lines.py``): a filter, which drops that column.

    Positions outside 1..n are ignored; an empty list keeps every row. Only the order keys are ranked
    (grouped, so a frequent key is one row); the keys at the wanted positions are few, and the table itself is
    filtered by a join on them: no row of it is sorted. Of identical rows as many go as positions fall on them.
    """
    pos = sorted({p for p in parse_positions(positions) if p > 0})
    if (order_by is None) == (position is None):
        raise ValueError("give order_by or position")
    if position:
        return df.where(~_q(position).isin([p - 1 for p in pos])).drop(position) if pos else df.drop(position)
    if not pos:
        return df
    keys = [f"_k{i}" for i in range(len(order_by))] + ["_h"]
    named = [_q(c).alias(k) for c, k in zip(order_by, keys)] + [F.xxhash64(*[_q(c) for c in df.columns]).alias("_h")]
    ranked = key_positions(df.select(*named), keys)
    wanted = F.array(*[F.lit(p - 1).cast("long") for p in pos])  # the user's list
    hit = ranked.withColumn("_drop", F.size(F.filter(wanted, lambda p: (p >= F.col("_start")) & (p < F.col("_start") + F.col("_n"))))) \
        .where("_drop > 0").select(*[F.col(k).alias(f"{k}_") for k in keys], "_n", "_drop")
    tagged = df.select("*", *named)
    same = F.lit(True)
    for k in keys:
        same = same & tagged[k].eqNullSafe(hit[f"{k}_"])
    kept = tagged.join(hit, same, "left_anti").drop(*keys)
    some = tagged.join(hit.where("_drop < _n"), same).dropDuplicates(keys)
    again = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") - F.col("_drop"))))
    return kept.unionByName(again.select(*[_q(c) for c in df.columns]))


def present(df: DataFrame, c: str) -> Column:
    """``c`` is neither null nor NaN, written so that IS NOT NULL reaches the Parquet scan."""
    return _q(c).isNotNull() & ~missing(df, c)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present."""
    return df.where(present(df, target))


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop any row with a null (NaN counts as null) in ``cols`` (default all)."""
    cols = df.columns if cols is None else list(cols)
    cond = F.lit(True)
    for c in cols:
        cond = cond & present(df, c)
    return df.where(cond)


def select_model_columns(df: DataFrame, target: str, predictors: list[str] | None = None,
                         numeric_only: bool = False) -> DataFrame:
    """Target first, then predictors (default: every other column, optionally only numeric)."""
    if predictors is None:
        pool = numeric_columns(df) if numeric_only else df.columns
        predictors = [c for c in pool if c != target]
    return df.select(_q(target), *[_q(c) for c in predictors])


def preview(df: DataFrame, order_by: list[str], page: int = 1, page_size: int = 10,
            search: str | None = None) -> DataFrame:
    """One page of the table view: optional case-insensitive text search over
    all columns, sort by ``order_by``, then offset/limit (a top-k, not a full sort)."""
    out = df
    if search:
        text = F.concat_ws("\u0001", *[_q(c).cast("string") for c in df.columns])
        out = out.where(F.lower(text).contains(search.lower()))
    return out.orderBy(*[_q(c) for c in order_by]).offset((page - 1) * page_size).limit(page_size)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one row per set of identical rows (nulls compare equal)."""
    return df.dropDuplicates()


# ---------------------------------------------------------------- auto clean

def sparse_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns whose fraction of nulls (NaN counts as null) is strictly above ``threshold`` (one aggregate)."""
    if not df.columns:
        return []
    row = df.agg(*[F.avg(missing(df, c).cast("double")).alias(f"_n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"_n{i}"] is not None and row[f"_n{i}"] > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """K1: drop columns with more than ``threshold`` nulls."""
    return drop_columns(df, sparse_columns(df, threshold))


def nzv_columns(df: DataFrame, exclude: tuple[str, ...] = (), unique_cut: float = 10.0) -> list[str]:
    """Names flagged near-zero-variance (A12): one exact (column, value) count, combined map-side."""
    cols = [c for c in df.columns if c not in exclude]
    if not cols:
        return []
    nz = near_zero_variance(df.select(*[_q(c) for c in cols]), unique_cut=unique_cut)
    return [r[0] for r in nz.where(F.col("nzv")).select("column_name").collect()]


def drop_near_zero_variance(df: DataFrame) -> DataFrame:
    """K2: drop near-zero-variance columns, only when more than one column remains."""
    if len(df.columns) <= 1:
        return df
    return drop_columns(df, nzv_columns(df))


def drop_correlated(df: DataFrame, cutoff: float = 0.9, rule: str = "exact") -> DataFrame:
    """K3: drop the correlation screen's choices, only with more than one numeric column."""
    if len(numeric_columns(df)) <= 1:
        return df
    return drop_columns(df, correlated_columns(df, cutoff=cutoff, rule=rule))


def auto_clean(df: DataFrame, threshold: float = 0.5, cutoff: float = 0.9, report: bool = False, rule: str = "exact"):
    """K4: K1 then K2 then K3. Three statistics jobs, then a pure projection.

    With ``report=True`` returns ``(df, {"sparse": [...], "nzv": [...], "correlated": [...]})``.
    """
    dropped = {"sparse": sparse_columns(df, threshold)}
    out = drop_columns(df, dropped["sparse"])
    dropped["nzv"] = nzv_columns(out) if len(out.columns) > 1 else []
    out = drop_columns(out, dropped["nzv"])
    num = numeric_columns(out)
    dropped["correlated"] = correlated_columns(out, num, cutoff, rule) if len(num) > 1 else []
    out = drop_columns(out, dropped["correlated"])
    return (out, dropped) if report else out


# ---------------------------------------------------------------- imputation

def mean_fill_values(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Column means (nulls skipped); an all-null column gets 0."""
    if not cols:
        return {}
    row = df.agg(*[F.avg(as_double(c)).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"_m{i}"] if row[f"_m{i}"] is not None else 0.0) for i, c in enumerate(cols)}


def mode_fill_values(df: DataFrame, cols: list[str], missing: str = "Missing") -> dict[str, str]:
    """Most frequent value per column (ties: smallest); an all-null column gets ``missing``.

    All columns in one shuffle: values are counted per (column, value) with a
    map-side combine, then ``min_by`` picks each column's mode.
    """
    if not cols:
        return {}
    from .profile import value_counts_long

    key = F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))
    rows = value_counts_long(df, cols).groupBy("column_name").agg(F.min_by("value", key).alias("mode")).collect()
    found = {r["column_name"]: r["mode"] for r in rows}
    return {c: found.get(c, missing) for c in cols}


def impute_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """K5: numeric nulls (and NaN) -> column mean; all-null column -> 0. Column types become double."""
    cols = numeric_columns(df) if cols is None else list(cols)
    fills = mean_fill_values(df, cols)
    return df.select(*[
        F.coalesce(as_double(c), F.lit(float(fills[c]))).alias(c) if c in fills else _q(c) for c in df.columns
    ])


def impute_mode(df: DataFrame, cols: list[str] | None = None, missing: str = "Missing") -> DataFrame:
    """K6: non-numeric nulls -> most frequent value; all-null column -> ``missing``. Types become string."""
    cols = categorical_columns(df) if cols is None else list(cols)
    fills = mode_fill_values(df, cols, missing)
    return df.select(*[
        F.coalesce(_q(c).cast("string"), F.lit(fills[c])).alias(c) if c in fills else _q(c) for c in df.columns
    ])


# ---------------------------------------------------------------- outliers

def remove_outliers(df: DataFrame, cols: list[str] | None = None, mode: str = "sequential",
                    k: float = 1.5, **kw) -> DataFrame:
    """O2: keep rows inside [q1 - k IQR, q3 + k IQR] or null, column by column.

    ``sequential`` (the reference's semantics): the quartiles of each column
    are computed on the table already filtered by the columns before it, so
    column order matters; each step is a statistics job whose fences enter the
    plan as literals (the plan stays a chain of filters over the scan).
    ``joint``: all fences from the input, one statistics job, one filter.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    out = df
    if mode == "joint":
        res = exact_quantiles(df, cols, [0.25, 0.75], **kw)
        for c in cols:
            out = _keep_inside(out, c, res[c]["q"], k)
        return out
    if mode != "sequential":
        raise ValueError("mode must be 'sequential' or 'joint'")
    for c in cols:
        res = exact_quantiles(out, [c], [0.25, 0.75], **kw)
        out = _keep_inside(out, c, res[c]["q"], k)
    return out


def _keep_inside(df: DataFrame, c: str, q, k: float) -> DataFrame:
    q1, q3 = q
    if q1 is None:
        return df
    iqr = q3 - q1
    x = as_double(c)
    return df.where(x.isNull() | x.between(F.lit(q1 - k * iqr), F.lit(q3 + k * iqr)))
