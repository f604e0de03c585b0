"""Feature preparation.

``preprocess`` fits a ``Preprocessor``: fill values, category levels, the
kept feature list and scaling constants. Applying it is a single projection
of column expressions (coalesce, CASE per level, (x - mean) / sd), so scoring
stays inside whole-stage codegen and works on batch or streaming frames alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import as_double
from ..operators.clean import nzv_columns
from ..operators.profile import find_correlated, value_counts_long
from ..operators.schema import is_numeric_type, normalized_names
from .gram import gram_by_group


class PreprocessError(ValueError):
    """A table that cannot be prepared; ``code`` says why."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def validate_target(df: DataFrame, target: str) -> list[str]:
    """F4 (schema part): target exists, is numeric and has predictors. Returns the predictors."""
    if target not in df.columns:
        raise PreprocessError("no_target", f"the table has no column {target}")
    if not is_numeric_type(df.schema[target].dataType):
        raise PreprocessError("text_target", f"{target} is not numeric")
    predictors = [c for c in df.columns if c != target]
    if not predictors:
        raise PreprocessError("no_predictors", "the target is the only column")
    return predictors


@dataclass
class Preprocessor:
    target: str
    numeric: list[str]
    categorical: list[str]
    fills: dict
    levels: dict
    dummy_names: dict  # (column, level) -> feature name
    features: list[str]  # kept feature names, training order
    means: dict = field(default_factory=dict)
    sds: dict = field(default_factory=dict)
    dropped: dict = field(default_factory=dict)

    numeric_names: dict = field(default_factory=dict)

    def feature_exprs(self, scaled: bool = True) -> list[Column]:
        raw = {}
        for c in self.numeric:
            raw[self.numeric_names[c]] = F.coalesce(as_double(c), F.lit(float(self.fills[c])))
        for c in self.categorical:
            v = F.coalesce(_q(c).cast("string"), F.lit(self.fills[c]))
            for lvl in self.levels[c]:
                raw[self.dummy_names[(c, lvl)]] = F.when(v == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0))
        out = []
        for name in self.features:
            e = raw[name]
            if scaled:
                sd = self.sds.get(name) or 1.0
                e = (e - F.lit(float(self.means[name]))) / F.lit(float(sd))
                # a value that is still missing after scaling sits at the mean (0)
                e = F.coalesce(e, F.lit(0.0))
            out.append(e.alias(name))
        return out

    def transform(self, df: DataFrame, keep_target: bool = True, keep: list[str] | None = None) -> DataFrame:
        """Apply the fitted preparation; missing input columns are treated as null."""
        missing = [c for c in self.numeric + self.categorical if c not in df.columns]
        if missing:
            df = df.select("*", *[F.lit(None).alias(c) for c in missing])
        head = [_q(c) for c in (keep or [])]
        if keep_target and self.target in df.columns:
            head = [as_double(self.target).alias(self.target)] + head
        return df.select(*head, *self.feature_exprs())


MOST_LEVELS = 10_000  # levels that may become a column each


def fit_fill_values(df: DataFrame, numeric: list[str], categorical: list[str], missing: str = "Missing",
                    all_levels: bool = True):
    """(rows, fills, levels): means (0 for an all-null column), modes ("Missing" for an all-null column) and category
    levels; one aggregate plus one (column, value) count shuffle.

    Without ``all_levels`` only levels whose 0/1 column is not near-zero-variance (A12) leave Spark. Of n >= 20
    rows that needs a count of n / 20 (nulls count for the mode, which fills them), so at most 20 levels
    of a column come back whatever it holds; a table of fewer rows has fewer levels than that. With it, more than
    ``MOST_LEVELS`` levels are an error.
    """
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(as_double(c)).alias(f"_m{i}") for i, c in enumerate(numeric)]).first()
    n = row["_n"]
    fills = {c: row[f"_m{i}"] if row[f"_m{i}"] is not None else 0.0 for i, c in enumerate(numeric)}
    levels: dict[str, list] = {}
    if categorical:
        counts = value_counts_long(df, categorical)
        key = F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))
        modes = counts.groupBy("column_name").agg(F.min_by("value", key).alias("mode"), F.sum("n").alias("there"))
        per_column = {r["column_name"]: r for r in modes.collect()}  # one row a column
        for c in categorical:
            fills[c] = per_column[c]["mode"] if c in per_column else missing
        if not all_levels:
            filled = df.sparkSession.createDataFrame(
                [(c, r["mode"], n - r["there"]) for c, r in per_column.items()] or [("", "", 0)],
                "column_name string, mode string, filled long")
            m = F.col("n") + F.when(F.col("value") == F.col("mode"), F.col("filled")).otherwise(F.lit(0))
            counts = counts.join(F.broadcast(filled), "column_name").withColumn("n", m).where(F.col("n") < n)
            if n >= 20:
                counts = counts.where((F.col("n") * 20 >= n) & ((F.lit(n) - F.col("n")) * 20 >= n))
        found = counts.select("column_name", "value").limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise PreprocessError("many_levels", f"more than {MOST_LEVELS} levels for a column each: use one_hot_vector, or "
                                                 "fit_sparse of plans/sparse.py")
        for r in found:
            levels.setdefault(r["column_name"], []).append(r["value"])
        for c in categorical:
            levels[c] = sorted(levels.get(c, [missing] if all_levels and c not in per_column else []))
    return n, fills, levels


def preprocess(df: DataFrame, target: str, nzv: bool = True, corr_cutoff: float | None = 0.9,
               rule: str = "exact") -> tuple[Preprocessor, DataFrame]:
    """validate -> drop null targets -> impute -> row check -> one-hot -> syntactic names -> drop
    near-zero-variance features -> drop correlated features -> standardise. The target is never dropped or scaled.

    Levels whose 0/1 column would be near-zero-variance are left out by their counts, before any column is
    made of them (``nzv=False`` makes one column of every level, which suits columns of few levels only).
    Correlations and standard deviations come from one centred pass.

    Returns ``(preprocessor, prepared)`` where ``prepared`` holds the target
    and the scaled features (a lazy projection of the input).
    """
    predictors = validate_target(df, target)
    kept = df.where(as_double(target).isNotNull())
    numeric = [c for c in predictors if is_numeric_type(df.schema[c].dataType)]
    categorical = [c for c in predictors if c not in numeric]
    n, fills, levels = fit_fill_values(kept, numeric, categorical, all_levels=not nzv)
    if n == 0:
        raise PreprocessError("no_rows", f"no row has a value of {target}")
    if n <= len(predictors):
        raise PreprocessError("few_rows", "there must be more rows than predictors")
    pairs = [(c, lvl) for c in categorical for lvl in levels[c]]
    norm = normalized_names([target] + numeric + [f"{c}_{lvl}" for c, lvl in pairs])
    numeric_names = dict(zip(numeric, norm[1:1 + len(numeric)]))
    dummy_names = dict(zip(pairs, norm[1 + len(numeric):]))
    features = norm[1:]
    pre = Preprocessor(target, numeric, categorical, fills, levels, dummy_names, features, numeric_names=numeric_names)
    unscaled = kept.select(as_double(target).alias(norm[0]), *pre.feature_exprs(scaled=False))
    dropped = {"nzv": [], "correlated": []}
    if nzv and numeric:
        dropped["nzv"] = nzv_columns(unscaled.select(*[_q(numeric_names[c]) for c in numeric]))
        features = [f for f in features if f not in dropped["nzv"]]
    if features:
        g = gram_by_group(unscaled, features, norm[0])
        mo = g.moments(g[0])
        sd = np.sqrt(np.maximum(np.diag(mo.cxx) * mo.n / max(mo.n - 1, 1), 0.0))
        if corr_cutoff is not None and len(features) > 1:
            scale = np.where(sd > 0, np.sqrt(np.maximum(np.diag(mo.cxx), 1e-300)), np.nan)
            corr = np.clip(mo.cxx / np.outer(scale, scale), -1, 1)
            matrix = {(a, b): None if np.isnan(corr[i, j]) else float(corr[i, j])
                      for i, a in enumerate(features) for j, b in enumerate(features)}
            dropped["correlated"] = find_correlated(matrix, features, corr_cutoff, exact=rule == "exact")
        at = [i for i, f in enumerate(features) if f not in dropped["correlated"]]
        pre.means = {features[i]: float(mo.mx[i]) for i in at}
        pre.sds = {features[i]: float(sd[i]) if sd[i] > 0 else 1.0 for i in at}
        features = [features[i] for i in at]
    pre.features, pre.dropped = features, dropped
    prepared = pre.transform(kept.select(*[_q(c) for c in df.columns]))
    if norm[0] != target:
        prepared = prepared.withColumnRenamed(target, norm[0])
    return pre, prepared


# ------------------------------------------------------------------ F2, F3, F5, F6

def one_hot(df: DataFrame, cols: list[str], keep_source: bool = False) -> DataFrame:
    """one 0/1 column per level (all levels kept, ascending), named
    ``<col>_<level>`` made syntactic; nulls give 0 in every level column."""
    _, _, levels = fit_fill_values(df, [], list(cols))  # more than MOST_LEVELS are an error
    others = [c for c in df.columns if keep_source or c not in cols]
    names = normalized_names(others + [f"{c}_{lvl}" for c in cols for lvl in levels[c]])[len(others):]
    exprs, k = [], 0
    for c in cols:
        for lvl in levels[c]:
            exprs.append(F.when(_q(c).cast("string") == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0)).alias(names[k]))
            k += 1
    return df.select(*[_q(c) for c in others], *exprs)


def one_hot_vector(df: DataFrame, cols: list[str], out_col: str = "one_hot") -> DataFrame:
    """F2 for columns of many levels: one sparse vector column instead of a column a level (levels ascending, nulls and
    unseen values last)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index, hot = [f"_{out_col}_i{i}" for i in range(len(cols))], [f"_{out_col}_h{i}" for i in range(len(cols))]
    text = df.select("*", *[_q(c).cast("string").alias(f"_{out_col}_s{i}") for i, c in enumerate(cols)])
    stages = [StringIndexer(inputCols=[f"_{out_col}_s{i}" for i in range(len(cols))], outputCols=index,
                            stringOrderType="alphabetAsc", handleInvalid="keep"),
              OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False), VectorAssembler(inputCols=hot, outputCol=out_col)]
    done = Pipeline(stages=stages).fit(text).transform(text)
    return done.select(*[_q(c) for c in df.columns], out_col)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sample sd for ``cols`` (one aggregate); others untouched."""
    row = df.agg(*[F.avg(as_double(c)).alias(f"_m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(as_double(c)).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
    idx = {c: i for i, c in enumerate(cols)}
    out = []
    for c in df.columns:
        if c in idx:
            i = idx[c]
            sd = row[f"_s{i}"] or 1.0
            out.append(((as_double(c) - F.lit(row[f"_m{i}"])) / F.lit(sd)).alias(c))
        else:
            out.append(_q(c))
    return df.select(*out)


def fill_score_row(df: DataFrame, target: str, inputs: dict | DataFrame | None = None, position: str | None = None) -> DataFrame:
    """input rows with defaults: the mean of each numeric predictor and the smallest non-null
    value of each other predictor, or, where ``position`` names a column with each row's number in file order
    (which is no predictor), the non-null value that is seen first; one aggregate.

    ``inputs``: the user's values, a dict (one row) or a table; a null or absent value takes the
    default, columns that are no predictors are ignored. Without inputs: the row of defaults."""
    names, defaults = [], []
    for f in df.schema.fields:
        if f.name not in (target, position):
            names.append(f)
            text = F.min_by(_q(f.name), F.when(_q(f.name).isNotNull(), _q(position))) if position else F.min(_q(f.name))
            defaults.append((F.avg(as_double(f.name)) if is_numeric_type(f.dataType) else text).alias(f.name))
    row = df.agg(*defaults)
    if inputs is None:
        return row
    if isinstance(inputs, dict):
        inputs = df.sparkSession.range(1).select(*[F.lit(v).alias(c) for c, v in inputs.items()] or [F.lit(1).alias("_none")])
    kinds = {f.name: row.schema[f.name].dataType for f in names}
    given = [_q(f.name).cast(kinds[f.name]) if f.name in inputs.columns else F.lit(None).cast(kinds[f.name])
             for f in names]
    first = row.first()  # one value a predictor
    return inputs.select(*[
        F.coalesce(F.nanvl(v, F.lit(None)) if is_numeric_type(f.dataType) else v, F.lit(first[f.name])).alias(f.name)
        for f, v in zip(names, given)])


def align_features(df: DataFrame, expected: list[str], fill: float = 0.0) -> DataFrame:
    """exactly the ``expected`` columns in order; absent columns and nulls -> ``fill``."""
    present = set(df.columns)
    return df.select(*[
        (F.coalesce(as_double(c), F.lit(fill)) if c in present else F.lit(fill)).alias(c) for c in expected
    ])
