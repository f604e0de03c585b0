"""

Every query reads the driver tables (or a fixture view derived from them by
SQL) in full. Doubles are rounded to 6 decimals on both sides so the value
hash compares numbers, not the last bits of two engines' arithmetic.
Queries without an oracle are the ones SQL cannot express (tree ensembles,
iterative fits, random samples); they get the rows-only check and pytest
properties.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.normal import A, B, C, D, P_LOW, qnorm
from tabwise.functions.stats import rounded
from tabwise.operators import clean as K
from tabwise.operators import plotdata as P
from tabwise.operators import profile as PR
from tabwise.operators import schema as S
from tabwise.plans import evaluate as V
from tabwise.plans import features as FE
from tabwise.plans import models as M
from tabwise.plans.sparse import fit_sparse
from tabwise.session import ensure_checkpoint_dir
from tabwise.sources import csv as CSV
from tabwise.sources.lines import parquet_positions
from tabwise.sources.tables import FIXTURE_SQL, fixture, read_table

# the pipeline subpackage and its top-level script may be absent; if they are there, their errors are errors
if (_llm := find_spec("tabwise.llm")) and _llm.origin:
    from tabwise.llm.queries import ORACLES as LLM_ORACLES
    from tabwise.llm.queries import QUERIES as LLM_QUERIES
else:
    LLM_ORACLES, LLM_QUERIES = {}, {}
corpus_pipeline = importlib.import_module("corpus_pipeline") if LLM_QUERIES and find_spec("corpus_pipeline") else None

SMOKE_DIR = "/root/testdata/sf0.001"

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
EVENTS_NUM = ["event_id", "user_id", "value"]
FX_GAP_COLS = ["id", "price", "mostly_null", "const_col", "near_const", "priority", "status", "price_copy", "cust"]
FX_GAP_NUM = ["id", "price", "mostly_null", "const_col", "near_const", "price_copy", "cust"]


def _t(spark, sf, name):
    return read_table(spark, sf, name)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the column profile (A15) of ``lineitem`` at sf0.001."""
    return rounded(PR.profile(_t(spark, SMOKE_DIR, "lineitem")))


# ------------------------------------------------------------------ Spark side

def _q_profile(spark, sf):
    # means of 2-decimal data can sit exactly on a 6-decimal rounding boundary: compare them at 5
    return rounded(PR.profile(_t(spark, sf, "lineitem"))).withColumn("mean", F.round("mean", 5))


def _q_shape(spark, sf):
    gap = fixture(spark, sf, "fx_gap")
    return PR.shape(gap, K.complete_cases(K.drop_columns(gap, ["mostly_null"])))


def _q_null_counts(spark, sf):
    return PR.null_counts(fixture(spark, sf, "fx_gap"))


def _q_null_fraction(spark, sf):
    return rounded(PR.null_fraction(fixture(spark, sf, "fx_gap")))


def _q_duplicates(spark, sf):
    return PR.duplicate_count(fixture(spark, sf, "fx_dup"))


def _q_summary(spark, sf):
    return rounded(PR.summary(fixture(spark, sf, "fx_gap")))


def _q_quantiles(spark, sf):
    return rounded(PR.quantiles(_t(spark, sf, "events"), ["value", "user_id"], (0.1, 0.25, 0.5, 0.75, 0.9)))


def _q_distinct(spark, sf):
    return PR.distinct_values(fixture(spark, sf, "fx_gap"), "priority")


def _q_mean(spark, sf):
    return rounded(PR.column_mean(_t(spark, sf, "lineitem")))


def _q_mode(spark, sf):
    return PR.mode_value(fixture(spark, sf, "fx_gap"), "priority")


def _q_nzv(spark, sf):
    return rounded(PR.near_zero_variance(fixture(spark, sf, "fx_gap")))


def _q_corr(spark, sf):
    return rounded(PR.correlation(_t(spark, sf, "lineitem")))


def _q_correlated(spark, sf):
    gap = fixture(spark, sf, "fx_gap")
    names = PR.correlated_columns(K.drop_near_zero_variance(K.drop_sparse_columns(gap)))
    return spark.createDataFrame([(n,) for n in names], "column_name string")


def _q_drop_sparse(spark, sf):
    return rounded(K.drop_sparse_columns(fixture(spark, sf, "fx_gap")))


def _q_drop_nzv(spark, sf):
    return rounded(K.drop_near_zero_variance(fixture(spark, sf, "fx_gap")))


def _q_drop_corr(spark, sf):
    gap = fixture(spark, sf, "fx_gap").select("id", "price", "price_copy", "cust")
    return rounded(K.drop_correlated(gap))


def _q_auto_clean(spark, sf):
    return rounded(K.auto_clean(fixture(spark, sf, "fx_gap")))


def _q_impute_mean(spark, sf):
    return rounded(K.impute_mean(fixture(spark, sf, "fx_gap")))


def _q_impute_mode(spark, sf):
    return rounded(K.impute_mode(fixture(spark, sf, "fx_gap")))


def _q_outliers(spark, sf):
    return rounded(PR.outlier_counts(_t(spark, sf, "events")))


def _q_remove_seq(spark, sf):
    return rounded(K.remove_outliers(fixture(spark, sf, "fx_out"), mode="sequential"))


def _q_remove_joint(spark, sf):
    return rounded(K.remove_outliers(fixture(spark, sf, "fx_out"), mode="joint"))


ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _day(df):
    """The order's timestamp as text, which both engines write alike."""
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _q_drop_columns(spark, sf):
    return K.drop_columns(_t(spark, sf, "orders"), ["o_orderdate", "no_such_column"])


DROP_ROWS_TEXT = "1, 5, x, 15000, 20000, 0, -3, 7.5"


def _q_drop_rows(spark, sf):
    return _day(K.drop_rows(_t(spark, sf, "orders"), DROP_ROWS_TEXT, ["o_orderkey"]))


def _q_select_numeric(spark, sf):
    return S.select_numeric(_t(spark, sf, "lineitem"))


def _q_select_text(spark, sf):
    return S.select_text(_t(spark, sf, "lineitem"))


def _q_drop_null_target(spark, sf):
    return K.drop_null_target(fixture(spark, sf, "fx_gap"), "price")


def _q_complete_cases(spark, sf):
    return K.complete_cases(fixture(spark, sf, "fx_gap"))


def _q_model_columns(spark, sf):
    return K.select_model_columns(fixture(spark, sf, "fx_reg"), "y", numeric_only=True)


def _q_preview(spark, sf):
    return _day(K.preview(_t(spark, sf, "orders"), ["o_orderkey"], page=3, page_size=20, search="urgent"))


def _q_drop_duplicates(spark, sf):
    return K.drop_duplicates(fixture(spark, sf, "fx_dup"))


def _q_melt(spark, sf):
    return P.melt_numeric(_t(spark, sf, "events"))


def _q_boxplot(spark, sf):
    return rounded(P.boxplot_stats(_t(spark, sf, "events")))


def _q_boxplot_by(spark, sf):
    return rounded(P.boxplot_by(_t(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


def _q_boxplot_numeric(spark, sf):
    return rounded(P.boxplot_by(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


def _q_line_buckets(spark, sf):
    return rounded(P.line_buckets(_t(spark, sf, "events"), "event_id", "value", buckets=100))


def _q_pair_matrix(spark, sf):
    return rounded(P.pair_matrix(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], n=2_000))


def _q_null_counts_nan(spark, sf):
    return PR.null_counts(fixture(spark, sf, "fx_nan"))


def _q_profile_nan(spark, sf):
    return rounded(PR.profile(fixture(spark, sf, "fx_nan")))


def _q_drop_sparse_nan(spark, sf):
    return K.drop_sparse_columns(fixture(spark, sf, "fx_nan")).select("event_id", F.round("value", 6).alias("value"))


def _q_column_names(spark, sf):
    return S.column_names(fixture(spark, sf, "fx_gap"))


def _q_numeric_list(spark, sf):
    return spark.createDataFrame([(S.numeric_column_list(fixture(spark, sf, "fx_gap")),)], "numeric_columns string")


def _q_guard(spark, sf):
    return CSV.empty_guard(_t(spark, sf, "orders")).agg(F.count(F.lit(1)).alias("n_rows"))


def _q_validate(spark, sf):
    names = FE.validate_target(fixture(spark, sf, "fx_reg"), "y")
    return spark.createDataFrame([(n,) for n in names], "predictor string")


def _q_residuals(spark, sf):
    pts, _ = V.regression_diagnostics(fixture(spark, sf, "fx_reg").select("y", "l_quantity", "l_discount"), "y")
    return rounded(pts)


def _q_qq_residuals(spark, sf):
    pts, _ = V.regression_diagnostics(fixture(spark, sf, "fx_reg").select("y", "l_quantity"), "y")
    return rounded(P.qq_points(pts, "residual"), 5)


def _q_scatter_bins(spark, sf):
    return P.scatter_bins(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", bins=20)


def _q_scatter_points(spark, sf):
    return P.scatter_points(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def _q_line(spark, sf):
    return P.line_points(_t(spark, sf, "events"), "event_id", "value")


def _q_hist(spark, sf):
    return rounded(P.histogram(_t(spark, sf, "events"), "value", bins=15))


def _q_hist_width(spark, sf):
    return rounded(P.histogram_width(_t(spark, sf, "lineitem"), "l_quantity", width=10.0))


def _q_corr_pairs(spark, sf):
    return rounded(P.correlation_pairs(_t(spark, sf, "lineitem")))


def _q_pair_corr(spark, sf):
    return rounded(P.pair_correlations(_t(spark, sf, "lineitem")))


def _q_diagnostics(spark, sf):
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity")
    pts, coef = V.regression_diagnostics(reg, "y")
    one = pts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("rss"),
                  F.avg("predicted").alias("mean_predicted"))
    return rounded(one.select("n", F.lit(coef["intercept"]).alias("intercept"),
                              F.lit(coef["l_quantity"]).alias("slope"), "rss", "mean_predicted"))


def _q_qq(spark, sf):
    return rounded(P.qq_points(_t(spark, sf, "events"), "value"))


def _q_sample(spark, sf):
    return P.plot_sample(_t(spark, sf, "lineitem"), n=10_000, seed=7)


def _q_sample_members(spark, sf):
    """How many rows the sample has, and how many of them are rows of the table."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sample = P.plot_sample(li, n=10_000, seed=7)
    there = sample.join(li.distinct(), li.columns, "left_semi").agg(F.count(F.lit(1)).alias("members"))
    return sample.agg(F.count(F.lit(1)).alias("n")).crossJoin(there)  # one row each


def _q_density(spark, sf):
    return rounded(P.density_curve(_t(spark, sf, "events"), "value"))


def _q_one_hot(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return FE.one_hot(li, ["l_returnflag", "l_linestatus"])


def _q_standardize(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(FE.standardize(li, ["l_quantity", "l_extendedprice"]))


def _q_fill_row(spark, sf):
    return rounded(FE.fill_score_row(fixture(spark, sf, "fx_reg"), "y"))


def _q_align(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    return FE.align_features(li, ["l_discount", "l_quantity", "l_missing"])


def _q_preprocess(spark, sf):
    """F1 end to end on a table with nulls in the target, numeric and text predictors."""
    pre, prepared = FE.preprocess(fixture(spark, sf, "fx_gap"), "price")
    return rounded(prepared)


def _lm1(spark, sf):
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity")
    return reg, M.fit_linear(reg, ["l_quantity"], "y", "lm", cv="none")


def _q_lm(spark, sf):
    reg, fit = _lm1(spark, sf)
    return rounded(spark.createDataFrame(
        [(fit.params["intercept"], fit.coef["l_quantity"])], "intercept double, slope double"))


def _q_lm_metrics(spark, sf):
    reg, fit = _lm1(spark, sf)
    return rounded(V.metrics(fit.predict(reg, keep=["y"]), "y"))


def _q_mean_model(spark, sf):
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity")
    fit = M.fit_linear(reg, ["l_quantity"], "y", "mean", cv="none")
    return rounded(V.metrics(fit.predict(reg, keep=["y"]), "y"))


def _q_folds(spark, sf):
    return M.fold_sizes(fixture(spark, sf, "fx_reg"), 5, 3)


def _q_folds_most(spark, sf):
    return M.fold_sizes(fixture(spark, sf, "fx_reg"), 20, 10)


def _q_folds_ten(spark, sf):
    return M.fold_sizes(_t(spark, sf, "orders"), 10, 10)


def _cores(spark):
    """Partitions that the prepared rows of a training query are dealt into: training reads them many times."""
    return spark.sparkContext.defaultParallelism


def _q_compare(spark, sf):
    return V.compare_models(fixture(spark, sf, "fx_reg"), "y", models=["lm", "glmnet", "lasso", "earth", "rbf_ridge", "tree"],
                            cv="cv", k=5, partitions=_cores(spark)).metrics


def _q_forest(spark, sf):
    return V.compare_models(fixture(spark, sf, "fx_reg"), "y", models=["rf"], cv="cv", k=5, partitions=_cores(spark)).metrics


def _q_sparse(spark, sf):
    """A slope and one level a part: as many columns as the table has parts; predictions as shares of the actual value."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", F.col("l_partkey").cast("string").alias("part"))
    fit = fit_sparse(li, "l_extendedprice", ["l_quantity", "part"])
    share = (F.col("prediction") / F.col("l_extendedprice")).alias("share")
    out = fit.predict(li, keep=["l_orderkey", "l_linenumber", "l_extendedprice"])
    return rounded(out.select("l_orderkey", "l_linenumber", share, F.lit(fit.coefficients()["l_quantity"]).alias("slope")))


def _q_boosting(spark, sf):
    return V.compare_models(fixture(spark, sf, "fx_reg"), "y", models=["gbm", "xgbTree"], cv="cv", k=5,
                            partitions=_cores(spark)).metrics


def _q_svm(spark, sf):
    return V.compare_models(fixture(spark, sf, "fx_reg"), "y", models=["svmRadial"], cv="cv", k=5, partitions=_cores(spark)).metrics


def _q_stump(spark, sf):
    """One round of one cut: the exact second-order split of the gradients."""
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity")
    fit = M.fit_boosted(reg, ["l_quantity"], "y", "xgbTree", cv="none", rounds=1, depth=1)
    return rounded(fit.predict(reg, keep=["l_quantity"]).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction")))


def _q_penalised(spark, sf):
    """Ridge and lasso with one predictor, at the first lambda of the grid."""
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity")
    fits = {m: M.fit_linear(reg, ["l_quantity"], "y", m, cv="none") for m in ("glmnet", "lasso")}
    return rounded(spark.createDataFrame([(m, f.params["intercept"], f.coef["l_quantity"]) for m, f in fits.items()],
                                         "model string, intercept double, slope double"))


def _q_permutation(spark, sf):
    """Importance of every predictor for a model without a measure of its own."""
    res = V.compare_models(fixture(spark, sf, "fx_reg"), "y", models=["rbf_ridge"], cv="none", partitions=_cores(spark))
    return rounded(V.variable_importance(res.fitted["rbf_ridge"], prepared=res.prepared, label=res.label))


def _q_pair_matrix_default(spark, sf):
    """The pair plot's own columns (the first 8 numeric ones) and sample size."""
    li = _t(spark, sf, "lineitem")
    return rounded(P.pair_matrix(li, P.default_columns(li, 8)[0]))


def _q_one_pass(spark, sf):
    gap = fixture(spark, sf, "fx_gap").select("id", "price", "price_copy", "cust")
    return spark.createDataFrame([(n,) for n in PR.correlated_columns(gap, rule="one_pass")], "column_name string")


def _q_classify_held_out(spark, sf):
    """Confusion table of the held-out rows: a text target on numeric and text predictors."""
    orders = _t(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey")
    return M.compare_classifiers(orders, "o_orderstatus", models=("logistic", "tree"), cv="cv", k=5, partitions=_cores(spark),
                                 confusion=True)[1]


def _one_predictor(spark, sf, models):
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity")
    return V.compare_models(reg, "y", models=models, cv="none")


def _q_predict(spark, sf):
    score = fixture(spark, sf, "fx_reg").select("l_quantity")
    return rounded(_one_predictor(spark, sf, ["lm"]).predict(score, keep=["l_quantity"]))


def _q_best(spark, sf):
    models = ["mean", "lm"]
    return rounded(V.best_model(_one_predictor(spark, sf, models).metrics, models).drop("cv_rmse", "error"))


def _q_metrics_long(spark, sf):
    return rounded(P.metrics_long(_one_predictor(spark, sf, ["mean", "lm"]).metrics))


def _q_importance(spark, sf):
    reg = fixture(spark, sf, "fx_reg").select("y", "l_quantity", "l_discount")
    return rounded(V.variable_importance(V.compare_models(reg, "y", models=["lm"], cv="none").fitted["lm"]))


def _q_summary_model(spark, sf):
    res = V.compare_models(fixture(spark, sf, "fx_reg"), "y", models=["lasso"], cv="repeatedcv", k=5, repeats=3)
    return V.model_summary(res.fitted["lasso"])


def _q_qq_line(spark, sf):
    line = P.qq_line(_t(spark, sf, "events"), "value")
    return rounded(spark.createDataFrame([(line["slope"], line["intercept"])], "slope double, intercept double"))


def _q_classify(spark, sf):
    li = _t(spark, sf, "lineitem")
    return M.compare_classifiers(li, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], partitions=_cores(spark))


def _q_read_csv(spark, sf):
    """The fixture as CSV lines with three null spellings, quotes, commas and line breaks, read back and typed."""
    gap = fixture(spark, sf, "fx_gap").withColumn("said", F.concat(F.lit('he said "'), F.col("status"), F.lit('", ok\nthen left')))
    token = {"price": "NA", "mostly_null": "?", "priority": ""}
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(token.get(c, "NA"))) for c in gap.columns]
    quoted = [F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"')) for f in fields]
    lines = gap.select(F.concat_ws(",", *quoted).alias("line"))
    return rounded(CSV.table_of_lines(lines, gap.columns))


def _q_read_csv_files(spark, sf):
    """S1 on files: the fixture, written as CSV with quoted line breaks, commas and null tokens, read back in splits and typed."""
    gap = fixture(spark, sf, "fx_gap").withColumn("said", F.concat(F.lit('he said "'), F.col("status"), F.lit('", ok\nthen left')))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    text = gap.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in gap.columns])
    text.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return rounded(CSV.read_table_csv(spark, path, multi_line=True))


def _q_drop_rows_file(spark, sf):
    return _day(K.drop_rows(parquet_positions(spark, f"{sf}/orders.parquet"), DROP_ROWS_TEXT, position="position"))


def _q_distinct_seen(spark, sf):
    return PR.distinct_values(parquet_positions(spark, f"{sf}/orders.parquet"), "o_orderpriority", position="position")


def _q_fill_row_file(spark, sf):
    li = parquet_positions(spark, f"{sf}/lineitem.parquet").select(
        "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "position")
    return rounded(FE.fill_score_row(li, "l_extendedprice", position="position"))


def _q_normalize(spark, sf):
    li = _t(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("qty (units)"), F.col("l_discount").alias("2nd discount"),
        F.col("l_tax").alias("qty (units)"))
    return S.normalize_names(li)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "profile_lineitem": _q_profile,
        "shape_fx_gap": _q_shape,
        "null_counts_fx_gap": _q_null_counts,
        "null_fraction_fx_gap": _q_null_fraction,
        "duplicate_count_fx_dup": _q_duplicates,
        "summary_fx_gap": _q_summary,
        "quantiles_events": _q_quantiles,
        "distinct_values_priority": _q_distinct,
        "column_mean_lineitem": _q_mean,
        "mode_value_priority": _q_mode,
        "near_zero_variance_fx_gap": _q_nzv,
        "correlation_lineitem": _q_corr,
        "correlated_columns_fx_gap": _q_correlated,
        "drop_sparse_columns_fx_gap": _q_drop_sparse,
        "drop_near_zero_variance_fx_gap": _q_drop_nzv,
        "drop_correlated_fx_gap": _q_drop_corr,
        "auto_clean_fx_gap": _q_auto_clean,
        "impute_mean_fx_gap": _q_impute_mean,
        "impute_mode_fx_gap": _q_impute_mode,
        "outlier_counts_events": _q_outliers,
        "remove_outliers_sequential": _q_remove_seq,
        "remove_outliers_joint": _q_remove_joint,
        "drop_columns_orders": _q_drop_columns,
        "drop_rows_orders": _q_drop_rows,
        "select_numeric_lineitem": _q_select_numeric,
        "select_text_lineitem": _q_select_text,
        "drop_null_target_fx_gap": _q_drop_null_target,
        "complete_cases_fx_gap": _q_complete_cases,
        "select_model_columns_fx_reg": _q_model_columns,
        "preview_orders": _q_preview,
        "drop_duplicates_fx_dup": _q_drop_duplicates,
        "melt_numeric_events": _q_melt,
        "boxplot_stats_events": _q_boxplot,
        "boxplot_by_returnflag": _q_boxplot_by,
        "scatter_bins_lineitem": _q_scatter_bins,
        "scatter_points_lineitem": _q_scatter_points,
        "line_points_events": _q_line,
        "histogram_events": _q_hist,
        "histogram_width_quantity": _q_hist_width,
        "correlation_pairs_lineitem": _q_corr_pairs,
        "pair_correlations_lineitem": _q_pair_corr,
        "regression_diagnostics_fx_reg": _q_diagnostics,
        "qq_points_events": _q_qq,
        "plot_sample_lineitem": _q_sample,
        "density_curve_events": _q_density,
        "preprocess_fx_gap": _q_preprocess,
        "one_hot_lineitem": _q_one_hot,
        "standardize_lineitem": _q_standardize,
        "fill_score_row_fx_reg": _q_fill_row,
        "align_features_lineitem": _q_align,
        "linear_model_fx_reg": _q_lm,
        "model_metrics_fx_reg": _q_lm_metrics,
        "mean_model_fx_reg": _q_mean_model,
        "fold_sizes_fx_reg": _q_folds,
        "fold_sizes_20_by_10": _q_folds_most,
        "fold_sizes_10_by_10": _q_folds_ten,
        "compare_models_fx_reg": _q_compare,
        "boosting_fx_reg": _q_boosting,
        "predict_fx_reg": _q_predict,
        "best_model_fx_reg": _q_best,
        "model_summary_fx_reg": _q_summary_model,
        "qq_line_events": _q_qq_line,
        "variable_importance_fx_reg": _q_importance,
        "metrics_long_fx_reg": _q_metrics_long,
        "classify_returnflag": _q_classify,
        "read_table_csv_fx_gap": _q_read_csv,
        "read_table_csv_files_fx_gap": _q_read_csv_files,
        "drop_rows_file_order_orders": _q_drop_rows_file,
        "distinct_values_first_seen_orders": _q_distinct_seen,
        "fill_score_row_file_order_lineitem": _q_fill_row_file,
        "normalize_names_lineitem": _q_normalize,
        "boxplot_by_quantity": _q_boxplot_numeric,
        "line_buckets_events": _q_line_buckets,
        "pair_matrix_lineitem": _q_pair_matrix,
        "null_counts_fx_nan": _q_null_counts_nan,
        "profile_fx_nan": _q_profile_nan,
        "drop_sparse_columns_fx_nan": _q_drop_sparse_nan,
        "column_names_fx_gap": _q_column_names,
        "numeric_columns_fx_gap": _q_numeric_list,
        "empty_guard_orders": _q_guard,
        "validate_target_fx_reg": _q_validate,
        "residual_points_fx_reg": _q_residuals,
        "qq_residuals_fx_reg": _q_qq_residuals,
        "plot_sample_members_lineitem": _q_sample_members,
        "forest_fx_reg": _q_forest,
        "sparse_linear_lineitem": _q_sparse,
        "svm_radial_fx_reg": _q_svm,
        "boosted_stump_fx_reg": _q_stump,
        "penalised_models_fx_reg": _q_penalised,
        "permutation_importance_fx_reg": _q_permutation,
        "pair_matrix_default_lineitem": _q_pair_matrix_default,
        "correlated_columns_one_pass_fx_gap": _q_one_pass,
        "classify_held_out_orders": _q_classify_held_out,
    }
    if corpus_pipeline is not None:
        own["pipeline"] = corpus_pipeline.run
    return own | LLM_QUERIES


# ------------------------------------------------------------------ DuckDB side

def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names) + " "


def _r(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6)"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _sql_profile() -> str:
    parts = []
    for c in LINEITEM_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {_r(f'min({x}) + 0.0')} AS min, "
            f"{_r(f'quantile_cont({x}, 0.25)')} AS q1, {_r(f'quantile_cont({x}, 0.5)')} AS median, "
            f"ROUND(avg({x}), 5) AS mean, {_r(f'quantile_cont({x}, 0.75)')} AS q3, {_r(f'max({x})')} AS max, "
            f"(SELECT CAST(count(*) AS BIGINT) FROM lineitem l2, "
            f"(SELECT quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.75) AS b FROM lineitem) f "
            f"WHERE CAST(l2.{c} AS DOUBLE) < f.a - 1.5 * (f.b - f.a) OR CAST(l2.{c} AS DOUBLE) > f.b + 1.5 * (f.b - f.a)) AS outliers "
            f"FROM lineitem")
    return _union(parts)


def _sql_outliers(table: str, cols: list[str], prefix: str = "") -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, {_r('f.a')} AS q1, {_r('f.b')} AS q3, {_r('f.a - 1.5 * (f.b - f.a)')} AS lower, "
            f"{_r('f.b + 1.5 * (f.b - f.a)')} AS upper, "
            f"(SELECT CAST(count(*) AS BIGINT) FROM {table} t WHERE CAST(t.{c} AS DOUBLE) < f.a - 1.5 * (f.b - f.a) "
            f"OR CAST(t.{c} AS DOUBLE) > f.b + 1.5 * (f.b - f.a)) AS outliers "
            f"FROM (SELECT quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.75) AS b FROM {table}) f")
    return prefix + _union(parts)


def _sql_nzv() -> str:
    parts = []
    for i, c in enumerate(FX_GAP_COLS):
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS pos, "
            f"CASE WHEN count(*) <= 1 THEN 0.0 ELSE CAST(max(n) AS DOUBLE) / list_sort(list(n), 'DESC')[2] END AS freq_ratio, "
            f"100.0 * count(*) / (SELECT count(*) FROM fx_gap) AS percent_unique, count(*) <= 1 AS zero_var "
            f"FROM (SELECT {c} AS v, count(*) AS n FROM fx_gap WHERE {c} IS NOT NULL GROUP BY 1) g")
    return (_with("fx_gap") + "SELECT column_name, " + _r("freq_ratio") + " AS freq_ratio, " + _r("percent_unique")
            + " AS percent_unique, zero_var, (freq_ratio > 19.0 AND percent_unique <= 10.0) OR zero_var AS nzv FROM ("
            + _union(parts) + ") s")


def _sql_corr(cols, table, pairs_only=False, pairwise=False) -> str:
    where = "" if pairwise else " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols)
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if pairs_only and j <= i:
                continue
            if i == j:
                val = f"CASE WHEN stddev_samp(CAST({a} AS DOUBLE)) > 0 THEN 1.0 END"
            else:
                val = (f"CASE WHEN stddev_samp(CAST({a} AS DOUBLE)) > 0 AND stddev_samp(CAST({b} AS DOUBLE)) > 0 "
                       f"THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END")
            names = ("var1", "var2") if pairs_only else ("col_a", "col_b")
            parts.append(f"SELECT '{a}' AS {names[0]}, '{b}' AS {names[1]}, {_r(val)} AS corr FROM {table}{where}")
    return _union(parts)


def _sql_remove(mode: str) -> str:
    cols = ["event_id", "value", "v2"]

    def fence_filter(src, c, stats_src):
        return (f"SELECT * FROM {src} WHERE {c} IS NULL OR CAST({c} AS DOUBLE) BETWEEN "
                f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) - 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) FROM {stats_src}) AND "
                f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) FROM {stats_src})")

    ctes = [f"fx_out AS ({FIXTURE_SQL['fx_out']})"]
    src = "fx_out"
    for i, c in enumerate(cols):
        stats = src if mode == "sequential" else "fx_out"
        ctes.append(f"s{i} AS ({fence_filter(src, c, stats)})")
        src = f"s{i}"
    return "WITH " + ", ".join(ctes) + f" SELECT event_id, {_r('value')} AS value, {_r('v2')} AS v2 FROM {src}"


def _sql_qnorm(p: str) -> str:
    def lit(v):
        return f"CAST('{v!r}' AS DOUBLE)"

    def horner(coefs, x):
        acc = f"({lit(coefs[0])} * {x})"
        for c in coefs[1:-1]:
            acc = f"(({acc} + {lit(c)}) * {x})"
        return f"({acc} + {lit(coefs[-1])})"

    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({horner(A, r)} * {q} / ({horner(B, r)} * {r} + 1))"
    ql = f"sqrt(-2.0 * ln({p}))"
    low = f"({horner(C, ql)} / ({horner(D, ql)} * {ql} + 1))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    high = f"(-{horner(C, qh)} / ({horner(D, qh)} * {qh} + 1))"
    return f"(CASE WHEN {p} < {lit(P_LOW)} THEN {low} WHEN {p} <= {lit(1 - P_LOW)} THEN {mid} ELSE {high} END)"


def _sql_box(table, cols) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS n, {_r('f.a')} AS q1, {_r('f.m')} AS median, "
            f"{_r('f.b')} AS q3, {_r(f'min(CASE WHEN {x} >= f.a - 1.5 * (f.b - f.a) THEN {x} END)')} AS lower_whisker, "
            f"{_r(f'max(CASE WHEN {x} <= f.b + 1.5 * (f.b - f.a) THEN {x} END)')} AS upper_whisker, "
            f"CAST(count_if({x} < f.a - 1.5 * (f.b - f.a) OR {x} > f.b + 1.5 * (f.b - f.a)) AS BIGINT) AS outliers "
            f"FROM {table}, (SELECT quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.5) AS m, "
            f"quantile_cont({x}, 0.75) AS b FROM {table}) f GROUP BY f.a, f.m, f.b")
    return _union(parts)


def _sql_summary() -> str:
    types = {"id": "bigint", "price": "double", "mostly_null": "bigint", "const_col": "int", "near_const": "int",
             "priority": "string", "status": "string", "price_copy": "double", "cust": "bigint"}
    parts = []
    for c in FX_GAP_COLS:
        t = types[c]
        if c in FX_GAP_NUM:
            x = f"CAST({c} AS DOUBLE)"
            num = (f"{_r(f'min({x}) + 0.0')}, {_r(f'quantile_cont({x}, 0.25)')}, {_r(f'quantile_cont({x}, 0.5)')}, "
                   f"{_r(f'avg({x})')}, {_r(f'quantile_cont({x}, 0.75)')}, {_r(f'max({x})')}, NULL, NULL, NULL, NULL")
        else:
            num = ("NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, "
                   f"CAST(min(length({c})) AS INTEGER), CAST(max(length({c})) AS INTEGER)")
        parts.append(f"SELECT '{c}', '{t}', CAST(count({c}) AS BIGINT), CAST(count(*) - count({c}) AS BIGINT), {num} FROM fx_gap")
    cols = ("column_name, data_type, n, nulls, min, q1, median, mean, q3, max, n_true, n_false, "
            "min_length, max_length")
    body = _union(parts)
    return (_with("fx_gap") + f"SELECT * FROM ({body}) AS s({cols})")


def _sql_preprocess() -> str:
    """F1 on fx_gap: nulls filled, dummies made, (nearly) constant columns left out, scaled. ``mostly_null`` stays: filled
    with its mean, it has more than 10 % distinct values over the rows with a price."""
    raw = {"id": "CAST(id AS DOUBLE)",
           "mostly_null": "coalesce(CAST(mostly_null AS DOUBLE), (SELECT avg(CAST(mostly_null AS DOUBLE)) FROM kept))",
           "price_copy": "price_copy", "cust": "CAST(cust AS DOUBLE)"}
    for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        name = "priority_" + v.replace("-", "_").replace(" ", "_")
        raw[name] = f"CASE WHEN coalesce(priority, (SELECT v FROM mode)) = '{v}' THEN 1.0 ELSE 0.0 END"
    for v in ("F", "O", "P"):
        raw[f"status_{v}"] = f"CASE WHEN status = '{v}' THEN 1.0 ELSE 0.0 END"
    return (_with("fx_gap") + ", kept AS (SELECT * FROM fx_gap WHERE price IS NOT NULL), "
            "mode AS (SELECT priority AS v FROM kept WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1), "
            "r AS (SELECT price, " + ", ".join(f"{e} AS {c}" for c, e in raw.items()) + " FROM kept) "
            "SELECT " + _r("price") + " AS price, "
            + ", ".join(_r(f"({c} - (SELECT avg({c}) FROM r)) / (SELECT stddev_samp({c}) FROM r)") + f" AS {c}" for c in raw) + " FROM r")


def oracle_sql() -> dict[str, str]:
    gap = _with("fx_gap")
    reg = _with("fx_reg")
    q = {}
    q["profile_lineitem"] = _sql_profile()
    q["shape_fx_gap"] = gap + (
        "SELECT 'original' AS \"table\", CAST(count(*) AS BIGINT) AS n_rows, CAST(9 AS BIGINT) AS n_cols FROM fx_gap "
        "UNION ALL SELECT 'cleaned', CAST(count(*) AS BIGINT), CAST(8 AS BIGINT) FROM fx_gap WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in FX_GAP_COLS if c != "mostly_null"))
    q["null_counts_fx_gap"] = gap + _union(
        [f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM fx_gap" for c in FX_GAP_COLS])
    q["null_fraction_fx_gap"] = gap + _union(
        [f"SELECT '{c}' AS column_name, {_r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_fraction FROM fx_gap"
         for c in FX_GAP_COLS])
    q["duplicate_count_fx_dup"] = _with("fx_dup") + (
        "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_dup)) AS BIGINT) AS duplicate_count FROM fx_dup")
    q["summary_fx_gap"] = _sql_summary()
    q["quantiles_events"] = _union(
        [f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, {_r(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS value FROM events"
         for c in ("value", "user_id") for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
    q["distinct_values_priority"] = gap + "SELECT DISTINCT priority FROM fx_gap WHERE priority IS NOT NULL"
    q["column_mean_lineitem"] = _union(
        [f"SELECT '{c}' AS column_name, {_r(f'avg(CAST({c} AS DOUBLE))')} AS mean FROM lineitem" for c in LINEITEM_NUM])
    q["mode_value_priority"] = gap + (
        "SELECT 'priority' AS column_name, v AS mode, n AS mode_count FROM "
        "(SELECT priority AS v, CAST(count(*) AS BIGINT) AS n FROM fx_gap WHERE priority IS NOT NULL GROUP BY 1) "
        "ORDER BY n DESC, v ASC LIMIT 1")
    q["near_zero_variance_fx_gap"] = _sql_nzv()
    q["correlation_lineitem"] = _sql_corr(LINEITEM_NUM, "lineitem")
    kept = ["id", "priority", "status", "price_copy", "cust"]
    # K1 drops mostly_null (60 % null); K2 const_col and near_const; K3 price (FIXTURES.md)
    q["drop_sparse_columns_fx_gap"] = gap + (
        "SELECT id, " + _r("price") + " AS price, const_col, near_const, priority, status, "
        + _r("price_copy") + " AS price_copy, cust FROM fx_gap")
    q["drop_near_zero_variance_fx_gap"] = gap + (
        "SELECT id, " + _r("price") + " AS price, mostly_null, priority, status, " + _r("price_copy")
        + " AS price_copy, cust FROM fx_gap")
    q["drop_correlated_fx_gap"] = gap + "SELECT id, " + _r("price_copy") + " AS price_copy, cust FROM fx_gap"
    q["auto_clean_fx_gap"] = gap + "SELECT id, priority, status, " + _r("price_copy") + " AS price_copy, cust FROM fx_gap"
    q["impute_mean_fx_gap"] = gap + "SELECT " + ", ".join(
        (f"{_r(f'coalesce(CAST({c} AS DOUBLE), (SELECT coalesce(avg(CAST({c} AS DOUBLE)), 0.0) FROM fx_gap))')} AS {c}"
         if c in FX_GAP_NUM else c) for c in FX_GAP_COLS) + " FROM fx_gap"
    mode = ("(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM fx_gap WHERE {c} IS NOT NULL GROUP BY 1) "
            "ORDER BY n DESC, v ASC LIMIT 1)")
    q["impute_mode_fx_gap"] = gap + "SELECT " + ", ".join(
        (f"coalesce({c}, {mode.format(c=c)}) AS {c}" if c not in FX_GAP_NUM
         else (_r(c) + f" AS {c}" if c in ("price", "price_copy") else c)) for c in FX_GAP_COLS) + " FROM fx_gap"
    q["outlier_counts_events"] = _sql_outliers("events", EVENTS_NUM)
    q["remove_outliers_sequential"] = _sql_remove("sequential")
    q["remove_outliers_joint"] = _sql_remove("joint")
    q["drop_columns_orders"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
    day = "CAST(o_orderdate AS VARCHAR) AS o_orderdate"
    q["drop_rows_orders"] = (
        f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {day}, o_orderpriority FROM "
        "(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn NOT IN (1, 5, 7, 15000, 20000)")
    q["select_numeric_lineitem"] = "SELECT " + ", ".join(LINEITEM_NUM) + " FROM lineitem"
    q["select_text_lineitem"] = "SELECT l_returnflag, l_linestatus FROM lineitem"
    q["drop_null_target_fx_gap"] = gap + "SELECT * FROM fx_gap WHERE price IS NOT NULL"
    q["complete_cases_fx_gap"] = gap + "SELECT * FROM fx_gap WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FX_GAP_COLS)
    q["select_model_columns_fx_reg"] = reg + "SELECT y, l_quantity, l_discount, l_tax FROM fx_reg"
    q["preview_orders"] = (
        f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {day}, o_orderpriority FROM orders "
        "WHERE lower(concat_ws(chr(1), o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) "
        "LIKE '%urgent%' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
    q["drop_duplicates_fx_dup"] = _with("fx_dup") + "SELECT DISTINCT * FROM fx_dup"
    q["melt_numeric_events"] = _union(
        [f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM events" for c in EVENTS_NUM])
    q["boxplot_stats_events"] = _sql_box("events", EVENTS_NUM)
    x = "CAST(l_extendedprice AS DOUBLE)"
    q["boxplot_by_returnflag"] = (
        f"SELECT l.l_returnflag, CAST(f.n AS BIGINT) AS n, {_r('f.a')} AS q1, {_r('f.m')} AS median, {_r('f.b')} AS q3, "
        f"{_r(f'min(CASE WHEN {x} >= f.a - 1.5 * (f.b - f.a) THEN {x} END)')} AS lower_whisker, "
        f"{_r(f'max(CASE WHEN {x} <= f.b + 1.5 * (f.b - f.a) THEN {x} END)')} AS upper_whisker, "
        f"CAST(count_if({x} < f.a - 1.5 * (f.b - f.a) OR {x} > f.b + 1.5 * (f.b - f.a)) AS BIGINT) AS outliers "
        f"FROM lineitem l JOIN (SELECT l_returnflag, count(*) AS n, quantile_cont({x}, 0.25) AS a, "
        f"quantile_cont({x}, 0.5) AS m, quantile_cont({x}, 0.75) AS b FROM lineitem GROUP BY 1) f "
        f"ON l.l_returnflag IS NOT DISTINCT FROM f.l_returnflag GROUP BY l.l_returnflag, f.n, f.a, f.m, f.b")
    q["scatter_bins_lineitem"] = (
        "SELECT CAST(least(floor((CAST(l_quantity AS DOUBLE) - s.x0) / ((s.x1 - s.x0) / 20)), 19) AS INTEGER) AS bx, "
        "CAST(least(floor((l_extendedprice - s.y0) / ((s.y1 - s.y0) / 20)), 19) AS INTEGER) AS \"by\", "
        "CAST(count(*) AS BIGINT) AS n FROM lineitem, (SELECT CAST(min(l_quantity) AS DOUBLE) AS x0, "
        "CAST(max(l_quantity) AS DOUBLE) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) s "
        "GROUP BY 1, 2")
    q["line_points_events"] = "SELECT event_id, value FROM events ORDER BY event_id, value"
    q["histogram_events"] = (
        "WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 14 AS w FROM events), "
        "b AS (SELECT CAST(least(greatest(ceil((value - (s.lo - s.w / 2)) / s.w) - 1, 0), 14) AS INTEGER) AS bin, "
        "count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY 1) "
        "SELECT CAST(g.bin AS BIGINT) AS bin, " + _r("(s.lo - s.w / 2) + g.bin * s.w") + " AS x_min, "
        + _r("(s.lo - s.w / 2) + (g.bin + 1) * s.w") + " AS x_max, " + _r("(s.lo - s.w / 2) + (g.bin + 0.5) * s.w")
        + " AS center, CAST(coalesce(b.n, 0) AS BIGINT) AS count FROM range(15) g(bin) CROSS JOIN s "
        "LEFT JOIN b ON b.bin = g.bin")
    q["histogram_width_quantity"] = (
        "WITH s AS (SELECT 5.0 + floor((min(CAST(l_quantity AS DOUBLE)) - 5.0) / 10.0) * 10.0 AS o, "
        "max(CAST(l_quantity AS DOUBLE)) AS hi FROM lineitem), "
        "k AS (SELECT CAST(greatest(ceil((s.hi - s.o) / 10.0), 1) AS INTEGER) AS nb FROM s), "
        "b AS (SELECT CAST(least(greatest(ceil((CAST(l_quantity AS DOUBLE) - s.o) / 10.0) - 1, 0), k.nb - 1) AS INTEGER) AS bin, "
        "count(*) AS n FROM lineitem, s, k GROUP BY 1) "
        "SELECT CAST(g.bin AS BIGINT) AS bin, " + _r("s.o + g.bin * 10.0") + " AS x_min, " + _r("s.o + (g.bin + 1) * 10.0")
        + " AS x_max, " + _r("s.o + (g.bin + 0.5) * 10.0") + " AS center, CAST(coalesce(b.n, 0) AS BIGINT) AS count "
        "FROM s, k, range(k.nb) g(bin) JOIN b ON b.bin = g.bin")
    q["correlation_pairs_lineitem"] = _sql_corr(LINEITEM_NUM, "lineitem", pairs_only=True)
    q["pair_correlations_lineitem"] = _sql_corr(LINEITEM_NUM, "lineitem", pairs_only=True, pairwise=True)
    q["regression_diagnostics_fx_reg"] = reg + (
        "SELECT CAST(count(*) AS BIGINT) AS n, " + _r("c.b0") + " AS intercept, " + _r("c.b1") + " AS slope, "
        + _r("sum((y - c.b0 - c.b1 * l_quantity) * (y - c.b0 - c.b1 * l_quantity))") + " AS rss, "
        + _r("avg(c.b0 + c.b1 * l_quantity)") + " AS mean_predicted FROM fx_reg, "
        "(SELECT regr_intercept(y, l_quantity) AS b0, regr_slope(y, l_quantity) AS b1 FROM fx_reg) c "
        "WHERE y IS NOT NULL AND l_quantity IS NOT NULL GROUP BY c.b0, c.b1")
    p = "((CAST(rn AS DOUBLE) - 0.5) / CAST(cnt + 1 - 2 * 0.5 AS DOUBLE))"
    q["qq_points_events"] = (
        "SELECT CAST(rn AS BIGINT) AS position, " + _r(_sql_qnorm(p)) + " AS theoretical, " + _r("value")
        + " AS sample FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS cnt "
        "FROM events WHERE value IS NOT NULL)")
    z1, z3 = (f"CAST('{qnorm(p)!r}' AS DOUBLE)" for p in (0.25, 0.75))
    q["qq_line_events"] = (
        f"SELECT {_r(f'(b - a) / ({z3} - {z1})')} AS slope, "
        f"{_r(f'a - (b - a) / ({z3} - {z1}) * {z1}')} AS intercept FROM "
        "(SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)")
    q["one_hot_lineitem"] = (
        "SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"CASE WHEN l_returnflag = '{v}' THEN 1.0 ELSE 0.0 END AS l_returnflag_{v}" for v in "ANR") + ", "
        + ", ".join(f"CASE WHEN l_linestatus = '{v}' THEN 1.0 ELSE 0.0 END AS l_linestatus_{v}" for v in "FO")
        + " FROM lineitem")
    q["standardize_lineitem"] = (
        "SELECT l_orderkey, l_linenumber, "
        + _r("(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem)")
        + " AS l_quantity, "
        + _r("(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem)")
        + " AS l_extendedprice FROM lineitem")
    q["fill_score_row_fx_reg"] = reg + (
        "SELECT " + _r("avg(l_quantity)") + " AS l_quantity, " + _r("avg(l_discount)") + " AS l_discount, "
        + _r("avg(l_tax)") + " AS l_tax, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM fx_reg")
    q["align_features_lineitem"] = (
        "SELECT coalesce(CAST(l_discount AS DOUBLE), 0.0) AS l_discount, coalesce(CAST(l_quantity AS DOUBLE), 0.0) AS l_quantity, "
        "0.0 AS l_missing FROM lineitem")
    q["linear_model_fx_reg"] = reg + (
        "SELECT " + _r("regr_intercept(y, l_quantity)") + " AS intercept, " + _r("regr_slope(y, l_quantity)")
        + " AS slope FROM fx_reg")
    fit = "(SELECT regr_intercept(y, l_quantity) AS b0, regr_slope(y, l_quantity) AS b1 FROM fx_reg) c"
    pred = "(c.b0 + c.b1 * l_quantity)"
    q["model_metrics_fx_reg"] = reg + (
        f"SELECT {_r(f'sqrt(avg((y - {pred}) * (y - {pred})))')} AS rmse, "
        f"{_r(f'100.0 * avg(abs(CASE WHEN y = 0 THEN NULL ELSE (y - {pred}) / y END))')} AS mape, "
        f"{_r(f'power(corr({pred}, y), 2)')} AS r_squared, CAST(count_if(y = 0) AS BIGINT) AS n_zero_actual "
        f"FROM fx_reg, {fit}")
    q["mean_model_fx_reg"] = reg + (
        "SELECT " + _r("sqrt(avg((y - m) * (y - m)))") + " AS rmse, "
        + _r("100.0 * avg(abs(CASE WHEN y = 0 THEN NULL ELSE (y - m) / y END))") + " AS mape, "
        "CAST(NULL AS DOUBLE) AS r_squared, CAST(count_if(y = 0) AS BIGINT) AS n_zero_actual "
        "FROM fx_reg, (SELECT avg(y) AS m FROM fx_reg) a")
    gap_txt = "SELECT " + ", ".join(
        ["CAST(id AS INTEGER) AS id", _r("price") + " AS price", "CAST(mostly_null AS INTEGER) AS mostly_null",
         "const_col", "near_const", "priority", "status", _r("price_copy") + " AS price_copy",
         "CAST(cust AS INTEGER) AS cust", "'he said \"' || status || '\", ok' || chr(10) || 'then left' AS said"]) + " FROM fx_gap"
    q["read_table_csv_fx_gap"] = gap + gap_txt
    q["read_table_csv_files_fx_gap"] = gap + gap_txt
    # with one level a part, the slope is that within parts, and a prediction starts at its part's means
    q["sparse_linear_lineitem"] = (
        "WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x, "
        "avg(CAST(l_extendedprice AS DOUBLE)) OVER (PARTITION BY l_partkey) AS my, avg(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_partkey) AS mx "
        "FROM lineitem), s AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM m) "
        "SELECT l_orderkey, l_linenumber, ROUND((my + b * (x - mx)) / y, 6) AS share, ROUND(b, 6) AS slope FROM m, s")
    q["drop_rows_file_order_orders"] = (
        f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {day}, o_orderpriority FROM "
        "(SELECT *, row_number() OVER () AS rn FROM orders) WHERE rn NOT IN (1, 5, 7, 15000, 20000)")
    q["distinct_values_first_seen_orders"] = (
        "SELECT o_orderpriority, min(rn) - 1 AS first_seen FROM (SELECT o_orderpriority, row_number() OVER () AS rn FROM orders) "
        "WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
    q["fill_score_row_file_order_lineitem"] = (
        "SELECT " + _r("avg(l_quantity)") + " AS l_quantity, " + _r("avg(l_discount)") + " AS l_discount, "
        "arg_min(l_returnflag, rn) AS l_returnflag, arg_min(l_linestatus, rn) AS l_linestatus "
        "FROM (SELECT *, row_number() OVER () AS rn FROM lineitem)")
    q["boxplot_by_quantity"] = (
        "SELECT CAST(NULL AS DOUBLE) AS l_quantity, n, q1, median, q3, lower_whisker, upper_whisker, outliers FROM ("
        + _sql_box("lineitem", ["l_extendedprice"]) + ")")
    q["line_buckets_events"] = (
        "WITH s AS (SELECT CAST(min(event_id) AS DOUBLE) AS a, (CAST(max(event_id) AS DOUBLE) - CAST(min(event_id) AS DOUBLE)) / 100 AS w FROM events) "
        "SELECT CAST(least(floor((CAST(event_id AS DOUBLE) - s.a) / s.w), 99) AS INTEGER) AS bucket, "
        "CAST(min(event_id) AS DOUBLE) AS x_min, CAST(max(event_id) AS DOUBLE) AS x_max, " + _r("min(value)") + " AS y_min, "
        + _r("max(value)") + " AS y_max FROM events, s GROUP BY 1")
    nan = _with("fx_nan")
    there = "value IS NOT NULL AND NOT isnan(value)"
    q["null_counts_fx_nan"] = nan + (
        "SELECT 'event_id' AS column_name, CAST(count_if(event_id IS NULL) AS BIGINT) AS null_count FROM fx_nan UNION ALL "
        f"SELECT 'value', CAST(count_if(NOT ({there})) AS BIGINT) FROM fx_nan UNION ALL "
        "SELECT 'mostly_nan', CAST(count_if(mostly_nan IS NULL OR isnan(mostly_nan)) AS BIGINT) FROM fx_nan")
    parts = []
    for c in ("event_id", "value", "mostly_nan"):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, CAST((SELECT count(*) FROM fx_nan) - count(*) AS BIGINT) AS nulls, CAST(count(DISTINCT {x}) AS BIGINT) AS n_distinct, "
            f"{_r(f'min({x})')} AS min, {_r('any_value(f.a)')} AS q1, {_r(f'quantile_cont({x}, 0.5)')} AS median, {_r(f'avg({x})')} AS mean, "
            f"{_r('any_value(f.b)')} AS q3, {_r(f'max({x})')} AS max, "
            f"CAST(count_if({x} < f.a - 1.5 * (f.b - f.a) OR {x} > f.b + 1.5 * (f.b - f.a)) AS BIGINT) AS outliers "
            f"FROM fx_nan, (SELECT quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.75) AS b FROM fx_nan WHERE NOT isnan({x})) f "
            f"WHERE {x} IS NOT NULL AND NOT isnan({x})")
    q["profile_fx_nan"] = nan + _union(parts)
    q["drop_sparse_columns_fx_nan"] = nan + f"SELECT event_id, {_r('value')} AS value FROM fx_nan"
    kinds = ["bigint", "double", "bigint", "int", "int", "string", "string", "double", "bigint"]
    q["column_names_fx_gap"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS data_type" for i, (c, k) in enumerate(zip(FX_GAP_COLS, kinds), 1)])
    q["numeric_columns_fx_gap"] = "SELECT 'id, price, mostly_null, const_col, near_const, price_copy, cust' AS numeric_columns"
    q["empty_guard_orders"] = "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM orders"
    q["validate_target_fx_reg"] = _union([
        f"SELECT '{c}' AS predictor" for c in ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")])
    q["correlated_columns_fx_gap"] = "SELECT 'price' AS column_name"
    q["scatter_points_lineitem"] = "SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem"
    q["plot_sample_members_lineitem"] = "SELECT least(10000, count(*)) AS n, least(10000, count(*)) AS members FROM lineitem"
    q["penalised_models_fx_reg"] = reg + (
        ", m AS (SELECT covar_pop(l_quantity, y) AS c, var_pop(l_quantity) AS v, stddev_samp(y) AS sd, avg(l_quantity) AS mx, avg(y) AS my FROM fx_reg), "
        "b AS (SELECT 'glmnet' AS model, c / (v + 0.001 / sd) AS slope, mx, my FROM m "
        "UNION ALL SELECT 'lasso', sign(c) * greatest(abs(c) - 0.001, 0) / v, mx, my FROM m) "
        "SELECT model, " + _r("my - slope * mx") + " AS intercept, " + _r("slope") + " AS slope FROM b")
    # one cut with penalty 1 and step 0.3: gradients are mean - y, the gain is G^2 / (n + 1) of both sides
    q["boosted_stump_fx_reg"] = reg + (
        ", m AS (SELECT avg(y) AS base, count(*) AS n, sum(y) AS s FROM fx_reg), "
        "v AS (SELECT l_quantity, count(*) AS n, sum(y) AS s FROM fx_reg GROUP BY 1), "
        "w AS (SELECT v.l_quantity, sum(v.n) OVER o AS nl, sum(v.n) OVER o * base - sum(v.s) OVER o AS gl, m.n AS n, m.n * base - m.s AS g, base "
        "FROM v, m WINDOW o AS (ORDER BY v.l_quantity)), "
        "best AS (SELECT * FROM w WHERE nl < n ORDER BY gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) DESC, l_quantity LIMIT 1) "
        "SELECT v.l_quantity, v.n, " + _r("best.base - 0.3 * CASE WHEN v.l_quantity <= best.l_quantity THEN gl / (nl + 1) "
                                          "ELSE (g - gl) / (best.n - nl + 1) END") + " AS prediction FROM v, best")
    four = ["id", "price", "price_copy", "cust"]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    means = ", ".join("(1 + " + " + ".join(f"abs(r{min(i, j)}{max(i, j)})" for j in range(4) if j != i) + f") / 4 AS m{i}" for i in range(4))
    q["correlated_columns_one_pass_fx_gap"] = _with("fx_gap") + (
        ", k AS (SELECT * FROM fx_gap WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in four) + "), "
        "r AS (SELECT " + ", ".join(f"corr({four[i]}, {four[j]}) AS r{i}{j}" for i, j in pairs) + " FROM k), "
        f"m AS (SELECT *, {means} FROM r) "
        "SELECT DISTINCT column_name FROM (" + " UNION ALL ".join(
            f"SELECT CASE WHEN m{j} > m{i} THEN '{four[j]}' ELSE '{four[i]}' END AS column_name FROM m WHERE abs(r{i}{j}) > 0.9" for i, j in pairs) + ")")
    # a repeat is a permutation of the rows' numbers, modulo k: the sizes are those of 0 to n - 1 modulo k
    for name, table, k, repeats in (("fold_sizes_fx_reg", "lineitem", 5, 3), ("fold_sizes_20_by_10", "lineitem", 20, 10),
                                    ("fold_sizes_10_by_10", "orders", 10, 10)):
        q[name] = (f"SELECT CAST(r AS INTEGER) AS rep, CAST(place % {k} AS INTEGER) AS fold, count(*) AS n "
                   f"FROM range({repeats}) a(r), range((SELECT count(*) FROM {table})) b(place) GROUP BY 1, 2")
    # two predictors: the 2 x 2 normal equations of centred sums
    two = reg + (
        ", m AS (SELECT avg(y) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, count(*) AS n FROM fx_reg), "
        "c AS (SELECT any_value(m.n) AS n, any_value(m.y) AS my, any_value(m.a) AS ma, any_value(m.b) AS mb, "
        "sum((l_quantity - m.a) * (l_quantity - m.a)) AS aa, sum((l_discount - m.b) * (l_discount - m.b)) AS bb, "
        "sum((l_quantity - m.a) * (l_discount - m.b)) AS ab, sum((l_quantity - m.a) * (fx_reg.y - m.y)) AS ay, "
        "sum((l_discount - m.b) * (fx_reg.y - m.y)) AS by_, sum((fx_reg.y - m.y) * (fx_reg.y - m.y)) AS yy FROM fx_reg, m), "
        "f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c) ")
    q["residual_points_fx_reg"] = two + (
        "SELECT " + _r("my + b1 * (l_quantity - ma) + b2 * (l_discount - mb)") + " AS predicted, "
        + _r("y - (my + b1 * (l_quantity - ma) + b2 * (l_discount - mb))") + " AS residual FROM fx_reg, f")
    q["variable_importance_fx_reg"] = two + (
        ", t AS (SELECT abs(b1) / sqrt(bb) AS t1, abs(b2) / sqrt(aa) AS t2 FROM f) "  # the residual variance is common
        "SELECT 'l_quantity' AS variable, CASE WHEN t1 > t2 THEN 100.0 ELSE 0.0 END AS importance FROM t UNION ALL "
        "SELECT 'l_discount', CASE WHEN t2 > t1 THEN 100.0 ELSE 0.0 END FROM t")
    q["qq_residuals_fx_reg"] = reg + (
        ", r AS (SELECT y - c.b0 - c.b1 * l_quantity AS e FROM fx_reg, "
        "(SELECT regr_intercept(y, l_quantity) AS b0, regr_slope(y, l_quantity) AS b1 FROM fx_reg) c) "
        "SELECT CAST(rn AS BIGINT) AS position, ROUND(CAST(" + _sql_qnorm(p) + " AS DOUBLE), 5) AS theoretical, ROUND(e, 5) AS sample "
        "FROM (SELECT e, row_number() OVER (ORDER BY e) AS rn, count(*) OVER () AS cnt FROM r)")
    q["predict_fx_reg"] = reg + f"SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, {_r(pred)} AS prediction FROM fx_reg, {fit}"
    measures = (f"{_r(f'sqrt(avg((y - {pred}) * (y - {pred})))')} AS rmse, "
                f"{_r(f'100.0 * avg(abs(CASE WHEN y = 0 THEN NULL ELSE (y - {pred}) / y END))')} AS mape, "
                f"{_r(f'power(corr({pred}, y), 2)')} AS r_squared")
    q["best_model_fx_reg"] = reg + (
        f"SELECT 'lm' AS model, {measures}, CAST(count_if(y = 0) AS BIGINT) AS n_zero_actual FROM fx_reg, {fit}")
    flat = (f"{_r('sqrt(avg((y - a.m) * (y - a.m)))')} AS rmse, "
            f"{_r('100.0 * avg(abs(CASE WHEN y = 0 THEN NULL ELSE (y - a.m) / y END))')} AS mape")
    q["metrics_long_fx_reg"] = reg + (
        f", l AS (SELECT {measures} FROM fx_reg, {fit}), k AS (SELECT {flat} FROM fx_reg, (SELECT avg(y) AS m FROM fx_reg) a) "
        + _union([f"SELECT 'lm' AS model, '{m}' AS metric, {m} AS value FROM l" for m in ("rmse", "mape", "r_squared")]
                 + [f"SELECT 'mean', '{m}', {m} FROM k" for m in ("rmse", "mape")]))
    q["density_curve_events"] = (
        "WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, "
        "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), "
        "b AS (SELECT n, lo, hi, 0.9 * least(sd, (q3 - q1) / 1.34) * power(n, -0.2) AS bw FROM s), "
        "g AS (SELECT n, bw, lo - 3 * bw AS a, ((hi + 3 * bw) - (lo - 3 * bw)) / 2048 AS w FROM b), "
        "k AS (SELECT least(floor((value - g.a) / g.w), 2047) AS k, count(*) AS c FROM events, g WHERE value IS NOT NULL GROUP BY 1) "
        "SELECT " + _r("any_value(g.a + g.w * 2048 * i / 511)") + " AS x, "
        + _r("sum(c * exp(-0.5 * power((g.a + g.w * 2048 * i / 511 - (g.a + (k.k + 0.5) * g.w)) / g.bw, 2))) "
             "/ (any_value(g.n) * any_value(g.bw) * sqrt(2 * pi()))")
        + " AS density FROM range(512) t(i), k, g GROUP BY i")
    q["preprocess_fx_gap"] = _sql_preprocess()
    q["normalize_names_lineitem"] = (
        "SELECT l_quantity AS qty__units_, l_discount AS X2nd_discount, l_tax AS qty__units__1 FROM lineitem")
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        q["pipeline"] = corpus_pipeline.ORACLE_SQL
    return q | LLM_ORACLES
