import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.functions.permute import permuted, with_permutations
from tabwise.plans import evaluate as V
from tabwise.plans import models as M
from tabwise.plans.gram import fit_elastic_net, gram_by_group
from tabwise.sources.tables import fixture

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def _reg3(spark, sf=SF):
    reg = fixture(spark, sf, "fx_reg")
    return reg.select("y", "l_quantity", "l_discount",
                      F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("flag_r"))


def test_lm_recovers_fx_reg(spark):
    reg = _reg3(spark)
    fit = M.fit_linear(reg, ["l_quantity", "l_discount", "flag_r"], "y", "lm", cv="none")
    assert fit.coef["l_quantity"] == pytest.approx(3.000767, abs=1e-6)
    assert fit.coef["l_discount"] == pytest.approx(-200.275333, abs=1e-6)
    assert fit.coef["flag_r"] == pytest.approx(49.988843, abs=1e-6)
    m = V.metrics(fit.predict(reg, keep=["y"]), "y").first()
    assert m.r_squared == pytest.approx(0.995958, abs=1e-6)


@pytest.mark.parametrize("alpha", [0.0, 1.0])
@pytest.mark.parametrize("lam", [0.01, 0.5])
def test_ridge_and_lasso_agree_with_sparks_linear_regression(spark, alpha, lam):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    reg = _reg3(spark, SMALL)
    feats = ["l_quantity", "l_discount", "flag_r"]
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(reg)
    want = LinearRegression(labelCol="y", regParam=lam, elasticNetParam=alpha, standardization=False, solver="l-bfgs",
                            tol=1e-12, maxIter=1000).fit(data)
    g = gram_by_group(reg, feats, "y")
    b0, beta = fit_elastic_net(g.moments(g[0]), lam, alpha)
    assert beta == pytest.approx(want.coefficients.toArray(), rel=2e-3, abs=2e-3)
    assert b0 == pytest.approx(want.intercept, rel=2e-3, abs=2e-3)


def test_slopes_keep_their_digits_far_from_zero(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    for far in (1e6, 1e9):
        df = spark.createDataFrame([(float(far + v), float(far + 2 * v)) for v in x], "x double, y double").repartition(3)
        fit = M.fit_linear(df, ["x"], "y", "lm", cv="none")
        assert fit.coef["x"] == pytest.approx(2.0, abs=1e-5)


def _fold_rows(df, k, reps):
    return sorted(map(tuple, M.fold_sizes(df, k, reps).collect()))


@pytest.mark.parametrize("k, reps", [(5, 3), (20, 10), (10, 10), (7, 2)])
def test_every_fold_of_every_repeat_is_balanced(spark, k, reps):
    for rows in (spark.range(10_000), spark.range(9_973).repartition(7), spark.range(0, 300).selectExpr("1 AS x")):
        n = rows.count()
        sizes = _fold_rows(rows, k, reps)
        assert len(sizes) == k * reps  # none is empty
        assert sorted(sizes) == [(r, f, len(range(f, n, k))) for r in range(reps) for f in range(k)]


def test_no_fold_is_skipped(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(a + b)) for a, b in rng.normal(size=(400, 2))], "x double, y double")
    for k, reps in ((10, 10), (20, 10)):
        assert len(list(M._grams(df, ["x"], "y", k, reps).folds())) == k * reps


def test_repeats_are_independent(spark):
    kept = spark.range(4_000).repartition(3).persist()
    pdf = M.with_folds(kept, 5, 6).toPandas()
    assert sorted(pdf.id) == list(range(4_000)) and list(pdf.columns) == ["id", *M.fold_names(6)]
    for a in range(6):
        mine = pdf[f"{M.FOLD}{a}"].to_numpy()
        assert abs(np.mean(mine[1:] == mine[:-1]) - 0.2) < 0.03  # neighbours
        for b in range(a):
            assert abs(np.mean(mine == pdf[f"{M.FOLD}{b}"]) - 0.2) < 0.03
    kept.unpersist()


def test_folds_do_not_shuffle_or_checkpoint_the_table(spark):
    kept = spark.range(1_000).repartition(3).persist()
    plan = M.with_folds(kept, 5, 2)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    kept.unpersist()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 17, 100, 1_009, 4_999])
def test_permutation_is_a_bijection(spark, n):
    got = with_permutations(spark.range(n).withColumn("z", F.col("id")), "id", n, {"p": 5, "q": 6}).collect()
    assert sorted(r["p"] for r in got) == sorted(r["q"] for r in got) == list(range(n))
    assert [r["p"] for r in sorted(got)] == list(permuted(np.arange(n), n, 5)) and all(r["z"] == r["id"] for r in got)


def test_compare_models_ranks_and_scores(spark):
    reg = fixture(spark, SMALL, "fx_reg")
    res = V.compare_models(reg, "y", models=["lm", "glmnet", "lasso", "earth", "rbf_ridge", "svmRadial", "tree", "rf", "nope"],
                           cv="repeatedcv", k=3, repeats=2, num_trees=10)
    rows = {r.model: r for r in res.metrics.collect()}
    assert rows["nope"].rmse is None and "nope" in rows["nope"].error  # defect B5: fixed schema
    for m in ["lm", "glmnet", "lasso", "earth", "rbf_ridge", "svmRadial", "tree", "rf"]:
        assert rows[m].rmse is not None and rows[m].error is None and rows[m].cv_rmse > 0.5 * rows[m].rmse
    assert rows["lm"].r_squared > 0.99
    best = min((r.rmse, i, r.model) for i, r in enumerate(res.metrics.collect()) if r.rmse is not None)[2]
    assert res.best == best
    scored = res.predict(reg.drop("y").limit(5), keep=["l_quantity"])
    assert scored.columns == ["l_quantity", "prediction"] and scored.count() == 5
    imp = V.variable_importance(res.fitted["rf"])
    assert imp.count() <= 15 and imp.agg(F.max("importance")).first()[0] == 100.0
    assert V.model_summary(res.fitted["lasso"]).count() > 3
    wide = M.Fitted("lm", [f"c{i}" for i in range(80)], coef={f"c{i}": float(i) for i in range(80)})
    assert V.model_summary(wide).where("name LIKE 'coef%'").count() == 80


def test_held_out_error_is_that_of_the_folds(spark):
    reg = _reg3(spark, SMALL)
    feats = ["l_quantity", "l_discount", "flag_r"]
    rows = M.with_folds(reg.persist(), 4, 1).persist()
    fit = M.fit_linear(rows, feats, "y", "lm", cv="cv", k=4)
    pdf = rows.toPandas()
    want = []
    for f in range(4):
        hold = pdf[f"{M.FOLD}0"] == f
        z = np.column_stack([np.ones(len(pdf)), pdf[feats].to_numpy()])
        b = np.linalg.lstsq(z[~hold], pdf.y[~hold], rcond=None)[0]
        want.append(np.sqrt(np.mean((pdf.y[hold] - z[hold] @ b) ** 2)))
    assert fit.cv_rmse == pytest.approx(np.mean(want), rel=1e-9)
    tree = M.fit_tree(rows, feats, "y", "tree", cv="cv", k=4)
    assert 0 < tree.cv_rmse < pdf.y.std()


def test_task_routes_the_comparison(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), "ab"[i % 2 if i % 9 else 0], 2.0 * i) for i in range(60)],
                               "x double, w double, c string, y double")
    assert V.compare(df, "y", models=["lm"], cv="none").columns[0:2] == ["model", "rmse"]
    assert [r.model for r in V.compare(df, "c").collect()] == ["logistic", "tree", "rf"]


def test_boosting_runs(spark):
    reg = fixture(spark, SMALL, "fx_reg")
    res = V.compare_models(reg, "y", models=["gbm", "xgbTree"], cv="none")
    assert all(r.rmse is not None for r in res.metrics.collect())


def test_cv_none_uses_first_lambda_defect_b7(spark):
    reg = _reg3(spark, SMALL)
    fit = M.fit_linear(reg, ["l_quantity", "l_discount", "flag_r"], "y", "glmnet", cv="none")
    assert fit.params["lambda"] == M.LAMBDA_GRID[0]


def test_mean_fallback_m9(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (2.0, 1.0, 0.0, 1.0), (5.0, 1.0, 2.0, 3.0),
                                (3.0, 3.0, 3.0, 0.0)], "y double, a double, b double, c double")
    res = V.compare_models(df, "y", models=["lm", "rf"], cv="none")
    preds = res.predict(df, keep=["y"]).collect()
    assert {round(r.prediction, 9) for r in preds} == {2.75}


def test_mape_skips_zero_actuals_defect_b11(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "y double, prediction double")
    m = V.metrics(df, "y").first()
    assert m.mape == pytest.approx(100 * (0.5 + 0.25) / 2)
    assert m.n_zero_actual == 1


def test_best_model_query(spark):
    m = spark.createDataFrame([("lm", 2.0), ("rf", 1.0), ("gbm", 1.0), ("svm", None)], "model string, rmse double")
    assert V.best_model(m, ["lm", "gbm", "rf", "svm"]).first().model == "gbm"


def test_diagnostics_use_all_rows_defect_b8(spark):
    reg = fixture(spark, SMALL, "fx_reg").select("y", "l_quantity", "l_discount")
    pts, coef = V.regression_diagnostics(reg, "y")
    assert pts.count() == reg.count()
    assert pts.agg(F.avg("residual")).first()[0] == pytest.approx(0.0, abs=1e-8)


def test_classifiers(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert M.detect_task(li, "l_returnflag") == "classification"
    assert M.detect_task(li, "l_quantity") == "regression"
    acc = {r.model: r.accuracy for r in M.compare_classifiers(li, "l_returnflag", ["l_quantity", "l_tax"],
                                                               models=("logistic", "tree")).collect()}
    assert all(0.0 <= a <= 1.0 for a in acc.values())


def test_scoring_from_inputs(spark):
    reg = fixture(spark, SMALL, "fx_reg")
    res = V.compare_models(reg, "y", models=["lm"], cv="none")
    low, high = (V.score_inputs(res, reg, "y", {"l_quantity": q, "l_returnflag": "R"}).first() for q in (1, 11))
    assert high["prediction"] - low["prediction"] == pytest.approx(30.0, abs=0.1)
    assert low["l_returnflag"] == "R" and low["l_linestatus"] == "F"  # the smallest value stands for one not given


def test_classifiers_on_prepared_predictors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        c = "abc"[int(rng.integers(3))]
        rows.append((c if i % 50 else None, float("abc".index(c) + rng.normal() * 0.2) if i % 7 else None, {"a": "red", "b": "blue", "c": "blue"}[c] if i % 5 else None))
    df = spark.createDataFrame(rows, "c string, x double, colour string").repartition(3)
    report, table = M.compare_classifiers(df, "c", models=("tree", "logistic"), cv="cv", k=4, confusion=True)
    n = df.where("c IS NOT NULL").count()
    got = {r["model"]: r for r in report.collect()}
    cells = table.where("model = 'tree'").collect()
    assert sum(r["n"] for r in cells) == n and {r["label"] for r in cells} == set("abc")
    assert sum(r["n"] for r in cells if r["label"] == r["predicted"]) / n == pytest.approx(got["tree"]["cv_accuracy"])
    assert got["tree"]["accuracy"] > 0.9 and got["tree"]["cv_accuracy"] > 0.8 and got["logistic"]["error"] is None


def test_class_folds_are_stratified(spark):
    df = spark.range(997).selectExpr("id", "CAST(CASE WHEN id % 10 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS double) AS y").repartition(5)
    kept = df.sortWithinPartitions("y", F.xxhash64("id")).persist()
    got = M.with_class_folds(kept, "y", 4)
    assert sorted(got.columns) == sorted(["id", "y", f"{M.FOLD}0"]) and got.count() == 997
    sizes = got.groupBy("y", f"{M.FOLD}0").count().collect()
    for y in (0.0, 1.0, 2.0):
        mine = [r["count"] for r in sizes if r["y"] == y]
        assert len(mine) == 4 and max(mine) - min(mine) <= 1
    kept.unpersist()


def test_folds_are_kept_with_the_rows(spark):
    """No pass of a training draws the folds again."""
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS y")
    with M.folded(df, 4, 2, 3) as rows:
        assert rows.is_cached
        sizes = [r["count"] for c in M.fold_names(2) for r in rows.groupBy(c).count().collect()]
    assert sizes == [25] * 8 and not rows.is_cached
