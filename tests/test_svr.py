import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.plans import evaluate as V
from tabwise.plans import models as M
from tabwise.plans.svr import SMOOTHING, fit_machine, tube_loss


def _table(spark, n=500, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 4 * np.sin(x[:, 0]) + x[:, 1] + rng.normal(size=n) * 0.3
    y[:10] += 40  # outliers, which a squared loss would follow
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, noise double, y double"), x, y


def test_solution_is_optimal(spark):
    """No solution is better: the dual value of the multipliers that belong to the coefficients bounds the objective from below."""
    df, x, y = _table(spark)
    w, b = M.fourier_features(3, 0.1, 40, 7)
    m = fit_machine(df.repartition(3), ["a", "b", "noise"], "y", w, b, 1.0, 0.1, [], 0)
    z = np.sqrt(2 / 40) * np.cos(x @ w.T + b)
    sd, t = y.std(ddof=1), (y - y.mean()) / y.std(ddof=1)
    coef, intercept = m.weights / sd / np.sqrt(2 / 40), (m.intercept - y.mean()) / sd
    r = z @ coef + intercept - t
    primal = coef @ coef / 2 + np.maximum(np.abs(r) - 0.1, 0).sum()
    alpha = -tube_loss(r, 0.1, SMOOTHING[-1])[1]
    low, high = -2.0, 2.0  # the intercept's condition is that they sum to zero: shifted until they do
    for _ in range(60):
        shift = (low + high) / 2
        low, high = (shift, high) if np.clip(alpha - shift, -1, 1).sum() > 0 else (low, shift)
    alpha = np.clip(alpha - low, -1, 1)
    v = z.T @ alpha
    dual = alpha @ t - 0.1 * np.abs(alpha).sum() - v @ v / 2
    assert abs(alpha.sum()) < 1e-6
    assert 0 <= primal - dual < 0.01 * primal
    rng = np.random.default_rng(3)
    for _ in range(200):  # and none nearby is
        c = coef + rng.normal(size=40) * 0.02
        d = intercept + rng.normal() * 0.02
        assert c @ c / 2 + np.maximum(np.abs(z @ c + d - t) - 0.1, 0).sum() > primal - 0.05


def test_folds_equal_separate_fits(spark):
    df, x, y = _table(spark, n=200)
    feats = ["a", "b", "noise"]
    kept = M.with_folds(df.persist(), 3, 1).persist()
    fit = M.fit_svr(kept, feats, "y", components=20, cv="cv", k=3)
    pdf, want = kept.toPandas(), []
    for f in range(3):
        held = pdf[f"{M.FOLD}0"] == f
        alone = M.fit_svr(spark.createDataFrame(pdf[~held]), feats, "y", components=20, cv="none")
        got = alone.predict(spark.createDataFrame(pdf[held]), keep=["y"]).toPandas()
        want.append(np.sqrt(np.mean((got.prediction - got.y) ** 2)))
    assert fit.cv_rmse == pytest.approx(np.mean(want), rel=5e-3)
    assert M.fit_rbf_ridge(kept, feats, "y", cv="none").params["components"] == 100


def test_importance_of_a_kernel_model(spark):
    df, x, y = _table(spark)
    res = V.compare_models(df, "y", models=["svmRadial", "earth"], cv="none")
    for name in ("svmRadial", "earth"):
        gain = V.permutation_importance(res.fitted[name], res.prepared, "y")
        assert set(gain) == {"a", "b", "noise"} and gain["noise"] < 0.05 * gain["a"] and gain["b"] > gain["noise"]
    table = V.variable_importance(res.fitted["svmRadial"], prepared=res.prepared, label="y").collect()
    assert [r["variable"] for r in table] == ["a", "b", "noise"] and table[0]["importance"] == 100.0
    assert V.variable_importance(res.fitted["svmRadial"]).isEmpty()


def test_permuted_values_are_the_columns_own(spark):
    """A model that returns one feature has, after the deal, the error of a random pairing."""
    df = spark.range(2_000).select(F.col("id").cast("double").alias("u"), (F.col("id") % 7).cast("double").alias("v"),
                                   F.col("id").cast("double").alias("y"))
    fit = M.Fitted("lm", ["u", "v"], expr=F.col("u"))
    gain = V.permutation_importance(fit, df, "y")
    assert gain["v"] == 0.0 and gain["u"] == pytest.approx(2_000 / np.sqrt(6), rel=0.06)


def test_passes_read_packed_rows(spark):
    """What the rows are made by (here the folds) is not run again in each pass."""
    df, x, y = _table(spark, n=300)
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def fold(v):
        made.add(len(v))
        return (v * 0 + np.arange(len(v)) % 3).astype("int64")

    w, b = M.fourier_features(3, 0.1, 20, 7)
    m = fit_machine(df.repartition(2).withColumn("f", fold("a")), ["a", "b", "noise"], "y", w, b, 1.0, 0.1, ["f"], 3)
    assert m.passes > 10 and len(m.held_out) == 3 and 300 <= made.value <= 600


def test_each_value_is_dealt_once(spark, monkeypatch):
    """Values sent to ranges of numbers, in pieces, are those that the permutation of each feature sends; nulls go along."""
    from tabwise.functions.permute import permuted
    from tabwise.functions.positions import numbered

    monkeypatch.setattr(V, "_range_rows", lambda n, p: 17)
    rows = [(float(i), None if i % 5 == 0 else float(i % 7), float(i)) for i in range(200)]
    kept = spark.createDataFrame(rows, "_y double, _x0 double, _x1 double").repartition(3).persist()
    table, n = numbered(kept)
    there = V._dealt(V.with_permutations(table, "_number", n, {"_to0": 42, "_to1": 43}), 2, V._range_rows(n, 2))
    got = {r["_y"]: r for r in there.collect()}
    of = {r["_number"]: r for r in table.collect()}
    assert len(got) == n == 200
    for i, key in enumerate((42, 43)):
        to = permuted(np.arange(n), n, key)
        for number in range(n):
            assert got[of[int(to[number])]["_y"]][f"_v{i}"] == of[number][f"_x{i}"]
    assert all(got[r["_y"]]["_x0"] == r["_x0"] for r in of.values())
    kept.unpersist()


def test_equal_rows_are_counted(spark):
    """Rows that come often are one pair of predictors and label, and the machine is that of all rows."""
    from tabwise.plans import svr

    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a + b + e)) for a, b, e in zip(*(rng.integers(0, n, 4_000) for n in (4, 3, 2)))]
    df = M.with_folds(spark.createDataFrame(rows, "a double, b double, y double").repartition(3).persist(), 3, 1).persist()
    with svr.packed_rows(df, ["a", "b"], "y", M.fold_names(1)) as blocks:
        got = blocks.map(lambda b: (len(b.y), len(b.n), float(b.n.sum()))).collect()
    assert sum(g[0] for g in got) == len(set(rows)) and sum(g[1] for g in got) <= 3 * len(set(rows)) and sum(g[2] for g in got) == 4_000
    w, b = M.fourier_features(2, 0.1, 10, 7)
    m = fit_machine(df, ["a", "b"], "y", w, b, 1.0, 0.1, M.fold_names(1), 3)
    pdf = df.toPandas()
    z = np.cos(pdf[["a", "b"]].to_numpy() @ w.T + b)
    assert len(m.held_out) == 3 and np.sqrt(np.mean((z @ m.weights + m.intercept - pdf.y) ** 2)) == pytest.approx(np.mean(m.held_out), rel=0.02)
