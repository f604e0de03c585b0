import numpy as np
import pytest

from tabwise.plans import sparse as P


def _table(spark, n=400, levels=(7, 30), seed=5, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 4, (n, 2))
    g = [rng.integers(0, m, n) for m in levels]
    y = 3 * x[:, 0] - x[:, 1] + g[0] ** 2 + np.sin(g[1]) * 5 + 100 + rng.normal(size=n)
    rows = [(float(a), float(b), f"u{c}", f"v{d}", float(t)) for (a, b), c, d, t in zip(x, *g, y)]
    return spark.createDataFrame(rows, "a double, b double, u string, v string, y double").repartition(parts), x, g, y


def _design(x, g):
    return np.column_stack([np.ones(len(x)), x, *[(c[:, None] == np.unique(c)).astype(float) for c in g]])


def test_equals_ordinary_least_squares(spark):
    df, x, g, y = _table(spark)
    fit = P.fit_sparse(df, "y")
    d = _design(x, g)
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    got = fit.predict(df, keep=["y"]).toPandas().sort_values("y")
    assert got["prediction"].to_numpy() == pytest.approx((d @ beta)[np.argsort(y)], abs=1e-7)
    assert fit.coefficients() == pytest.approx({"a": beta[1], "b": beta[2]}, abs=1e-8)


def test_ridge(spark):
    df, x, g, y = _table(spark)
    fit = P.fit_sparse(df, "y", l2=3.0)
    d = _design(x, g)
    d[:, 1:3] = (x - x.mean(0)) / x.std(0)
    penalty = np.diag([0.0] + [3.0] * (d.shape[1] - 1))
    beta = np.linalg.solve(d.T @ d + penalty, d.T @ y)
    got = fit.predict(df, keep=["y"]).toPandas().sort_values("y")
    assert got["prediction"].to_numpy() == pytest.approx((d @ beta)[np.argsort(y)], abs=1e-7)


def test_a_hundred_thousand_levels(spark):
    df = spark.range(200_000).selectExpr("concat('k', id % 100000) AS g", "CAST(id % 13 AS DOUBLE) AS x",
                                         "CAST(id % 100000 % 977 + 2 * (id % 13) AS DOUBLE) AS y")
    fit = P.fit_sparse(df, "y")
    assert fit.weights.shape == (100_002,) and fit.coefficients()["x"] == pytest.approx(2.0, abs=1e-7)
    worst = fit.predict(df).selectExpr("max(abs(prediction - y)) AS e").first()["e"]
    assert worst < 1e-6


def test_nulls_unseen_levels_clashing_names_and_limits(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, "p", 2.0, 1), (None, "p", 4.0, 2), (3.0, None, 5.0, 3), (float("nan"), "q", 9.0, 4), (2.0, "q", None, 5)],
                               "x double, g string, y double, _c0 int")
    fit = P.fit_sparse(df, "y", ["x", "g"])
    new = spark.createDataFrame([(7, 2.0, "new", 0), (8, None, None, 0)], "_x0 int, x double, g string, _c0 int")
    out = fit.predict(new)
    assert out.columns == ["_x0", "x", "g", "_c0", "prediction"]
    a, b = [r["prediction"] for r in out.orderBy("_x0").collect()]
    assert a == pytest.approx(b) == pytest.approx(fit.weights[0])  # no level, and the mean of x is 2
    with pytest.raises(ValueError):
        P.fit_sparse(df.where("y > 99"), "y")
    monkeypatch.setattr(P, "MOST_LEVELS", 1)
    with pytest.raises(ValueError):
        P.fit_sparse(df, "y", ["g"])


def _by_steps(df, target, features):
    """The same problem with a second category of one level, null throughout: conjugate gradients."""
    from pyspark.sql import functions as F

    return P.fit_sparse(df.withColumn("none", F.lit(None).cast("string")), target, [*features, "none"])


@pytest.mark.parametrize("features, nulls", [(["a", "b", "u"], False), (["a", "b", "v"], True), (["v"], False), (["a", "twice", "same", "u"], True)])
def test_one_category_is_eliminated(spark, features, nulls):
    """The coefficients are those that conjugate gradients reach, also where many solutions predict alike."""
    from pyspark.sql import functions as F

    df, *_ = _table(spark)
    df = df.withColumn("twice", F.col("a") * 2 + 1).withColumn("same", F.length("u").cast("double") + F.ascii(F.col("u").substr(2, 1)))
    if nulls:
        df = df.select(*[F.when(F.col("a") > 14, None).otherwise(F.col(c)).alias(c) if c in "uv" else c for c in df.columns])
    one, steps = P.fit_sparse(df, "y", features), _by_steps(df, "y", features)
    assert one.tail is None and one.steps == 0 and steps.steps > 0
    assert one.head == pytest.approx(steps.head, abs=1e-6)
    by = {r["level"]: r["weight"] for r in one.levels.collect()}
    other = {r["level"]: steps.tail[r["index"]] for r in steps.levels.collect()}
    assert by == pytest.approx(other, abs=1e-6)
    assert one.weights[len(one.head):].sum() == pytest.approx(steps.tail.sum(), abs=1e-5)
    unseen = spark.createDataFrame([("zz", "zz", 1.0, 2.0, 3.0, 60.0)], "u string, v string, a double, b double, twice double, same double")
    assert one.predict(unseen).first()["prediction"] == pytest.approx(steps.predict(unseen.withColumn("none", F.lit("n"))).first()["prediction"], abs=1e-6)


def test_more_levels_than_fit_the_driver(spark, monkeypatch):
    """A single category's levels never reach the driver, so its limit of arrays does not hold for them."""
    monkeypatch.setattr(P, "DRIVER_LEVELS", 10)
    df, x, g, y = _table(spark)
    fit = P.fit_sparse(df, "y", ["a", "b", "v"])
    assert fit.levels.count() == 30
    with pytest.raises(ValueError):
        P.fit_sparse(df, "y", ["a", "u", "v"])
