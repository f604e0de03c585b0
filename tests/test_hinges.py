import numpy as np
import pytest

from tabwise.plans import hinges as H
from tabwise.plans import models as M


def _table(spark, x, y, parts=3):
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y double")
    return df.repartition(parts), names


def _brute(x, y, pairs, threshold):
    """Forward selection by a least-squares fit for every feature and value."""
    cols, terms, tss = [np.ones(len(y))], [], ((y - y.mean()) ** 2).sum()

    def rss(c):
        a = np.stack(c, 1)
        return float(((y - a @ np.linalg.lstsq(a, y, rcond=1e-10)[0]) ** 2).sum())

    now = rss(cols)
    for _ in range(pairs):
        best = (0.0, None)
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                gain = now - rss([*cols, np.maximum(0, x[:, f] - t), np.maximum(0, t - x[:, f])])
                if gain > best[0] * (1 + 1e-7):
                    best = (gain, (f, t))
        if best[1] is None or best[0] < threshold * tss:
            break
        f, t = best[1]
        cols += [np.maximum(0, x[:, f] - t), np.maximum(0, t - x[:, f])]
        terms += [(f, t, 1.0)] + ([(f, t, -1.0)] if t > x[:, f].min() else [])
        now -= best[0]
    return terms


def test_forward_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(50, 9, 240), rng.integers(0, 12, 240), rng.uniform(1e6, 2e6, 240)], 1)
    y = 1e5 + 3 * np.maximum(0, x[:, 0] - x[17, 0]) - 2 * np.maximum(0, 5 - x[:, 1]) + 1e-5 * x[:, 2] + rng.normal(0, 0.5, 240)
    df, names = _table(spark, x, y)
    with H.ordered_blocks(df, names, "y", []) as (blocks, scale):
        model = H.forward(blocks, scale, 3, [], 0, 5, 1e-5)[0]
    assert model.terms == _brute(x, y, 5, 1e-5) and len(model.terms) >= 6


def test_planted_knot_is_found_exactly(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2))
    knot = float(np.sort(x[:, 1])[613])
    y = 4 * np.maximum(0, x[:, 1] - knot)
    df, names = _table(spark, x, y)
    fit = M.fit_hinge(df, names, "y", cv="cv", k=4)
    assert f"h(f1,{knot},1)" in fit.coef and fit.coef[f"h(f1,{knot},1)"] == pytest.approx(4, abs=1e-6)
    assert fit.cv_rmse < 0.01  # the fold that holds the knot's own row takes a neighbour
    assert max(fit.importance, key=fit.importance.get) == "f1"


def test_folds_choose_their_own_hinges(spark):
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(0, 40, 300), rng.normal(size=300)], 1)
    y = np.abs(x[:, 0] - 21) + rng.normal(0, 0.3, 300)
    df, names = _table(spark, x, y)
    kept = M.with_folds(df.persist(), 3, 2).persist()
    folds = [(r, f) for r in range(2) for f in range(3)]
    with H.ordered_blocks(kept, names, "y", M.fold_names(2)) as (blocks, scale):
        models = H.forward(blocks, scale, 2, folds, 2, 4, 1e-3)
    rows = kept.toPandas()
    for m in models:
        train = rows if m.held is None else rows[rows[f"{M.FOLD}{m.held[0]}"] != m.held[1]]
        assert m.terms == _brute(train[names].to_numpy(), train["y"].to_numpy(), 4, 1e-3)
    fit = M.fit_hinge(kept, names, "y", cv="repeatedcv", k=3, repeats=2)
    assert 0.2 < fit.cv_rmse < 0.6


def test_hot_values_constant_columns_and_few_rows(spark):
    x = np.zeros((300, 2))
    x[200:, 0] = np.arange(100)  # two thirds of the rows share one value
    y = np.maximum(0, x[:, 0] - 40)
    df, names = _table(spark, x, y, parts=4)
    fit = M.fit_hinge(df, names, "y")
    assert "h(f0,40.0,1)" in fit.coef
    got = fit.predict(df, keep=["f0", "y"]).toPandas()
    assert got["prediction"].to_numpy() == pytest.approx(got["y"].to_numpy(), abs=1e-6)
    flat = M.fit_hinge(df.selectExpr("f1", "1.0D AS y"), ["f1"], "y")
    assert flat.params["mean"] == 1.0


def test_features_of_two_values_and_straight_lines(spark):
    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, 2, 300) * 1.3 - 0.4, rng.integers(0, 2, 300), rng.integers(0, 30, 300)], 1)
    y = 20 * x[:, 0] - 7 * x[:, 1] + 2 * x[:, 2] + 5
    df, names = _table(spark, x, y)
    with H.ordered_blocks(df, names, "y", []) as (blocks, scale):
        model = H.forward(blocks, scale, 3, [], 0, 6, 1e-3)[0]
    assert model.terms == _brute(x, y, 6, 1e-3)
    fit = M.fit_hinge(df, names, "y", cv="cv", k=4)
    assert fit.cv_rmse < 1e-6
