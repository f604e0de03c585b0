import numpy as np
import pytest

from tabwise.plans import models as M
from tabwise.plans import trees as T


def _table(spark, n=400, p=3, seed=1, levels=12, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, p)).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 5, 7.0, 0.0) * (x[:, 2] > 3) + rng.normal(size=n)
    names = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y double")
    return df.repartition(parts), names, x, y


def _grow(x, y, rate, l2, least, depth):
    """Brute force: the value of each row under one exact second-order tree (gradients from the mean)."""
    out = np.full(len(y), y.mean())
    g = y.mean() - y

    def worth(at):
        return g[at].sum() ** 2 / (len(at) + l2)

    def node(at, level):
        best = (1e-9, None)
        if level < depth:
            for f in range(x.shape[1]):
                for c in np.unique(x[at, f])[:-1]:
                    left, right = at[x[at, f] <= c], at[x[at, f] > c]
                    if min(len(left), len(right)) >= least:
                        gain = worth(left) + worth(right) - worth(at)
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, (left, right))
        if best[1] is None:
            out[at] -= rate * g[at].sum() / (len(at) + l2)
        else:
            node(best[1][0], level + 1), node(best[1][1], level + 1)

    node(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("l2, least, depth", [(1.0, 1.0, 6), (0.0, 10.0, 3)])
def test_one_tree_equals_exact_search(spark, l2, least, depth):
    df, names, x, y = _table(spark)
    with T.packed(df, names, "y", [], 0) as blocks:
        model = T.boost(blocks, 1, depth, 0.3, l2, least)
    assert model.predict(x) == pytest.approx(_grow(x, y, 0.3, l2, least, depth), abs=1e-9)


def test_rounds_carry_their_margins(spark, monkeypatch):
    monkeypatch.setattr(T, "REFRESH", 2)
    monkeypatch.setattr(T, "CUT", 2)
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    df, names, x, y = _table(spark)
    with T.packed(df, names, "y", [], 0) as blocks:
        model = T.boost(blocks, 9, 3, 0.3, 1.0, 1.0)
    want = np.full(len(y), y.mean())
    for _ in range(9):
        want = want + _tree_of(x, y - want)
    assert model.predict(x) == pytest.approx(want, abs=1e-7)


def _tree_of(x, rest):
    """One tree of depth 3 on gradients -rest, without a mean of its own."""
    out = np.zeros(len(rest))

    def node(at, level):
        def worth(a):
            return rest[a].sum() ** 2 / (len(a) + 1.0)

        best = (1e-9, None)
        if level < 3:
            for f in range(x.shape[1]):
                for c in np.unique(x[at, f])[:-1]:
                    left, right = at[x[at, f] <= c], at[x[at, f] > c]
                    gain = worth(left) + worth(right) - worth(at)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (left, right))
        if best[1] is None:
            out[at] = 0.3 * rest[at].sum() / (len(at) + 1.0)
        else:
            node(best[1][0], level + 1), node(best[1][1], level + 1)

    node(np.arange(len(rest)), 0)
    return out


def test_folds_share_passes_and_equal_separate_fits(spark):
    df, names, x, y = _table(spark, n=300)
    kept = M.with_folds(df.persist(), 3, 2).persist()
    pdf = kept.toPandas()
    with T.packed(kept, names, "y", M.fold_names(2), 3) as blocks:
        model = T.boost(blocks, 5, 3, 0.3, 1.0, 1.0)
    assert len(model.held_out) == 6
    for (r, f), got in zip([(r, f) for r in range(2) for f in range(3)], model.held_out):
        held = pdf[f"{M.FOLD}{r}"] == f
        with T.packed(spark.createDataFrame(pdf[~held]), names, "y", [], 0) as blocks:
            alone = T.boost(blocks, 5, 3, 0.3, 1.0, 1.0)
        err = alone.predict(pdf.loc[held, names].to_numpy()) - pdf.y[held]
        assert got == pytest.approx(float(np.sqrt(np.mean(err ** 2))), rel=1e-9)


def test_boosted_models_in_a_comparison(spark):
    df, names, x, y = _table(spark, n=600)
    for name in ("gbm", "xgbTree"):
        fit = M.fit_boosted(df, names, "y", name, cv="cv", k=4, rounds=30)
        got = fit.predict(df, keep=["y"]).toPandas()
        assert 0.5 < fit.cv_rmse < 3 and np.sqrt(np.mean((got.prediction - got.y) ** 2)) < fit.cv_rmse
        assert max(fit.importance, key=fit.importance.get) == "f0"


def test_constant_features_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 2.0, 7.0)], "a double, b double, y double")
    with T.packed(df, ["a", "b"], "y", [], 0) as blocks:
        model = T.boost(blocks, 3, 2, 0.3, 1.0, 1.0)
    assert model.predict(np.array([[1.0, 2.0], [9.0, -1.0]])) == pytest.approx([6.0, 6.0])


def test_bundles_hold_the_histograms_of_their_features():
    rng = np.random.default_rng(4)
    widths = [50, 2, 300, 11, 2, 9, 1]
    codes = np.stack([rng.integers(0, min(w, 256), 5_000) for w in widths], 1).astype(np.uint8)
    dealt, node, grad = T.bundles(widths), rng.integers(0, 4, 5_000), rng.normal(size=5_000)
    assert sorted(f for mine in dealt for f in mine) == list(range(7)) and len(dealt) < 5
    assert all(len(mine) == 1 or np.prod([widths[f] for f in mine]) <= T.JOINT for mine in dealt)
    joint, out = T.joint_codes(codes, widths, dealt), np.zeros((4, sum(widths)))
    sizes = [int(np.prod([widths[f] for f in mine])) for mine in dealt]
    T.marginal([np.bincount(node * s + j, grad, 4 * s) for j, s in zip(joint, sizes)], widths, dealt, out)
    starts = np.cumsum([0, *widths])
    for f, w in enumerate(widths):
        want = np.bincount(node * w + codes[:, f], grad, 4 * w).reshape(4, w)
        assert out[:, starts[f]:starts[f] + w] == pytest.approx(want, abs=1e-9)
    tree = T.LevelTree.empty(3)
    tree.feature[:], tree.cut[:] = [0, 2, 5, 3, 1, 4, 6], [20, 100, 4, 5, 0, 255, 255]
    out = rng.random(5_000) < 0.2
    got = T.Sides(tree, 3, widths, dealt).place(joint, out.astype(np.int64), np.empty(5_000, np.int64))
    assert (got == np.where(out, 8, tree.place(codes, 3))).all()


def test_a_level_is_the_only_job(spark):
    """The carried margins are made by the first pass of a round, not by a job of their own."""
    df, names, x, y = _table(spark)
    sc = spark.sparkContext
    with T.packed(df, names, "y", [], 0) as blocks:
        sc.setJobGroup("boost", "")
        try:
            T.boost(blocks, 8, 2, 0.3, 1.0, 1.0)
            assert len(sc.statusTracker().getJobIdsForGroup("boost")) <= 1 + 8 * 2
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)


def test_rows_of_equal_bins_are_one_cell(spark):
    """Cells are as many as there are combinations of bins, and their sums those of the rows outside each fold."""
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(v)) for a, b, v in zip(rng.integers(0, 5, 3_000), rng.integers(0, 3, 3_000), rng.normal(size=3_000))]
    df = M.with_folds(spark.createDataFrame(rows, "a double, b double, y double").repartition(2).persist(), 3, 1).persist()
    with T.packed(df, ["a", "b"], "y", M.fold_names(1), 3) as blocks:
        held, folds = blocks.rdd.collect(), blocks.folds
    for r in held:
        assert r.cells == 15
        g = r.grouped()
        assert len(g.y) == 45 and g.n.sum() == len(r.y) and (g.y.sum(), g.n.sum()) == pytest.approx((r.y.sum(), r.n.sum()))
        for m, ((n, y), (n2, y2)) in enumerate(zip(r.sums(folds, 3), g.sums(folds, 3), strict=True)):
            mine = np.ones(len(r.y), bool) if m == 0 else r.folds[:, 0] != m - 1
            assert np.array_equal(n, np.bincount(r.cell[mine], minlength=15)) and np.array_equal(n, n2)
            assert y == pytest.approx(np.bincount(r.cell[mine], r.y[mine], 15)) and y2 == pytest.approx(y)
        assert g.spread.sum() == pytest.approx(sum(((r.y[at] - r.y[at].mean()) ** 2).sum() for c in range(15) for f in range(3)
                                                   for at in (np.flatnonzero((r.cell == c) & (r.folds[:, 0] == f)),)))
