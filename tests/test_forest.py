import numpy as np
import pytest

from tabwise.plans import evaluate as V
from tabwise.plans import forest as R
from tabwise.plans import models as M


def _table(spark, n=500, p=4, seed=3, levels=15, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, p)).astype(float)
    y = 100 + 5 * x[:, 0] + np.where(x[:, 1] > 6, 9.0, 0.0) * (x[:, 2] > 4) + rng.normal(size=n)
    names = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y double")
    return df.repartition(parts), names, x, y


def _brute(x, y, w, mtry, least, path, at, depth=None):
    """The prediction of each row of one tree by exact search, a node at a time."""
    out = np.zeros(len(y))

    def sse(rows):
        m = np.average(y[rows], weights=w[rows])
        return float((w[rows] * (y[rows] - m) ** 2).sum())

    def node(rows, path, level, every):
        mine = rows[w[rows] > 0]
        best = (1e-9 * sse(mine), None)
        if w[mine].sum() > least and (depth is None or level < depth):
            for f in R.drawn(np.array([path], np.uint64), x.shape[1], mtry)[0]:
                for c in np.unique(x[mine, f])[:-1]:
                    gain = sse(mine) - sse(mine[x[mine, f] <= c]) - sse(mine[x[mine, f] > c])
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, c))
        if best[1] is None:
            out[every] = np.average(y[mine], weights=w[mine])
            return
        f, c = best[1]
        go = R.child_paths(np.array([path], np.uint64))
        for side, keep in ((0, lambda r: r[x[r, f] <= c]), (1, lambda r: r[x[r, f] > c])):
            node(keep(mine), go[side], level + 1, keep(every))

    node(at, path, 0, at)
    return out


@pytest.mark.parametrize("mtry, least, depth", [(2, 5, None), (4, 1, None), (1, 5, 3)])
def test_a_subtree_equals_exact_search(mtry, least, depth):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 30, (400, 4))
    y = 1e4 + x[:, 0] * 2.5 + (x[:, 1] > 11) * x[:, 2] + rng.normal(size=400)
    w = rng.poisson(1.0, 400).astype(np.uint8)
    at = np.flatnonzero(w)
    path = R.root_path(7, 0)
    tree, gain = R.grow(x[at].astype(np.uint8), y[at], w[at], mtry, least, path, depth)
    codes = x.astype(np.uint8)
    assert tree.value[tree.place(codes)] == pytest.approx(_brute(x, y, w, mtry, least, path[0], np.arange(400), depth), abs=1e-7)
    assert gain.shape == (4,) and gain.sum() > 0


@pytest.mark.parametrize("hand_off", [None, 60])
def test_forest_equals_exact_search(spark, hand_off, monkeypatch):
    """Whole trees in a task, and trees whose upper levels come from histograms, give the same forest."""
    monkeypatch.setattr(R, "NODES", 3)
    df, names, x, y = _table(spark, parts=1)
    kept = df.persist()
    got = R.fit_forest(kept, names, "y", trees=3, mtry=2, seed=5, hand_off=hand_off)
    rows = kept.toPandas()
    x, y = rows[names].to_numpy(), rows["y"].to_numpy()
    want = np.zeros(len(y))
    for t in range(3):
        w = R.weights_of(5, t, 0, len(y))
        want += _brute(x, y, w, 2, 5, R.root_path(5, t)[0], np.arange(len(y))) / 3
    out = got.score(kept, ["y", *names], "prediction").toPandas().sort_values(["y", *names])
    order = rows.assign(want=want).sort_values(["y", *names])
    assert out["prediction"].to_numpy() == pytest.approx(order["want"].to_numpy(), abs=1e-7)
    if hand_off:
        assert all(len(handed) > 1 for _, handed in got.uppers)
    kept.unpersist()


def test_groups_of_trees_do_not_matter(spark, monkeypatch):
    df, names, *_ = _table(spark)
    kept = df.persist()
    whole = R.fit_forest(kept, names, "y", trees=5, mtry=2)
    monkeypatch.setattr(R, "GROUP_ROWS", 1000)
    parts = R.fit_forest(kept, names, "y", trees=5, mtry=2)
    a, b = (sorted(map(tuple, f.score(kept, ["y"], "s").collect())) for f in (whole, parts))
    assert a == pytest.approx(b) if not a else all(x == pytest.approx(y) for x, y in zip(a, b))
    assert whole.gain == pytest.approx(parts.gain)
    kept.unpersist()


def test_forest_in_a_comparison(spark):
    df, *_ = _table(spark, n=900)
    res = V.compare_models(df, "y", models=["rf", "mean"], cv="cv", k=3, num_trees=40)
    got = {r["model"]: r for r in res.metrics.collect()}
    assert res.best == "rf" and got["rf"]["error"] is None
    assert got["rf"]["rmse"] < got["rf"]["cv_rmse"] < got["mean"]["cv_rmse"] / 2
    imp = res.fitted["rf"].importance
    assert max(imp, key=imp.get) == "f0"
    assert res.predict(df, "rf", keep=["y"]).count() == 900


def test_constant_label_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.5, 2.0, 5.0), (None, 1.0, 9.0)], "a double, b double, y double")
    got = R.fit_forest(df, ["a", "b"], "y", trees=4, mtry=1)
    assert [r["s"] for r in got.score(df.na.drop(), ["a"], "s").collect()] == pytest.approx([5.0, 5.0])
    with pytest.raises(ValueError):
        R.fit_forest(df.where("a > 99"), ["a", "b"], "y", trees=1, mtry=1)
    assert M.MODEL_CHOICES[3] == "rf"


def test_pieces_grow_the_same_tree(monkeypatch):
    """Rows dealt out by node, in pieces, give the tree that all rows together give; leaves are reached by columns alike."""
    rng = np.random.default_rng(8)
    codes = np.stack([rng.integers(0, w, 6_000) for w in (200, 30, 2, 2)], 1).astype(np.uint8)
    y, w = 3.0 * codes[:, 0] - codes[:, 1] + rng.normal(size=6_000), rng.poisson(1.0, 6_000) + (np.arange(6_000) % 2)
    at = w > 0
    codes, y, w = codes[at], y[at], w[at].astype(np.uint8)
    whole, gain = R.grow(codes, y, w, 2, 5, R.root_path(1, 1))
    monkeypatch.setattr(R, "PIECE_ROWS", 100)
    monkeypatch.setattr(R, "PIECES", 4)
    pieces, gain_of = R.grow(codes, y, w, 2, 5, R.root_path(1, 1))
    assert len(pieces.left) == len(whole.left) and gain_of == pytest.approx(gain)
    place = pieces.place_columns(np.ascontiguousarray(codes.T))
    assert (pieces.feature[place] == -1).all()
    assert pieces.value[place] == pytest.approx(whole.value[whole.place(codes)], abs=1e-12)


def test_cells_grow_the_tree_of_their_rows():
    """Rows of equal bins, as one cell with weight, mean and sum of squares, give the tree and gains of the rows."""
    from tabwise.functions.counted import groups

    rng = np.random.default_rng(9)
    codes = rng.integers(0, 4, (3_000, 3)).astype(np.uint8)
    y, w = codes @ [3.0, -2.0, 1.0] + rng.normal(size=3_000), rng.integers(1, 4, 3_000)
    first, cell = groups(list(codes.T))
    weight = np.bincount(cell, w)
    mean = np.bincount(cell, w * y) / weight
    spread = np.bincount(cell, w * (y - mean[cell]) ** 2)
    path = R.root_path(42, 1)
    rows, gain = R.grow(codes, y, w, 2, 5, path)
    cells, of_cells = R.grow(codes[first], mean, weight, 2, 5, path, None, spread)
    assert len(first) == 64 and np.array_equal(rows.feature, cells.feature) and np.array_equal(rows.cut, cells.cut)
    assert cells.value == pytest.approx(rows.value) and of_cells == pytest.approx(gain)
