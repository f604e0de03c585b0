import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.plans import forest as R
from tabwise.plans import models as M
from tabwise.plans import votes as W


def _table(spark, n=900, seed=4, parts=3, times=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 200, n), rng.integers(0, 2, n)], 1).astype(float)
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), (x[:, 0] > 3) + (x[:, 2] > 120) * (x[:, 1] > 1)).astype(float)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)] * times
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(parts), ["a", "b", "c", "d"]


def _brute(columns, y, w, classes, mtry, path, depth):
    """``(cuts, shares)`` of one tree by trying every cut of every node, a cell at a time."""
    def node(rows, path, level):
        stats = np.bincount(y[rows], w[rows], classes)
        best = (1e-9, None)
        if level < depth and stats.sum():
            for f in R.drawn(np.array([path], np.uint64), len(columns), mtry)[0]:
                for c in range(W.BINS - 1):
                    left = columns[f, rows] <= c
                    a, b = (np.bincount(y[rows[m]], w[rows[m]], classes) for m in (left, ~left))
                    if a.sum() and b.sum():
                        gain = (a ** 2).sum() / a.sum() + (b ** 2).sum() / b.sum() - (stats ** 2).sum() / stats.sum()
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (int(f), c, left))
        share = tuple(np.round(stats / max(stats.sum(), 1e-300), 9))
        if best[1] is None:
            return int(stats.argmax()), share
        f, c, left = best[1]
        paths = R.child_paths(np.array([path], np.uint64))
        l, r = node(rows[left], paths[0], level + 1), node(rows[~left], paths[1], level + 1)
        if len(l) == 2 and len(r) == 2 and l[0] == r[0]:  # two leaves of the same class
            return int(stats.argmax()), share
        return f, c, l, r

    return node(np.arange(len(y)), path, 0)


def _shape(tree, at=0):
    if tree.feature[at] < 0:
        return int(tree.value[at].argmax()), tuple(np.round(tree.value[at], 9))
    return int(tree.feature[at]), int(tree.cut[at]), _shape(tree, tree.left[at]), _shape(tree, tree.left[at] + 1)


def test_trees_are_those_of_a_search_by_hand(spark):
    df, names = _table(spark)
    df = df.persist()
    got = W.fit_votes(df, names, "y", 3, trees=6, depth=4, seed=7)
    with W._kept_cells(df, names, "y", got.edges) as (blocks, _):
        held = list(W._unpacked([blocks.toPandas()], 4))
    assert sum(n.sum() for *_, n in held) == 900
    for t, tree in enumerate(got.trees):
        w = np.concatenate([np.random.default_rng([7, t, block]).poisson(n) for block, _, _, n in held]).astype(float)
        columns, y = np.concatenate([h[1] for h in held], 1), np.concatenate([h[2] for h in held])
        assert _shape(tree) == _brute(columns, y, w, 3, 2, R.root_path(7, t)[0], 4)
    df.unpersist()


def test_repeated_rows_make_no_more_cells(spark):
    """What a pass reads does not grow with rows of the same bins; their counts do."""
    one, names = _table(spark)
    five, _ = _table(spark, times=5)
    edges = W.class_edges(one, names)
    a, b = (W.cells_of(df, names, "y", edges).agg(F.count(F.lit(1)), F.sum("n")).first() for df in (one, five))
    assert a[0] == b[0] and (a[1], b[1]) == (900, 4500)


def test_bins_lie_between_all_values_where_these_are_few(spark):
    rows = [(float(i % 3) if i else 7.0, float(i), 1.0) for i in range(2000)]  # 7 comes once
    df = spark.createDataFrame(rows, "few double, many double, one double").repartition(4)
    few, many, one = W.class_edges(df, ["few", "many", "one"])
    assert few.tolist() == [0.0, 1.0, 2.0] and len(many) == W.BINS - 1 and len(one) == 0
    codes = W.binned(df, ["few", "many", "one"], [few, many, one]).collect()
    assert all(r["_b0"] == {0.0: 0, 1.0: 1, 2.0: 2, 7.0: 3}[r["few"]] and r["_b1"] == np.searchsorted(many, r["many"]) and r["_b2"] == 0
               for r in codes)


def test_passes_over_few_nodes_grow_the_same_trees(spark, monkeypatch):
    df, names = _table(spark)
    df = df.persist()
    whole = [_shape(t) for t in W.fit_votes(df, names, "y", 3, trees=4, depth=3).trees]
    monkeypatch.setattr(W, "SUMS", 3 * 2 * W.BINS * 3)
    assert [_shape(t) for t in W.fit_votes(df, names, "y", 3, trees=4, depth=3).trees] == whole
    df.unpersist()


def test_counts_are_those_of_the_rows(spark):
    df, names = _table(spark)
    df = df.persist()
    model = W.fit_votes(df, names, "y", 3, trees=10, depth=4)
    rows = model.transform(df)
    assert rows.columns == df.columns + ["_pred"]
    counted = {(r["y"], r["_pred"]): r["n"] for r in model.counted(df, "y").groupBy("y", "_pred").agg(F.sum("n").alias("n")).collect()}
    assert counted == {(r["y"], r["_pred"]): r["count"] for r in rows.groupBy("y", "_pred").count().collect()}
    df.unpersist()


def test_no_levels_no_second_class_no_feature(spark):
    df, names = _table(spark, n=60)
    assert {r["_pred"] for r in W.fit_votes(df, names, "y", 3, trees=9, depth=0).transform(df).collect()} == {
        float(max(df.groupBy("y").count().collect(), key=lambda r: r["count"])["y"])}
    assert {r["_pred"] for r in W.fit_votes(df.withColumn("y", F.lit(0.0)), names, "y", 1, trees=3).transform(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        W.fit_votes(df, [], "y", 3)


def test_classifier_forest_is_as_good_as_sparks(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df, names = _table(spark, n=1500)
    df = df.withColumn("y", F.concat(F.lit("k"), F.col("y").cast("int").cast("string"))).persist()
    report, pred = M.compare_classifiers(df, "y", models=("rf",), num_trees=30, predictions=True, cv="cv", k=3)
    mine = report.first()
    rows = VectorAssembler(inputCols=names, outputCol="_f").transform(df.withColumn("y", F.substring("y", 2, 1).cast("double")))
    theirs = RandomForestClassifier(numTrees=30, maxDepth=5, seed=42, featuresCol="_f", labelCol="y").fit(rows).transform(rows)
    theirs = theirs.agg(F.avg((F.col("y") == F.col("prediction")).cast("int"))).first()[0]
    assert mine["error"] is None and mine["accuracy"] == pytest.approx(theirs, abs=0.02) and mine["cv_accuracy"] > 0.8
    hits = pred["rf"].agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0]
    assert hits == pytest.approx(mine["accuracy"], abs=1e-12)
    df.unpersist()
