import pytest
from pyspark.sql import functions as F

from tabwise.plans import features as FE


def _mixed(spark):
    rows = [(float(i), float(i % 5) if i % 4 else None, ["a", "b", "c"][i % 3] if i % 7 else None, i * 2.0 + 1)
            for i in range(40)]
    return spark.createDataFrame(rows, "x double, w double, cat string, y double")


@pytest.mark.parametrize("target,msg", [
    ("nope", "has no column"),
    ("cat", "is not numeric"),
])
def test_validation_messages(spark, target, msg):
    with pytest.raises(FE.PreprocessError, match=msg):
        FE.preprocess(_mixed(spark), target)


def test_more_validation_messages(spark):
    only = spark.createDataFrame([(1.0,), (2.0,)], "y double")
    with pytest.raises(FE.PreprocessError, match="only column"):
        FE.preprocess(only, "y")
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "y double, x double")
    with pytest.raises(FE.PreprocessError, match="no row has a value"):
        FE.preprocess(nulls, "y")
    tiny = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 3.0, 1.0)], "y double, a double, b double")
    with pytest.raises(FE.PreprocessError, match="more rows than predictors"):
        FE.preprocess(tiny, "y")


def test_preprocess_standardizes_and_encodes(spark):
    pre, prepared = FE.preprocess(_mixed(spark), "y", corr_cutoff=None)
    assert prepared.columns[0] == "y"
    assert set(pre.features) >= {"x", "w", "cat_a", "cat_b", "cat_c"}
    stats = prepared.agg(*[F.avg(f).alias(f"m_{f}") for f in pre.features],
                         *[F.stddev_samp(f).alias(f"s_{f}") for f in pre.features]).first()
    for f in pre.features:
        assert stats[f"m_{f}"] == pytest.approx(0.0, abs=1e-9)
        assert stats[f"s_{f}"] == pytest.approx(1.0, abs=1e-9)
    # target untouched
    assert sorted(r.y for r in prepared.select("y").collect()) == sorted(i * 2.0 + 1 for i in range(40))


def test_no_categoricals_defect_b1(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(i) * 3) for i in range(20)], "a double, b double, y double")
    pre, prepared = FE.preprocess(df, "y")
    assert pre.categorical == [] and prepared.count() == 20


def test_target_never_screened_defect_b2(spark):
    # x is a perfect copy of the target: the screen must not drop the target
    df = spark.createDataFrame([(float(i), float(i), float(i % 3)) for i in range(30)], "y double, x double, z double")
    pre, prepared = FE.preprocess(df, "y")
    assert prepared.columns[0] == "y" and "x" in pre.features


def test_single_predictor(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2) for i in range(10)], "x double, y double")
    pre, prepared = FE.preprocess(df, "y")
    assert pre.features == ["x"] and prepared.count() == 10


def test_scoring_unseen_level_and_missing_column_defects_b3_b4(spark):
    pre, _ = FE.preprocess(_mixed(spark), "y", corr_cutoff=None, nzv=False)
    score = spark.createDataFrame([(1.0, "zzz"), (None, "a")], "x double, cat string")
    out = pre.transform(score, keep_target=False).collect()
    # unseen level: every dummy at its own (centred) zero point; missing w -> mean -> 0
    assert all(r["w"] == 0.0 for r in out)
    raw0 = {k: out[0][k] * pre.sds[k] + pre.means[k] for k in ("cat_a", "cat_b", "cat_c")}
    assert all(v == pytest.approx(0.0, abs=1e-12) for v in raw0.values())
    raw1 = out[1]["cat_a"] * pre.sds["cat_a"] + pre.means["cat_a"]
    assert raw1 == pytest.approx(1.0)


def test_one_hot_rows_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "c string, k int")
    oh = FE.one_hot(df, ["c"])
    assert oh.columns == ["k", "c_a", "c_b"]
    sums = [r.c_a + r.c_b for r in oh.collect()]
    assert sums == [1.0, 1.0, 1.0, 0.0]


def test_standardize_fill_and_align(spark):
    df = spark.createDataFrame([(1.0, "q", 5.0), (3.0, "p", 5.0)], "a double, s string, y double")
    st = FE.standardize(df, ["a"]).collect()
    assert [r.a for r in st] == pytest.approx([-0.7071067811865475, 0.7071067811865475])
    row = FE.fill_score_row(df, "y").first()
    assert (row.a, row.s) == (2.0, "p")
    al = FE.align_features(df, ["y", "zz", "a"]).first()
    assert (al.y, al.zz, al.a) == (5.0, 0.0, 1.0)


def test_text_ids_do_not_become_columns(spark):
    """A column of ids and a column of 30 levels: only levels of at least a twentieth of the rows leave Spark."""
    rows = [(float(i), f"id{i}", f"l{i % 30}" if i % 2 else "big", 2.0 * i) for i in range(900)]
    df = spark.createDataFrame(rows, "x double, id string, c string, y double")
    n, fills, levels = FE.fit_fill_values(df, ["x"], ["id", "c"], all_levels=False)
    assert levels == {"id": [], "c": ["big"]} and n == 900
    pre, prepared = FE.preprocess(df, "y", corr_cutoff=None)
    assert pre.features == ["x", "c_big"] and prepared.count() == 900


def test_level_filter_is_the_near_zero_variance_rule(spark):
    import random

    from tabwise.operators.clean import nzv_columns

    rnd = random.Random(3)
    for n in (5, 19, 20, 21, 60, 200):
        rows = [(float(i), rnd.choice("aaaaaaaaaaaaaaaaaabcdd") if rnd.random() > 0.1 else None) for i in range(n)]
        df = spark.createDataFrame(rows, "y double, c string")
        _, fills, levels = FE.fit_fill_values(df, [], ["c"], all_levels=False)
        filled = df.na.fill(fills)
        wide = FE.one_hot(filled.select("c"), ["c"])
        flagged = set(nzv_columns(wide))
        assert [f"c_{v}" for v in levels["c"]] == [c for c in wide.columns if c not in flagged], n


def test_score_rows_take_inputs(spark):
    df = spark.createDataFrame([(1.0, 10, "b", 1.0), (3.0, 30, "a", 2.0)], "x double, k int, c string, y double")
    assert FE.fill_score_row(df, "y").first().asDict() == {"x": 2.0, "k": 20.0, "c": "a"}
    assert FE.fill_score_row(df, "y", {"x": 7, "nope": 1}).first().asDict() == {"x": 7.0, "k": 20.0, "c": "a"}
    table = spark.createDataFrame([(None, "z"), (5.0, None), (float("nan"), "q")], "x double, c string")
    assert [tuple(r) for r in FE.fill_score_row(df, "y", table).collect()] == [(2.0, 20.0, "z"), (5.0, 20.0, "a"), (2.0, 20.0, "q")]


def test_one_hot_vector(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "c string")
    got = [r["one_hot"].toArray().tolist() for r in FE.one_hot_vector(df, ["c"]).collect()]
    assert got == [[0, 1, 0], [1, 0, 0], [0, 0, 1], [1, 0, 0]]


def test_more_levels_than_columns_can_be(spark, monkeypatch):
    df = spark.range(40).selectExpr("concat('k', id % 7) AS c", "CAST(id AS DOUBLE) AS y")
    monkeypatch.setattr(FE, "MOST_LEVELS", 7)
    assert len(FE.one_hot(df, ["c"]).columns) == 8
    monkeypatch.setattr(FE, "MOST_LEVELS", 6)
    for call in (lambda: FE.one_hot(df, ["c"]), lambda: FE.preprocess(df, "y", nzv=False)):
        with pytest.raises(FE.PreprocessError):
            call()
