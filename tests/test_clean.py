from pyspark.sql import functions as F

from tabwise.functions.positions import with_positions
from tabwise.operators import clean as K
from tabwise.sources.tables import fixture

SF = "/root/testdata/sf0.01"


def test_drop_columns_ignores_unknown(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert K.drop_columns(df, ["b", "zz"]).columns == ["a", "c"]
    assert K.drop_columns(df, ["zz"]).columns == ["a", "b", "c"]


def test_positions_equal_row_number(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderdate")
    pos = with_positions(orders, ["o_orderdate", "o_orderkey"], pos_col="p")
    from pyspark.sql import Window

    rn = orders.withColumn("rn", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")) - 1)
    joined = pos.join(rn, ["o_orderkey", "o_orderdate"])
    assert joined.where(F.col("p") != F.col("rn")).count() == 0
    assert joined.count() == orders.count()


def test_drop_rows_bounds_and_empty(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(1, 11)], "k int, v int")
    kept = [r.k for r in K.drop_rows(df, "1, 3, x, 99, 0, -2", ["k"]).orderBy("k").collect()]
    assert kept == [2, 4, 5, 6, 7, 8, 9, 10]
    # defect B9: an empty index list keeps every row
    assert K.drop_rows(df, "", ["k"]).count() == 10
    assert K.drop_rows(df, "abc", ["k"]).count() == 10


def test_remove_outliers_sequential_vs_joint(spark):
    fx = fixture(spark, SF, "fx_out")
    assert K.remove_outliers(fx, ["value"]).count() == 9537
    assert K.remove_outliers(fx, ["value", "v2"], mode="sequential").count() == 8627
    assert K.remove_outliers(fx, ["value", "v2"], mode="joint").count() == 8873


def test_remove_outliers_keeps_nulls(spark):
    rows = [(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 1000]] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    out = K.remove_outliers(df)
    assert out.count() == 8
    assert out.where(F.col("x").isNull()).count() == 1


def test_impute_mean_and_mode(spark):
    df = spark.createDataFrame([(1.0, None, "a", None), (None, None, "b", None), (3.0, None, "b", None),
                                (None, None, None, None)], "x double, allnull double, s string, t string")
    m = K.impute_mean(df, ["x", "allnull"]).collect()
    assert [r.x for r in m] == [1.0, 2.0, 3.0, 2.0]
    assert {r.allnull for r in m} == {0.0}
    md = K.impute_mode(df, ["s", "t"]).collect()
    assert [r.s for r in md] == ["a", "b", "b", "b"]
    assert {r.t for r in md} == {"Missing"}


def test_auto_clean_fx_gap(spark):
    gap = fixture(spark, SF, "fx_gap")
    out, report = K.auto_clean(gap, report=True)
    assert report == {"sparse": ["mostly_null"], "nzv": ["const_col", "near_const"], "correlated": ["price"]}
    assert out.columns == ["id", "priority", "status", "price_copy", "cust"]


def test_complete_cases_and_null_target(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert K.complete_cases(df).count() == 1
    assert K.drop_null_target(df, "x").count() == 2  # NaN is missing too, as is.na(NaN) in R


def test_preview_and_duplicates(spark):
    df = spark.createDataFrame([(i, f"name{i % 3}") for i in range(30)], "k int, s string")
    page = K.preview(df, ["k"], page=2, page_size=5, search="NAME1").collect()
    assert [r.k for r in page] == [16, 19, 22, 25, 28]
    dup = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert K.drop_duplicates(dup).count() == 2


def test_select_model_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3)], "a int, s string, y double, z int")
    assert K.select_model_columns(df, "y").columns == ["y", "a", "s", "z"]
    assert K.select_model_columns(df, "y", numeric_only=True).columns == ["y", "a", "z"]


def test_drop_rows_with_ties_and_odd_positions(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    # order: None, then 1 (three alike), then 2
    assert key(K.drop_rows(df, "2, 4, inf, -inf, nan, x, 99", ["k"]).collect()) == key([(None, "d"), (1, "a"), (2, "b"), (2, "c")])
    assert key(K.drop_rows(df, "1.9", ["k"]).collect()) == key([(1, "a")] * 3 + [(2, "b"), (2, "c")])
    assert K.drop_rows(df, "5,6", ["k", "v"]).count() == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        assert K.drop_rows(df, [1], ["k"]).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_drop_rows_sorts_no_rows_of_the_table(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = K.drop_rows(li, "3, 7", ["l_orderkey", "l_linenumber"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()


def test_nan_counts_as_missing_and_small_tables(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (2.0, nan), (3.0, nan), (4.0, 1.0)], "a double, b double")
    assert K.sparse_columns(df) == ["b"] and K.drop_sparse_columns(df).columns == ["a"]
    for n in range(1, 6):
        rows = [(float(i), 7.0, "x") for i in range(n)]
        df = spark.createDataFrame(rows, "a double, same double, text string")
        assert set(K.nzv_columns(df)) >= {"same", "text"}
