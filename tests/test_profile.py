import pytest

from tabwise.operators import profile as PR
from tabwise.sources.tables import fixture

SF = "/root/testdata/sf0.01"


def _d(df):
    return {r[0]: r[1] for r in df.collect()}


def test_null_counts_and_fraction(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, None)], "a int, b string")
    assert _d(PR.null_counts(df)) == {"a": 1, "b": 2}
    frac = _d(PR.null_fraction(df))
    assert frac["a"] == pytest.approx(1 / 3) and frac["b"] == pytest.approx(2 / 3)


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    assert PR.duplicate_count(df).first()[0] == 3
    empty = spark.createDataFrame([], "a int")
    assert PR.duplicate_count(empty).first()[0] == 0


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    r = PR.mode_value(df, "c").first()
    assert (r["mode"], r["mode_count"]) == ("a", 2)


def test_correlation_complete_rows_vs_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 5.0), (3.0, 7.0, 2.0), (4.0, 8.0, None)],
                               "a double, b double, c double")
    full = {(r[0], r[1]): r[2] for r in PR.correlation(df).collect()}
    assert full[("a", "b")] == pytest.approx(1.0)
    pair = {(r[0], r[1]): r[2] for r in __import__("tabwise.operators.plotdata", fromlist=["x"])
            .pair_correlations(df.select("a", "b")).collect()}
    assert pair[("a", "b")] == pytest.approx(0.984324, abs=1e-6)


def test_constant_column_gives_null_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, k double")
    full = {(r[0], r[1]): r[2] for r in PR.correlation(df).collect()}
    assert full[("a", "k")] is None and full[("k", "k")] is None and full[("a", "a")] == 1.0


def test_near_zero_variance_on_fx_gap(spark):
    gap = fixture(spark, SF, "fx_gap")
    nzv = {r["column_name"]: r for r in PR.near_zero_variance(gap).collect()}
    assert nzv["near_const"]["freq_ratio"] == pytest.approx(99.0, rel=1e-3)
    assert nzv["const_col"]["zero_var"] and nzv["const_col"]["nzv"]
    assert nzv["price"]["percent_unique"] == pytest.approx(89.99, abs=0.01)
    assert not nzv["priority"]["nzv"] and not nzv["cust"]["nzv"]
    assert {c for c, r in nzv.items() if r["nzv"]} == {"const_col", "near_const"}


def test_find_correlated_rule():
    names = ["a", "b", "c"]
    m = {("a", "a"): 1, ("b", "b"): 1, ("c", "c"): 1, ("a", "b"): 0.95, ("b", "a"): 0.95,
         ("a", "c"): 0.1, ("c", "a"): 0.1, ("b", "c"): 0.5, ("c", "b"): 0.5}
    # b has the larger mean absolute correlation, so b goes
    assert PR.find_correlated(m, names, 0.9) == ["b"]
    assert PR.find_correlated(m, names, 0.99) == []
    assert PR.find_correlated(m, names, 0.9, exact=False) == ["b"]


def test_correlated_columns_fx_gap(spark):
    from tabwise.operators import clean as K

    gap = fixture(spark, SF, "fx_gap")
    assert PR.correlated_columns(K.drop_near_zero_variance(K.drop_sparse_columns(gap))) == ["price"]


def test_profile_and_outliers(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    out = {r["column_name"]: r for r in PR.outlier_counts(ev).collect()}
    assert out["value"]["outliers"] == 463
    prof = {r["column_name"]: r for r in PR.profile(ev).collect()}
    assert prof["value"]["outliers"] == 463 and prof["value"]["nulls"] == 0
    assert prof["event_id"]["n_distinct"] == 10000


def test_summary_types(spark):
    df = spark.createDataFrame([(1, "ab", True), (None, "c", False), (3, None, True)], "a int, s string, b boolean")
    rows = {r["column_name"]: r for r in PR.summary(df).collect()}
    assert rows["a"]["median"] == 2.0 and rows["a"]["nulls"] == 1
    assert (rows["b"]["n_true"], rows["b"]["n_false"]) == (2, 1)
    assert (rows["s"]["min_length"], rows["s"]["max_length"]) == (1, 2)


def test_shape(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    rows = {r["table"]: (r["n_rows"], r["n_cols"]) for r in PR.shape(df, df.select("a").limit(1)).collect()}
    assert rows == {"original": (2, 2), "cleaned": (1, 1)}
