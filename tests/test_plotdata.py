import pytest
from pyspark.sql import functions as F

from tabwise.functions.normal import qnorm
from tabwise.operators import plotdata as P

SF = "/root/testdata/sf0.01"


def test_melt(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, s string")
    assert sorted(tuple(r) for r in P.melt_numeric(df).collect()) == [("a", 1.0), ("b", 2.0)]


def test_boxplot_whiskers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    r = P.boxplot_stats(df).first()
    assert (r.q1, r.median, r.q3) == (3.0, 5.0, 7.0)
    assert (r.lower_whisker, r.upper_whisker, r.outliers) == (1.0, 8.0, 1)


def test_boxplot_by_matches_ungrouped(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]]
                               + [("b", float(v)) for v in [10, 20]], "g string, y double")
    rows = {r.g: r for r in P.boxplot_by(df, "g", "y").collect()}
    assert (rows["a"].q1, rows["a"].median, rows["a"].q3, rows["a"].outliers) == (3.0, 5.0, 7.0, 1)
    assert (rows["b"].q1, rows["b"].q3, rows["b"].n) == (12.5, 17.5, 2)


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 101)], "x double")
    h = P.histogram(df, "x", bins=5).orderBy("bin").collect()
    assert len(h) == 5 and sum(r["count"] for r in h) == 101
    assert h[0].center == pytest.approx(0.0) and h[-1].center == pytest.approx(100.0)
    # right-closed: 12.5 is the first bin's right edge
    assert h[0]["count"] == 13


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    h = P.histogram(df, "x", bins=5).collect()
    assert len(h) == 5 and sorted(r["count"] for r in h) == [0, 0, 0, 1, 1]


def test_histogram_width(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 5, 6, 15, 16, 50]], "x double")
    h = {r.bin: r for r in P.histogram_width(df, "x", 10.0).collect()}
    assert h[0].x_min == pytest.approx(-5.0) and h[0]["count"] == 2  # (-5, 5]: 1 and 5
    assert sum(r["count"] for r in h.values()) == 6


def test_qq_points_small_n_uses_three_eighths(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2]], "x double")
    pts = P.qq_points(df, "x").orderBy("position").collect()
    assert [r.sample for r in pts] == [1.0, 2.0, 3.0]
    n, a = 3, 3 / 8
    for i, r in enumerate(pts, start=1):
        assert r.theoretical == pytest.approx(qnorm((i - a) / (n + 1 - 2 * a)), abs=1e-9)


def test_qnorm_accuracy():
    from statistics import NormalDist

    for p in [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999999]:
        assert qnorm(p) == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9)


def test_qq_line(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    line = P.qq_line(df, "x")
    assert line["slope"] == pytest.approx((3.25 - 1.75) / (2 * qnorm(0.75)))


def test_plot_sample_size_and_reproducible(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    a = P.plot_sample(li, 1000, seed=1)
    assert a.count() == 1000
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, P.plot_sample(li, 1000, seed=1).collect()))
    small = li.limit(10)
    assert P.plot_sample(small, 1000).count() == 10


def test_scatter_and_density(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    bins = P.scatter_bins(li, "l_quantity", "l_extendedprice", 10)
    assert bins.agg(F.sum("n")).first()[0] == 60000
    dens = P.density_curve(li, "l_quantity").collect()
    xs = [r.x for r in dens]
    step = xs[1] - xs[0]
    assert sum(r.density for r in dens) * step == pytest.approx(1.0, abs=0.01)


def test_pairs_need_two_columns(spark):
    df = spark.createDataFrame([(1, "a")], "a int, s string")
    with pytest.raises(ValueError):
        P.correlation_pairs(df)
    with pytest.raises(ValueError):
        P.scatter_points(df)


def test_metrics_long_drops_nulls(spark):
    m = spark.createDataFrame([("lm", 1.0, None, 0.5), ("rf", None, None, None)],
                              "model string, rmse double, mape double, r_squared double")
    assert sorted(tuple(r) for r in P.metrics_long(m).collect()) == [("lm", "r_squared", 0.5), ("lm", "rmse", 1.0)]


def test_sample_of_repeated_rows_is_uniform(spark):
    df = spark.range(40_000).select((F.col("id") % 4).cast("double").alias("v"))
    got = {r["v"]: r["count"] for r in P.plot_sample(df, 4000, seed=2).groupBy("v").count().collect()}
    assert sum(got.values()) == 4000 and all(abs(c - 1000) < 150 for c in got.values())
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    pairs = P.scatter_points(li, "l_quantity", "l_discount", n=10_000).distinct().count()
    assert pairs == li.select("l_quantity", "l_discount").distinct().count()
    assert P.scatter_points(li, "l_quantity", "l_discount").count() == li.count()


def test_frequent_value_is_spread(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    pts = P.qq_points(df, "v")
    per = [r["count"] for r in pts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 100_000 and max(per) < 50_000
    assert pts.agg(F.countDistinct("position")).first()[0] == 100_000


def test_numeric_x_is_one_box(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    r = P.boxplot_by(li, "l_quantity", "l_extendedprice").collect()
    b = P.boxplot_stats(li, ["l_extendedprice"]).first()
    assert len(r) == 1 and r[0]["l_quantity"] is None
    assert (r[0].n, r[0].q1, r[0].median, r[0].q3, r[0].outliers) == (b.n, b.q1, b.median, b.q3, b.outliers)


def test_wide_range_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1e11,), (1e11,)], "x double")
    rows = P.histogram_width(df, "x", 10.0).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 2] and rows[1].bin == 10_000_000_000


def test_pair_matrix_has_all_panels(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "value")
    got = {(r.panel, r.var1, r.var2): r["count"] for r in P.pair_matrix(ev, n=500, points=64).groupBy("panel", "var1", "var2").count().collect()}
    assert got == {("corr", "user_id", "value"): 1, ("density", "user_id", None): 64, ("density", "value", None): 64,
                   ("point", "user_id", "value"): 500}
