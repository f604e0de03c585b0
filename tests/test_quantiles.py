import math

import numpy as np
import pytest

from tabwise.functions.quantiles import exact_quantiles


def type7(values, p):
    v = np.sort(np.array([x for x in values if x is not None and not (isinstance(x, float) and math.isnan(x))]))
    return float(np.quantile(v, p, method="linear"))


def test_hand_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    res = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])
    assert res["x"]["q"] == [1.75, 2.5, 3.25]


def test_nulls_nan_and_ties(spark):
    rows = [(float(v),) for v in [5, 5, 5, 1, 9, 9]] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    res = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9])
    vals = [r[0] for r in rows]
    assert res["x"]["n"] == 6
    for q, p in zip(res["x"]["q"], [0.1, 0.5, 0.9]):
        assert q == pytest.approx(type7(vals, p))


def test_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 3), (None, 3)], "a double, b int")
    res = exact_quantiles(df, ["a", "b"], [0.25, 0.75])
    assert res["a"]["q"] == [None, None]
    assert res["b"]["q"] == [3.0, 3.0]


@pytest.mark.parametrize("limit", [50_000, 40])
def test_matches_numpy_on_random_data(spark, limit):
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(3, 1, 20_000), 2)
    y = rng.integers(0, 7, 20_000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y long")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    # a tiny resolve limit and a coarse sketch force the refinement rounds
    res = exact_quantiles(df, ["x", "y"], probs, accuracy=100, resolve_limit=limit)
    for c, arr in (("x", x), ("y", y)):
        for q, p in zip(res[c]["q"], probs):
            assert q == pytest.approx(float(np.quantile(arr, p, method="linear")), rel=1e-12)


def test_events_value_matches_survey(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    q = exact_quantiles(ev, ["value"], [0.25, 0.5, 0.75])["value"]["q"]
    assert [round(v, 4) for v in q] == [14.56, 34.59, 69.1475]


@pytest.mark.parametrize("half", [0.0, 1.0])
def test_a_value_that_half_the_rows_share(spark, half):
    import numpy as np

    from tabwise.functions import quantiles as Q

    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(6000, half), rng.random(6000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    seen = []
    real = Q._resolve
    Q._resolve = lambda base, ts: (seen.extend(t.inside for t in ts), real(base, ts))
    try:
        got = Q.exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.51, 0.75, 0.9], accuracy=50, resolve_limit=50)["x"]["q"]
    finally:
        Q._resolve = real
    assert got == pytest.approx(list(np.quantile(x, [0.1, 0.25, 0.5, 0.51, 0.75, 0.9])), abs=1e-12)
    assert all(n <= 50 for n in seen)
