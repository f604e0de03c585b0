import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import topk


def brute(rows, k, every, scale=64):
    good = []
    for i, (key, x) in enumerate(rows):
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            good.append((i, key, [int(np.floor(scale * c)) for c in x]))
    out = []
    for i, key, q in good:
        if key is None or key % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), other is None, other, j) for j, other, c in good if j != i and len(c) == len(q)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(key, r, s[2], -s[0]) for r, s in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, every, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, code string, class int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k, **kw)
    assert got.columns == ["query", "rank", "id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_blocks_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 10)) / 3
    x = base[rng.integers(0, 25, 160)] + rng.normal(size=(160, 10)) * 0.02
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    assert found(spark, rows, 7, 10, slices=slices) == brute(rows, 7, 10)


def test_negative_scores_and_unequal_slices(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(-abs(a)), float(100 * b), 0.001, float(a)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    assert found(spark, rows, 50, 6) == brute(rows, 50, 6)
    rows = [(i, [float(1 if i % 6 else -1)] * 3) for i in range(40)]  # nothing scores above zero
    assert found(spark, rows, 5, 6) == brute(rows, 5, 6)


def test_equal_vectors_ties_and_repeated_rows(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(60)] + [(i, [0.5, 0.0, 0.125]) for i in range(60, 70)]
    rows += [(0, [0.5, -0.25, 0.125]), (20, [0.1, 0.1, 0.1]), (20, [0.1, 0.1, 0.1])]
    assert found(spark, rows, 5, 10) == brute(rows, 5, 10)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (10, [inf, 1.0]), (20, []),
            (21, []), (30, [3.0]), (40, [1.0, 2.0, 3.0]), (41, [1e5, -2.0, 3.0]), (50, [-0.001, 0.001])]
    assert found(spark, rows, 3, 10) == brute(rows, 3, 10)
    assert found(spark, [(10, [1e30, 1.0]), (20, [1.0, 1.0]), (30, [1.0, 2.0])], 3, 10) == brute([(20, [1.0, 1.0]), (30, [1.0, 2.0])], 3, 10)
    assert found(spark, [], 3, 10) == []
    assert found(spark, [(1, [1.0])], 3, 10) == []
    assert found(spark, [(10, [1.0])], 3, 10) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(v), float(-v), 1.0 + i]) for i, v in enumerate((3e6, 3e6 + 1, 2e6, 5.0, 1e7, 2.5e6))]
    assert found(spark, rows, 4, 2) == brute(rows, 4, 2)


def test_entries_travel_in_bounded_rows(monkeypatch):
    """A tile's entries go on a step of queries and a piece at a time, and the merge reads them so."""
    import pyarrow as pa

    monkeypatch.setattr(topk, "_STEP", 4)
    monkeypatch.setattr(topk, "_PIECE", 25)
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (70, 6))
    ask, k = np.arange(0, 70, 7), 3
    whole = x[ask] @ x.T
    cut = np.sort(whole, 1)[:, -k]
    zeros = {c: [0] for c in topk._TILE}

    def side(kind, classes, b):
        n = len(classes)
        more = {"cut": cut.tolist(), "least": (-(-cut // 2)).tolist()} if kind == topk._ASK else {"cut": [None] * n, "least": [None] * n}
        return {c: v * n for c, v in zeros.items()} | {"kind": [kind] * n, "class": classes.tolist(), "slice": [b] * n,
                                                      "code": x[classes][:, b::2].tolist()} | more

    schema = pa.schema([*[(c, pa.int32()) for c in topk._TILE], ("kind", pa.int32()), ("class", pa.int64()), ("slice", pa.int32()),
                        ("code", pa.list_(pa.int64())), ("cut", pa.int64()), ("least", pa.int64())])
    heads = [pa.Table.from_pydict(side(kind, c, b), schema).combine_chunks() for b in range(2) for kind, c in ((0, np.arange(70)), (1, ask))]
    rows = []
    for b in range(2):
        rows += list(topk._entries()(iter([batch for t in heads[2 * b:2 * b + 2] for batch in t.to_batches()])))
    assert max(len(r.column("pairs")[0].as_py()) // 4 for r in rows) <= 25
    assert {r.column("step")[0].as_py() for r in rows} == {0, 1, 2}
    both = pa.schema([*schema, ("step", pa.int32()), ("pairs", pa.binary()), ("s", pa.binary())])

    def wide(t, kind):
        t = t if kind is None else t.append_column("kind", pa.array([kind], pa.int32()))
        return pa.table([t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in both], schema=both)

    entries = sorted(rows, key=lambda r: r.column("step")[0].as_py())
    tile = [b for t in [*(wide(h, None) for h in heads), *(wide(pa.Table.from_batches([r]), topk._ENTRIES) for r in entries)] for b in t.to_batches()]
    found = list(topk._resolver(k, 2)(iter(tile)))
    assert len(found) == 3  # a batch a step
    got = sorted(r for b in found for r in zip(*(b.column(c).to_pylist() for c in ("query", "class", "score"))))
    assert got == sorted((int(q), j, int(whole[i, j])) for i, q in enumerate(ask) for j in range(70) if whole[i, j] >= cut[i])
    with pytest.raises(RuntimeError):
        list(topk._resolver(k, 2)(iter([*tile, tile[-1], tile[4]])))


def test_more_queries_than_a_step(spark):
    rng = np.random.default_rng(6)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(700, 4)))]
    assert found(spark, rows, 3, 1) == brute(rows, 3, 1)
