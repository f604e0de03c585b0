import numpy as np

from tabwise.llm import embeddings


def brute(rows, threshold):
    n, link = len(rows), {}
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows):
            ok = i != j and a is not None and a == b and x is not None and y is not None and len(x) == len(y)
            if ok:
                u, v = (np.array([np.nan if c is None else c for c in z], float) for z in (x, y))
                ok = np.isfinite(u).all() and np.isfinite(v).all() and u.any() and v.any() and u.size > 0
                ok = ok and (u / np.abs(u).max()) @ (v / np.abs(v).max()) / np.linalg.norm(u / np.abs(u).max()) / np.linalg.norm(v / np.abs(v).max()) >= threshold
            if ok:
                link.setdefault(i, set()).add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in link.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        keys = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(keys) if keys else None
        out.append((rows[i][0], len(link.get(i, ())), low, low is not None and rows[i][0] == low))
    return sorted(out, key=str)


def check(spark, rows, threshold=0.93):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, row int").repartition(3)
    assert sorted(map(tuple, embeddings.near_duplicates(df, threshold).collect()), key=str) == brute(rows, threshold)


def test_many_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 150, 100)] + rng.normal(size=(100, 16)) * rng.choice([0.1, 0.25, 0.4, 0.5], (100, 1))
    rows = [(int(i), list(map(float, v)), int(i) % 2) for i, v in enumerate(np.concatenate([base, near]))]
    check(spark, rows)


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [1.0, float("nan")], 0), (5, [float("inf"), 1.0], 0),
            (6, [1.0, 0.0], 0), (7, [2.0, 0.0], None), (8, [3.0, 1e-9], 0), (8, [3.0, 1e-9], 0), (None, [4.0, 0.0], 0),
            (9, [1.0, 0.0, 0.0], 0), (10, [], 0), (11, [1e-300, 0.0], 0), (12, [0.0, 1.0], 1), (12, [1e300, 1e300], 1), (None, [-1.0, 0.0], 5)]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []


def test_bound_is_rigorous():
    rng = np.random.default_rng(1)
    for dim in (2, 16, 64, 1500):
        x = rng.normal(size=(200, dim)) * rng.lognormal(0, 2, (200, dim))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        q = embeddings.quantise(x)
        cosine = u @ u.T
        for t in (0.2, 0.5, 0.93, 0.999):
            assert embeddings.possible_pairs(q, q, t)[cosine >= t].all()
