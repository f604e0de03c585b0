import random
import re

import numpy as np
import pytest
import xxhash

from tabwise.llm import simhash
from tabwise.llm.common import components


def fingerprint(text, n=3):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    k = min(n, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, reach):
    points = np.array(points, np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= reach
    low = np.arange(len(points))
    while True:
        new = np.array([low[row].min() for row in near])
        if (new == low).all():
            return low
        low = new


def check(spark, rows, n=3, reach=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted(((r["key"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.near_duplicates(df, n, reach).collect()), key=str)
    prints = [fingerprint(t, n) for _, t in rows]
    low = classes(prints, reach)
    smallest = {}
    for (key, _), c in zip(rows, low):
        if key is not None:
            smallest[c] = min(smallest.get(c, key), key)
    assert got == sorted(((k, p, smallest.get(c)) for (k, _), p, c in zip(rows, prints, low)), key=str)


def test_against_brute_force(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(spark, rows)


def test_defined_cases(spark):
    text = "One two three four five six seven"
    check(spark, [(1, None), (2, ""), (3, " \n "), (None, text), (5, text.upper()), (5, text.upper()), (7, "a"), (8, "a b"), (9, "É x\x0by z w")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_find_all_links(spark, monkeypatch, seed):
    """Many shards, many blocks and a dense ball of near copies: the classes are those of all pairs."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rnd = random.Random(seed)
    points = {rnd.getrandbits(64) for _ in range(500)}
    for p in list(points)[:120]:
        for _ in range(rnd.randrange(4)):
            points.add(p ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6))))
    center = rnd.getrandbits(64)
    points |= {center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    found = dict(components(simhash.fingerprint_links(df, 3)).collect())
    low = classes(points, 3)
    want = {}
    for p, c in zip(signed, low):
        want.setdefault(c, set()).add(p)
    got = {}
    for p in signed:
        got.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [
        (5000, 5000 + i) for i in range(200)] + [(1, 1), (None, 3)]
    got = dict(components(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
