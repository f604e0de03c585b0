import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabwise.llm import convtrie


def ordered(rows):
    """Turns of each conversation, ordered as the operator orders them."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = f"{len(role.encode())}:{role}{text}"
            by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(said.encode()).digest()[:16], role, text))
    return {c: [(t[3], t[4]) for t in sorted(x)] for c, x in by.items()}


def rebuilt(by):
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = by.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(whole):
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def leaves(p):
        return sum(map(leaves, children[p])) if p in children else 1

    def saved(p):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        return own + sum(saved(x) for x in children.get(p, ()))

    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(p))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children.get(p, ())), leaves(p), saved(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, whole=False, **kw):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, d int").repartition(3)
    turns = convtrie.numbered_turns(df)
    got = convtrie.prefix_trie(convtrie.sequences(turns) if whole else convtrie.rebuilt(turns), **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def talk(rng, n, most, words):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("batches", [(1,), (1, 1, 2), (1, 7)])
def test_many_shared_prefixes_against_brute_force(spark, batches):
    rows = talk(random.Random(7), 150, 9, ["a", "bé", ""])
    whole = ordered(rows)
    assert found(spark, rows, whole=True, batches=batches) == brute(whole)


def test_rebuilt_conversations(spark):
    rows = talk(random.Random(8), 90, 14, ["a", "b", "c"])
    rows = [r for r in rows if r[0] % 10 != 5]  # bases that do not exist
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]
    assert found(spark, rows) == brute(rebuilt(ordered(rows)))


def test_nested_prefixes_and_long_edges(spark):
    said = [("user", f"t{i}") for i in range(70)]
    rows = [(c, t, *said[t]) for c in range(70) for t in range(c + 1)]
    rows += [(100 + c, t, *(said[t] if t < 3 * c else ("x", str(c)))) for c in range(20) for t in range(60)]
    whole = ordered(rows)
    assert found(spark, rows, whole=True, batches=(1, 2)) == brute(whole)


def test_one_conversation_over_many_partitions(spark):
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        rows = [(1, t, "user", str(t % 7)) for t in range(900)] + [(c, t, "user", str(t % 7)) for c in (2, 3) for t in range(5 * c)]
        whole = ordered(rows)
        prefixes = convtrie.prefix_keys(convtrie.sequences(convtrie.numbered_turns(
            spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
        assert prefixes.groupBy("d").agg(F.countDistinct("key").alias("n")).where("n <> 1").isEmpty()
        assert prefixes.select("key").distinct().count() == 901
        assert prefixes.agg(F.max("cum")).first()[0] == sum(len(t[1]) for t in whole[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_defined_cases(spark):
    rows = [(0, 1, None, "x"), (0, None, "user", None), (0, None, "user", "first"), (0, 1, None, "x"), (None, 0, "user", "lost"),
            (2, 0, "user", "x" * 100_000), (3, 0, "", ""), (5, 0, "user", "only"), (7, 0, "user", "one"), (7, 0, "user", "one"), (6, 1, "user", "own")]
    assert found(spark, rows) == brute(rebuilt(ordered(rows)))
    assert found(spark, []) == []
    gone = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 0)
    assert found(spark, [(gone, 0, "user", "x")]) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]


def test_many_ends_in_one_digest(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in range(300)]
    assert found(spark, rows, whole=True) == brute(ordered(rows))


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(-1, 40) for b in range(max(a + 1, 1), 41) if a >= 0]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", convtrie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in got)
