import random
import re
import zlib
from collections import Counter

import numpy as np

from tabwise.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def counted(rows, noise, letters=5, least=3):
    n = Counter()
    for key, text in rows:
        for w in RUN.findall(text or ""):
            w = lower(w)
            h = zlib.crc32(f"{key}:{w}".encode())
            if key is not None and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= least}


def edits(w, alphabet):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}) - {w}


def brute(n):
    alphabet = sorted(set("".join(n)))
    near = {w: [v for v in edits(w, alphabet) if v in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def grouped(spark, n):
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    got = variants.group_variants(words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


def test_words_of_texts(spark):
    rng = random.Random(1)
    words = ["Über", "straße", "NAÏVE", "naïve", "hello", "helloo", "World", "école", "a×b", "ÿes", "x" * 90, "q" * 40, "don't", "ñandúes", "İstanbul"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "1", "€", "é"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(None, "hello hello hello"), (5, None), (6, ""), (7, "hello"), (7, "hello"), (8, "abcde" * 5000)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string").repartition(3)
    for noise in (1, 3, 97):
        got = {r["word"]: r["n"] for r in variants.count_words(df, noise=noise).collect()}
        assert got == counted(rows, noise)


def test_trie_nodes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "NODE", 40)
    rng = random.Random(2)
    stems = ["".join(rng.choice("enatihé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    n = Counter()
    for _ in range(900):
        w = rng.choice(stems)
        for _ in range(rng.randrange(3)):
            at, c = rng.randrange(len(w)), rng.choice("enatihézx")
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])
        n[w] += rng.choice([3, 3, 10, 50])
    n = {w: c for w, c in n.items() if len(w) >= 5}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    nodes = variants.trie_nodes(words)
    assert nodes.select("node").distinct().count() > 5
    assert nodes.where("home").count() == len(n)
    assert grouped(spark, n) == brute(n)


def test_long_words_ties_and_full_nodes(spark, monkeypatch):
    monkeypatch.setattr(variants, "NODE", 5)
    monkeypatch.setattr(variants, "LEAF", 4)
    long = "abcdefgh" * 6
    n = {long: 100, long[:20] + "x" + long[20:]: 10, long[:20] + "y" + long[21:]: 20, long[1:]: 30, long + "z": 3, "q" * 31: 9, "q" * 32: 9,
         "q" * 33: 40, "q" * 34: 3, "aaaab": 3, "aaaac": 6, "aaaad": 6, "aaaaä": 5, "aaaaÿ": 12, "aaaabä": 3}
    n |= {"".join(p): 3 + i % 4 for i, p in enumerate({tuple(random.Random(s).sample("enaticzz", 8)) for s in range(60)})}
    assert grouped(spark, n) == brute(n)


def test_chains_end_at_their_root(spark):
    w = "abcdefghijklmnop"
    n = {w[:i]: 3 * 2 ** (i - 5) for i in range(5, 17)}
    got = grouped(spark, n)
    assert got == brute(n) and {r[2] for r in got} == {w}


def test_empty(spark):
    assert grouped(spark, {}) == []
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.count_words(df).collect() == []


def test_crc_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    cuts = np.sort(rng.choice(5000, 80, replace=False))
    starts, ends = cuts[:-1], cuts[1:]
    got = variants.crc_of_spans(data, starts, ends, np.full(len(starts), zlib.crc32(b"id:"), np.uint32))
    assert got.tolist() == [zlib.crc32(b"id:" + data[a:b].tobytes()) for a, b in zip(starts, ends)]
