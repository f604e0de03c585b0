import collections
import math
import re

import numpy as np
import pytest

from tabwise.llm import ngram_lm as L


def tokens(t):
    t = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), "</s>"]


class Brute:
    def __init__(self, texts):
        self.c, self.bi = collections.Counter(), collections.Counter()
        for t in texts:
            before = "<s>"
            for w in tokens(t):
                self.c[w] += 1
                self.bi[before, w] += 1
                before = w
        of = collections.Counter(self.bi.values())
        self.d = L.discounts(*(of[i] for i in (1, 2, 3, 4)))
        self.a = collections.Counter(w for _, w in self.bi)
        of = collections.Counter(self.a.values())
        self.e = L.discounts(*(of[i] for i in (1, 2, 3, 4)))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.left, self.freed = collections.Counter(), collections.Counter()
        for (u, _), k in self.bi.items():
            self.left[u] += k
            self.freed[u] += self.d[min(k, 3) - 1]
        self.g0 = sum(self.e[min(k, 3) - 1] for k in self.a.values()) / len(self.bi)

    def p1(self, w):
        k = self.a[w]
        return (k - self.e[min(k, 3) - 1] if k else 0) / len(self.bi) + self.g0 / (self.v + 1)

    def p(self, w, u):
        if u not in self.left:
            return self.p1(w)
        k = self.bi.get((u, w), 0)
        return ((k - self.d[min(k, 3) - 1] if k else 0) + self.freed[u] * self.p1(w)) / self.left[u]

    def score(self, t):
        words = tokens(t)
        return (len(words), sum(self.c[w] > 0 for w in words), self.n,
                sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in words),
                sum(math.log10(self.p(w, u)) for u, w in zip(["<s>", *words], words)))


def check(spark, learn, texts, parts=None):
    one = lambda x: spark.createDataFrame([(i, t, "x") for i, t in enumerate(x)], "doc_id long, text string, score string").repartition(4)
    got = {r["key"]: tuple(r)[1:] for r in L.score(one(texts), L.fit(one(learn), parts=parts)).collect()}
    brute = Brute(learn)
    for i, t in enumerate(texts):
        want = brute.score(t)
        assert got[i][:3] == want[:3]
        assert got[i][3:] == pytest.approx(want[3:], rel=1e-6, abs=1e-6)
    return brute


def test_against_brute_force(spark, documents):
    texts = [r["text"] for r in documents.orderBy("doc_id").collect()]
    brute = check(spark, texts[::2], texts)
    for u in ["<s>", *list(brute.left)[:20], "never seen"]:
        assert sum(brute.p(w, u) for w in brute.c) + brute.p("never seen either", u) == pytest.approx(1)


def test_any_number_of_ranges(spark, documents, monkeypatch):
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(40).collect()] + ["the the the " * 300]
    monkeypatch.setattr(L, "HELD", 500)
    monkeypatch.setattr(L, "SLICE", 3000)
    for parts in (1, 3, 50):
        check(spark, texts[:30] + texts[-1:], texts, parts)


def test_defined_cases(spark):
    check(spark, [None, "", "a", "A b", "a b", "a b"], [None, "", " \n", "a", "c", "b a c"])
    rows = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in L.score(rows, L.fit(rows.limit(0))).collect()] == [(1, 0, 0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0)]
    assert L.score(rows.limit(0), L.fit(rows)).collect() == []


def test_blocks_pack_exactly():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        for top in (1 << 10, 1 << 40, (1 << 64) - 1):
            keys = np.unique(rng.integers(0, top, n, np.uint64, endpoint=True))
            counts = rng.integers(1, rng.choice([2, 300, 1 << 40]), len(keys)).astype(np.uint64)
            a, b = L.unpack(L.pack(keys, counts))
            assert (a == keys).all() and (b == counts).all()


def test_frequent_left_words_are_cut():
    words = L.Words(2, [(0, "", 50), (1, "", 50)])
    found = [{"part": 0, "tokens": 1000, "marks": [7] * (L.MARKS - 1)}, {"part": 1, "tokens": 1000, "marks": list(np.arange(L.MARKS - 1) // 6)}]
    cuts = L._cuts(words, found, 10, 16)
    assert len(cuts) == 15 and sum(int(c) >> words.bits == 7 for c in cuts) >= 6


class BruteOrder:
    """Modified Kneser-Ney of any order over plain counters."""

    def __init__(self, texts, order):
        self.n, count = order, [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            run = ["<s>", *tokens(t)]
            for m in range(1, order + 1):
                for i in range(len(run) - m + 1):
                    count[m][tuple(run[i:i + m])] += 1
        del count[1]["<s>",]
        self.c = count[:]
        for m in range(1, order):
            self.c[m] = collections.Counter(r[1:] for r in count[m + 1])
            self.c[m].update({r: k for r, k in count[m].items() if r[0] == "<s>"})
        self.d, self.total, self.freed = [()], collections.Counter(), collections.Counter()
        for m in range(1, order + 1):
            of = collections.Counter(self.c[m].values())
            self.d.append(L.discounts(*(of[i] for i in (1, 2, 3, 4))))
            for r, k in self.c[m].items():
                self.total[r[:-1]] += k
                self.freed[r[:-1]] += self.d[m][min(k, 3) - 1]
        self.v = len(self.c[1])

    def p(self, w, h):
        k = self.c[len(h) + 1][(*h, w)]
        lower = self.p(w, h[1:]) if h else 1 / (self.v + 1)
        if not self.total[h]:
            return lower
        return ((k - self.d[len(h) + 1][min(k, 3) - 1] if k else 0) + self.freed[h] * lower) / self.total[h]

    def score(self, t):
        run = ["<s>", *tokens(t)]
        return sum(math.log10(self.p(run[i], tuple(run[max(0, i - self.n + 1):i]))) for i in range(1, len(run)))


@pytest.mark.parametrize("order, parts", [(2, None), (3, None), (3, 1), (3, 50), (4, 5)])
def test_longer_contexts_against_brute_force(spark, documents, monkeypatch, order, parts):
    monkeypatch.setattr(L, "HELD", 2000)
    monkeypatch.setattr(L, "SLICE", 9000)
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()] + ["the the the " * 300, None, "", "a", "a b", "a b"]
    one = lambda x: spark.createDataFrame(list(enumerate(x)), "doc_id long, text string").repartition(3)
    learn = texts[::2] + texts[-5:]
    brute = BruteOrder(learn, order)
    got = {r["key"]: r["score"] for r in L.score(one(texts), L.fit(one(learn), parts=parts, order=order)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([brute.score(t) for t in texts], rel=1e-6, abs=1e-6)
    for h in [r[:-1] for r in list(brute.c[order])[:15]]:
        assert sum(brute.p(w, h) for (w,) in brute.c[1]) + brute.p("never seen", h) == pytest.approx(1)


def test_the_second_word_before_counts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a x b", "c x d"] * 5)], "doc_id long, text string")
    ask = spark.createDataFrame([(0, "a x b"), (1, "a x d")], "doc_id long, text string")
    right, wrong = (r["score"] for r in L.score(ask, L.fit(rows, order=3)).orderBy("key").collect())
    assert right > wrong + 0.5


def test_texts_shorter_than_the_order(spark):
    for texts in ([None, ""], ["a", "b", "a"], ["a b"]):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        brute = BruteOrder(texts, 5)
        got = L.score(rows, L.fit(rows, order=5)).orderBy("key").collect()
        assert [r["score"] for r in got] == pytest.approx([brute.score(t) for t in texts], rel=1e-6)


def test_parts_are_not_held_while_they_are_merged(monkeypatch):
    """The peak of a counting task: the parts are let go before their copies are sorted."""
    held, seen, summed = L._Held(), [], L.summed

    def watched(keys, counts=None):
        if counts is not None:
            seen.append(len(held.parts))
        return summed(keys, counts)

    monkeypatch.setattr(L, "summed", watched)
    for i in range(3):
        held.add(np.array([5, 1, 5, i], np.uint64))
    keys, counts = held.take()
    assert seen == [0] and keys.tolist() == [0, 1, 2, 5] and counts.tolist() == [1, 4, 1, 6]
