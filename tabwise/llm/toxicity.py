"""Toxicity scores by a counterfactually regularised classifier (operator 9).

A linear classifier over the words that occur in a text, and over the beginnings of longer words
(so that inflected and joined forms count too), is fitted on labelled texts. Identity terms
(names of groups) in labelled sentences are swapped for the other terms of their kind and for a
neutral one; the change of score that a swap makes is penalised, so a group's name by itself does
not make a text toxic. The features of both sentences are compared as sets, so a feature that another word of the
sentence has too is not changed by the swap. A sentence ends at ``.``, ``!``, ``?`` or a line break.

Words are compared by 64-bit hash, so no two words share a weight. Candidate words are those whose
share of toxic and other texts differs by ``least_z`` standard errors; a first fit has an L1 term,
which leaves weight only where the labels speak clearly, so a long text does not add up noise, and
the words it leaves are fitted again without that term.

The fit uses a bounded sample: about ``most_rows`` labelled rows; of a key with many rows no more than its share.
Scores cover every row and the whole of every text.

Defined cases: null and empty texts have the score of a text without known words; rows with a null
label or key are not learned from; a text with several labels gives several examples; with one class
or none to learn, every score is the share of label 1 (0 without any); repeated rows are scored
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import text_slices, written
from tabwise.llm.words import LOWER, PUNCTUATION, hash_spans, word_bounds

#: Default identity terms, by kind; the first of a kind is the neutral term.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "woman", "man", "transgender"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish"),
    ("person", "gay", "lesbian", "straight", "bisexual", "queer"),
    ("folk", "black", "white", "asian", "african", "latino", "immigrants", "refugees"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "inmigrantes"),
    ("gens", "femmes", "hommes", "musulmans", "immigrés"),
    ("leute", "frauen", "männer", "muslime", "christen", "ausländer"),
)


#: Bytes of the word beginnings that are features too.
HEADS = (4, 5, 6)


def _features(data, starts, ends):
    """Features of each word, a row a word: the word, and its beginnings where it is longer (else the word again)."""
    h = hash_spans(data, starts, ends, HEADS)
    size = ends - starts
    for c, k in enumerate(HEADS, 1):
        h[:, c] = np.where(size > k, h[:, c] ^ np.uint64(k), h[:, 0])
    return h


def text_words(batch, column="text"):
    """``(first_row, n_rows, hashes, first)`` of slices: features of the lower-case words and each row's range of words."""
    for first, n, data, offsets in text_slices(batch, column):
        data = LOWER[data]
        starts, ends, of = word_bounds(data, offsets, PUNCTUATION)
        yield first, n, _features(data, starts, ends), of


def term_features(words) -> np.ndarray:
    """Features of single words, a row a word."""
    data = LOWER[np.frombuffer(b" ".join(w.encode() for w in words), np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), PUNCTUATION)
    if len(starts) != len(words):
        raise ValueError("identity terms must be single words")
    return _features(data, starts, ends)


def _count_words(batches):
    """Per task: in how many texts, and texts of label 1, each word occurs."""
    words, ones, held = [], [], 0

    def counts():
        h, of = np.unique(np.concatenate(words), return_inverse=True)
        one = np.bincount(of, np.concatenate(ones), len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(of, minlength=len(h))), pa.array(one)],
                                          ["word", "texts", "ones"])

    for b in batches:
        label = b.column("label").to_numpy()
        for first, n, h, of in text_words(b):
            for i in range(n):
                u = np.unique(h[of[i]:of[i + 1]])
                words.append(u)
                ones.append(np.full(len(u), label[first + i] == 1))
                held += len(u)
            if held > 4_000_000:
                yield counts()
                words, ones, held = [], [], 0
    if words:
        yield counts()


def _find_words(chosen):
    """(row, word) for the words of ``chosen`` (sorted) that a row has."""
    def run(batches):
        known = chosen.value
        for b in batches:
            for first, n, h, of in text_words(b):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                where, c = np.nonzero(known[at] == h)
                rows = np.searchsorted(of, where, "right") - 1
                pairs = np.unique(rows * len(known) + at[where, c])
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(first + pairs // len(known))),
                     pa.array(known[pairs % len(known)].view(np.int64))], ["row", "word"])

    return run


_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def _swap_sentences(kinds):
    """Swaps in the sentences of a task's texts: (features that come, features that go, number of such swaps)."""
    heads = np.concatenate([k[:, 0] for k in kinds])
    kind_of = {int(h): (i, j) for i, k in enumerate(kinds) for j, h in enumerate(k[:, 0])}
    features = [[frozenset(map(int, row)) for row in k] for k in kinds]

    def swaps(h: np.ndarray, sentence: np.ndarray, counts: Counter) -> None:
        named = np.isin(h[:, 0], heads)
        for s in np.unique(sentence[named]):
            words = h[sentence == s]
            for term in {int(x) for x in words[:, 0]} & kind_of.keys():
                i, j = kind_of[term]
                rest = set(map(int, words[words[:, 0] != np.uint64(term)].ravel()))
                for other, f in enumerate(features[i]):
                    if other != j:
                        come, go = f - rest - features[i][j], features[i][j] - rest - f
                        if come or go:
                            counts[tuple(sorted(come)), tuple(sorted(go))] += 1

    def run(batches):
        counts = Counter()
        for b in batches:
            for _, n, data, offsets in text_slices(b, "text"):
                data = LOWER[data]
                starts, ends, of = word_bounds(data, offsets, PUNCTUATION)
                h = _features(data, starts, ends)
                ended = np.cumsum(_ENDS[data])[starts] if len(starts) else starts
                for i in range(n):
                    part = slice(of[i], of[i + 1])
                    swaps(h[part], ended[part], counts)
        pairs = [np.array([*c, *g], np.uint64).view(np.int64) for c, g in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(x[:len(c)]) for x, (c, _) in zip(pairs, counts)], pa.list_(pa.int64())),
             pa.array([list(x[len(c):]) for x, (c, _) in zip(pairs, counts)], pa.list_(pa.int64())),
             pa.array(list(counts.values()), pa.int64())], ["come", "go", "n"])

    return run


def swapped(sample: DataFrame, kinds: list) -> list:
    """``(features that come, features that go, count)`` of every swap in the sentences of ``sample``. Equal changes are one row, so
    what reaches the driver is bounded by the terms (a pair of terms has 8 features), whatever the number of sentences."""
    found = sample.mapInArrow(_swap_sentences(kinds), "come array<long>, go array<long>, n long").groupBy("come", "go").agg(F.sum("n").alias("n"))
    return [([x & (1 << 64) - 1 for x in r["come"]], [x & (1 << 64) - 1 for x in r["go"]], r["n"]) for r in found.toArrow().to_pylist()]


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], float(bias)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def score(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, from its words."""
        n, total = len(first) - 1, np.full(len(first) - 1, self.bias)
        if len(self.words) and len(hashes):
            maybe, kind = np.nonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            h = hashes[maybe, kind]
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            rows = np.searchsorted(first, maybe[hit], "right") - 1
            pairs = np.unique(rows * len(self.words) + at[hit])
            total += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], n)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_weights(rows, cols, y, n_words, swaps, l1, l2, fairness, steps=400):
    """Logistic weights with L1, L2 and counterfactual terms, by accelerated proximal gradient descent.

    ``rows``/``cols`` are the (text, word) pairs. ``swaps`` are ``(columns that come, columns that go, count)``: ``count`` sentences change
    so by a swap of identity terms; each adds ``fairness`` times the square of the change of score.
    """
    n = len(y)
    prior = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))  # a text without known words keeps near this
    w, bias = np.zeros(n_words), prior
    swap = np.repeat(np.arange(len(swaps)), [len(c) + len(g) for c, g, _ in swaps]).astype(int)
    column = np.array([x for c, g, _ in swaps for x in (*c, *g)], int)
    sign = np.array([v for c, g, _ in swaps for v in (*[1.0] * len(c), *[-1.0] * len(g))])
    times = 2 * fairness * np.array([t for _, _, t in swaps], float)
    width = np.bincount(swap, minlength=len(swaps))
    per_text = np.bincount(rows, minlength=n)
    # an upper bound of the curvature, by word: its texts and swaps weighted by how many words they have
    curve = 0.25 * np.bincount(cols, per_text[rows] + 1.0, n_words) + l2 + 1e-9 + np.bincount(column, (times * width)[swap], n_words)
    curve_bias = 0.25 * (n + per_text.sum()) + 1
    z, z_bias, t = w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z_bias + np.bincount(rows, z[cols], n), -500, 500)))
        g = np.bincount(cols, (p - y)[rows], n_words) + l2 * z
        if len(swap):
            change = np.bincount(swap, sign * z[column], len(swaps))
            g += np.bincount(column, (times * change)[swap] * sign, n_words)
        new = z - g / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        new_bias = z_bias - ((p - y).sum() + z_bias - prior) / curve_bias
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, z_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


def draw(labelled: DataFrame, most_rows: int, key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """``(row, label, text)``: about ``most_rows`` labelled rows at most.

    Keys are drawn by a checksum, each with a number of rows: its share of the bound, rounded up or down by the checksum. No text
    is read before, and the keys (about ``most_rows`` at most) are a filter that reaches the scans; of a key with more rows than
    were drawn, rows are kept by their own number.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n")), "labelled-keys")
    share = min(1.0, most_rows / max(keys.agg(F.sum("n")).first()[0] or 0, 1))
    taken = F.floor(F.col("n") * F.lit(share) + F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("long")
    chosen = keys.select("key", F.least(taken, "n").alias("taken"), "n").where("taken > 0").collect()
    some = {r["key"]: r["taken"] / r["n"] for r in chosen if r["taken"] < r["n"]}
    rows = rows.where(F.col("key").isin([r["key"] for r in chosen])).withColumn("row", F.monotonically_increasing_id())
    if some:
        part = labelled.sparkSession.createDataFrame(list(some.items()), f"key {labelled.schema[key].dataType.simpleString()}, part double")
        own = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rows = rows.join(F.broadcast(part), "key", "left").where(F.col("part").isNull() | (own < F.col("part")))
    return written(rows.select("row", "label", "text"), "labelled")


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", identity=IDENTITY,
        most_rows: int = 16_000, least_texts: int = 5, least_z: float = 4.0, l1: float = 0.1, l2: float = 0.005,
        fairness: float = 1.0) -> Model:
    """Fit on about ``most_rows`` rows of ``labelled`` at most; ``l1`` is in units of the root of their number."""
    sample = draw(labelled, most_rows, key, text, label)
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    empty = np.empty(0, np.uint64), np.empty(0)
    if positive in (0, n):
        return Model(*empty, 500.0 if n and positive else -500.0)
    share = positive / n
    ones = F.col("ones") / positive
    zeros = (F.col("texts") - F.col("ones")) / (n - positive)
    pooled = F.col("texts") / n
    z = F.abs(ones - zeros) / F.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / (n - positive)))
    named = [term_features(kind) for kind in identity]
    telling = (sample.mapInArrow(_count_words, "word long, texts long, ones long")
               .groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("ones").alias("ones"))
               .where((F.col("texts") >= least_texts) & (F.col("texts") < n)).where(z >= least_z).select("word").toArrow())
    chosen = np.unique(np.concatenate([telling.column("word").to_numpy().view(np.uint64), *(f.ravel() for f in named)]))
    got = sample.mapInArrow(_find_words(labelled.sparkSession.sparkContext.broadcast(chosen)), "row long, word long").toArrow()
    examples = sample.select("row", "label").toArrow()
    ids = examples.column("row").to_numpy()
    order = np.argsort(ids)
    y = examples.column("label").to_numpy()[order].astype(np.float64)
    at = np.searchsorted(ids[order], got.column("row").to_numpy())
    words, cols = np.unique(got.column("word").to_numpy().view(np.uint64), return_inverse=True)
    if not len(words):
        return Model(*empty, math.log(share / (1 - share)))

    index = {int(h): i for i, h in enumerate(words)}
    changes = [([index[x] for x in come if x in index], [index[x] for x in go if x in index], count)
               for come, go, count in swapped(sample, named)]
    weights, _ = fit_weights(at, cols, y, len(words), changes, l1 * math.sqrt(n), l2, fairness)
    # the L1 term has chosen the words; fitted again without it, their weights are no longer shrunk
    kept = np.flatnonzero(weights)
    place = np.full(len(words), -1)
    place[kept] = np.arange(len(kept))
    inside = place[cols] >= 0
    changes = [([place[x] for x in come if place[x] >= 0], [place[x] for x in go if place[x] >= 0], count) for come, go, count in changes]
    weights, bias = fit_weights(at[inside], place[cols[inside]], y, len(kept), changes, 0.0, l2, fairness, steps=3000)
    return Model(words[kept], weights, bias)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)  # the words with a weight: bounded by the fit's sample

    def run(batches):
        for b in batches:
            for first, n, h, of in text_words(b):
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").slice(first, n), pa.array(sent.value.score(h, of))], ["key", "score"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")


def reject(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns, that score below ``threshold``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            only = pa.RecordBatch.from_arrays([b.column(at)], ["text"])
            for first, n, h, of in text_words(only):
                keep = sent.value.score(h, of) < threshold
                yield b.slice(first, n).filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
