"""Language identification by error-correcting output codes (operator 6).

Each language has a codeword of bits. A binary classifier over byte trigrams predicts each bit; the
codeword nearest to the predictions, with each bit weighted by how well its classifier did in
training, names the language. The difference to the second nearest codeword flags
ambiguous texts.

The trigram counts of each language cover all training rows (a table of at most ``BUCKETS`` rows a
language reaches the driver). A bit's classifier sums the log odds of the trigrams under the languages with and
without the bit; a scale and an offset for each bit, and the bit's weight, come from a bounded
sample of training rows (``most_rows`` of each language, about).

Texts are lower-cased over A-Z; ASCII other than letters counts as blank. Trigrams with two blanks
side by side say nothing and are passed over.

Defined cases: null texts and texts without any letter are ``und`` with score 0; a text whose
trigrams are all unknown gets the nearest codeword of no evidence and is ambiguous (``identify`` with ``reject`` makes it ``und`` with score 0,
if there are two languages or more); rows with null
text or language are not learned from; with no language to learn all texts are ``und``, with one all
texts with a letter get it; repeated rows are treated alike; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.llm.common import drawn, text_slices

BUCKETS = 1 << 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint8)  # lower case; ASCII that is no letter becomes a blank
_FOLD[:128] = 32
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """``(bucket, row)`` of the byte trigrams of each row; a blank stands before and after each row."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    to = offsets[:-1] + 2 * np.arange(n) + 1  # where each row's bytes go, with a blank on both sides
    wide = np.full(len(data) + 2 * n, 32, np.uint32)
    row = np.repeat(np.arange(n), size + 2)
    wide[np.arange(len(data)) + np.repeat(to - offsets[:-1], size)] = _FOLD[data]
    blank = wide == 32
    a, b, c = wide[:-2], wide[1:-1], wide[2:]
    bucket = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) ^ c * np.uint32(0xC2B2AE35)) >> np.uint32(16)) & np.uint32(BUCKETS - 1)
    good = (row[:-2] == row[2:]) & ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    return bucket[good].astype(np.int64), row[:-2][good]


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Bits (languages by bits) with languages far apart: all splits of up to 5 languages, else the best of some random codes."""
    if n <= 5:
        halves = [c for c in itertools.product((0, 1), repeat=max(n - 1, 0)) if any(c)]
        return np.array([(0, *c) for c in halves], np.int8).T if halves else np.zeros((n, 0), np.int8)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits)).astype(np.int8)
        split = (code.sum(0) > 0) & (code.sum(0) < n)
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(n, dtype=int) * bits
        if split.all() and apart.min() > best[0]:
            best = int(apart.min()), code
    return best[1]


class Model:
    """Languages, their codewords, log odds of the trigrams by bit, and each bit's scale, offset and weight."""

    def __init__(self, languages, code, odds, scale, offset, weight):
        self.languages, self.code = languages, code
        self.odds, self.scale, self.offset, self.weight = odds, scale, offset, weight

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log odds by row and bit; short rows are drawn to zero."""
        n, bits = len(offsets) - 1, self.code.shape[1]
        bucket, row = trigrams(data, offsets)
        out = np.zeros((n, bits))
        first = np.searchsorted(row, np.arange(n + 1))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            out[some] = np.add.reduceat(self.odds[bucket], first[:-1][some], axis=0)
        return out / (np.diff(first)[:, None] + 5.0)

    def decode(self, margins: np.ndarray):
        """``(language index, score, difference to the second)`` by weighted logistic loss to each codeword."""
        f = margins * self.scale + self.offset
        sign = 2.0 * self.code - 1
        loss = np.stack([(self.weight * np.logaddexp(0, -f * s)).sum(1) for s in sign], 1)
        like = np.exp(loss.min(1, keepdims=True) - loss)
        order = np.sort(loss, 1)
        second = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        second = np.where((margins == 0).all(1), 0.0, second)  # no known trigram
        return loss.argmin(1), like.max(1) / like.sum(1), second


def _counter(languages):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for b in batches:
            lang = np.array([index[x] for x in b.column("lang").to_pylist()], np.int64)
            for first, n, data, offsets in text_slices(b, "text"):
                bucket, row = trigrams(data, offsets)
                total += np.bincount(lang[first + row] * BUCKETS + bucket, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return run


def _marginer(sent):
    def run(batches):
        for b in batches:
            for first, n, data, offsets in text_slices(b, "text"):
                m = sent.value.margins(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(first, n), pa.array(list(m), pa.list_(pa.float64()))], ["lang", "margins"])

    return run


def _calibrate(m: np.ndarray, y: np.ndarray):
    """Scale and offset of a one-dimensional logistic fit (Newton steps with a small ridge)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * m).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit(df: DataFrame, text: str = "text", lang: str = "lang", most_rows: int = 500) -> Model:
    """Learn from all rows with text and language; a bit's scale and weight from ``most_rows`` rows a language at most."""
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(per)
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0)), *(np.zeros(0),) * 3)
    code = codewords(len(languages))
    cells = (rows.mapInArrow(_counter(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    rates = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    odds = np.stack([np.log(rates[c == 1].mean(0) / rates[c == 0].mean(0)) for c in code.T], 1) if code.size else np.zeros((BUCKETS, 0))
    odds[counts.sum(0) == 0] = 0  # unknown trigrams say nothing
    bits = code.shape[1]
    model = Model(languages, code, odds.astype(np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))
    if not bits:
        return model
    sample = sample_rows(rows, per, most_rows)
    got = sample.mapInArrow(_marginer(spark.sparkContext.broadcast(model)), "lang string, margins array<double>").toArrow()
    if not len(got):
        return model
    at = np.searchsorted(languages, got.column("lang").to_numpy(zero_copy_only=False))
    m = np.array(got.column("margins").to_pylist())
    for k in range(bits):
        y = code[at, k].astype(float)
        model.scale[k], model.offset[k] = _calibrate(m[:, k], y)
        f = m[:, k] * model.scale[k] + model.offset[k]
        model.weight[k] = max(1e-3, 1 - np.logaddexp(0, -f * (2 * y - 1)).mean() / np.log(2))
    model.weight /= model.weight.mean()
    return model


def sample_rows(rows: DataFrame, per: dict, most_rows: int) -> DataFrame:
    """About ``most_rows`` of the rows ``(text, lang)`` of each language, whatever texts they hold."""
    share = F.lit(0)
    for k, v in per.items():
        share = F.when(F.col("lang") == k, F.lit(int(min(1.0, most_rows / v) * (1 << 30)))).otherwise(share)
    return drawn(rows, share, "lang-sample").select("lang", "text")


def identify(df: DataFrame, model: Model, keep=("doc_id",), text: str = "text", ambiguous_below: float = 0.1,
             names: tuple = ("lang_pred", "score", "ambiguous"), reject: bool = False) -> DataFrame:
    """The ``keep`` columns of every row with the predicted language, its score (0 to 1) and whether it is ambiguous.

    With ``reject``, a text in which the model knows no trigram is in no known language.
    """
    sent, keep = df.sparkSession.sparkContext.broadcast(model), list(keep)  # BUCKETS rows by bits, whatever the input
    fields = [df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(names, (
        T.StringType(), T.DoubleType(), T.BooleanType()))]

    def run(batches):
        known = np.array([*sent.value.languages, UNKNOWN], object)
        for b in batches:
            texts = b.column(len(keep))
            only = pa.RecordBatch.from_arrays([texts], ["text"])
            for first, n, data, offsets in text_slices(only, "text"):
                lettered = np.array([t.is_valid and _LETTER.search(t.as_py()) is not None for t in texts.slice(first, n)], bool)
                if len(known) > 1:
                    margins = sent.value.margins(data, offsets)
                    best, score, second = sent.value.decode(margins)
                    if reject and margins.shape[1]:
                        lettered &= margins.any(1)
                else:
                    best, score, second = np.zeros(n, int), np.zeros(n), np.zeros(n)
                best = np.where(lettered, best, len(known) - 1)
                columns = [b.column(i).slice(first, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [
                    pa.array(known[best], pa.string()), pa.array(np.where(lettered, score, 0.0)),
                    pa.array(~lettered | (second < ambiguous_below))], [f.name for f in fields])

    return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, T.StructType(fields))
