"""Interpolated modified Kneser-Ney language model over runs of 1 to ``order`` words (operator 3).

Counting, in Spark: each task sums up its words (64-bit hashes) and returns sorted blocks by hash
range; a merge a range writes the sorted hash array with its counts to the shared folder. A word's
number is its place in these arrays. Runs of 2, 3, ... words are then counted, a pass over the texts each, as
sorted arrays of ``number of the run without its last word << bits | last word's number``; their ranges are cut at
equal numbers of tokens, inside a frequent shorter run too, so no range grows with one word. The merge of a range also
returns, for the runs one word shorter, with how many different words on the left each occurs. From the highest order down,
these become the counts of the shorter runs, and what follows each context (words by count 1, 2, 3 and more) its sum and the
weight of the lower order.

Model: ``p(w | h) = (c(h w) - D(c(h w))) / s(h) + g(h) * p(w | h')``, where ``h'`` is the context ``h`` without its first word,
down to ``p1(w) = (a(w) - D(a(w))) / A + g0 / (V + 1)``. In the highest order ``c`` counts occurrences; in a lower one it counts
distinct left neighbours (a text's beginning is one), as ``a`` does, but occurrences of a run that starts a text, which nothing
precedes. ``s`` sums ``c`` over the words that follow, ``A`` is the number of distinct bigrams, D are the discounts of each order for
counts 1, 2 and 3 or more, and ``g`` is what the discounts free. Near a text's beginning the context is what there is of it. All
words outside the vocabulary share one place of the ``V + 1``, so the probabilities sum to one. After an unknown context,
``p(w | h) = p(w | h')``.

Scoring: the workers memory-map the arrays (from a store without a mount, they read the ranges
whole) and look the words and runs of a slice of texts up in sorted order.

Words: runs of anything but U+0020 and U+0009 to U+000D, lower-cased over A-Z; each text ends with an end
token. Defined cases: null and empty texts are an end token alone; with no training rows the model
gives every token the probability 1 (there is one place, the unknown word's); repeated rows count as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import make_folder, mapped, open_to_write, shared_folder, text_slices, written
from tabwise.llm.words import LOWER, hash_spans, word_bounds

END = np.uint64(0x5BD1E9955BD1E995)  # stands for the end token among the words' hashes
HELD = 4_000_000  # entries that a counting task holds before it returns a block
SLICE = 2 << 20
MARKS = 256  # points a range reports for cutting the runs one word longer


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, as differences in as few byte planes as they need."""
    steps = np.diff(keys)
    out = [struct.pack("<QQBB", len(keys), int(keys[0]), *(_width(x) for x in (steps, counts)))]
    for x, w in ((steps, out[0][-2]), (counts, out[0][-1])):
        out.append(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes())
    return b"".join(out)


def _width(x):
    return (int(x.max()).bit_length() + 7) // 8 if len(x) else 0


def unpack(block: bytes):
    n, first, kw, cw = struct.unpack_from("<QQBB", block)
    at, out = 18, []
    for length, w in ((n - 1, kw), (n, cw)):
        x = np.zeros((length, 8), np.uint8)
        if length * w:
            x[:, :w] = np.frombuffer(block, np.uint8, length * w, at).reshape(w, length).T
        out.append(x.view("<u8").reshape(-1))
        at += length * w
    keys = np.empty(n, np.uint64)
    keys[0] = first
    np.cumsum(out[0], out=keys[1:])
    keys[1:] += np.uint64(first)
    return keys, out[1]


def summed(keys: np.ndarray, counts: np.ndarray | None = None):
    """Distinct keys, sorted, and the sums of their counts (1 each without counts)."""
    if not len(keys):
        return keys, np.empty(0, np.uint64)
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if order is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    return keys[first], np.add.reduceat(counts[order], first)


class _Held:
    """Keys counted so far by a task."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys):
        self.parts.append(summed(keys))
        self.n += len(self.parts[-1][0])
        if self.n > HELD and len(self.parts) > 1:
            self._merge()
        return self.n > HELD

    def _merge(self):
        arrays = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts = []  # not held beside their copies while these are sorted
        self.parts = [summed(*arrays)]
        self.n = len(self.parts[0][0])

    def take(self):
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        self._merge()
        out, self.parts, self.n = self.parts[0], [], 0
        return out


def _tokens(data, offsets):
    """Hashes of the tokens of each row (its words, then the end), and the row offsets."""
    data = LOWER[data]
    starts, ends, of = word_bounds(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    row = np.repeat(np.arange(n), np.diff(of))
    out[np.arange(len(starts)) + row] = hash_spans(data, starts, ends)
    return out, of + np.arange(n + 1)


def _blocks(keys, counts, part, names=("part", "block")):
    """A record batch of packed blocks, cut where the sorted ``part`` changes."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(part)) if len(at) else at
    return pa.RecordBatch.from_arrays(
        [pa.array(part[at].astype(np.int32)), pa.array([pack(keys[a:b], counts[a:b]) for a, b in zip(at, ends)], pa.binary())],
        list(names))


def _range_of(hashes, parts):
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _count_words(parts):
    def run(batches):
        held = _Held()
        for b in batches:
            for _, _, data, offsets in text_slices(b, "text", SLICE):
                if held.add(_tokens(data, offsets)[0]):
                    keys, counts = held.take()
                    yield _blocks(keys, counts, _range_of(keys, parts))
        keys, counts = held.take()
        yield _blocks(keys, counts, _range_of(keys, parts))

    return run


def _save(folder, kind, *arrays):
    name = f"{folder}/{kind}-{uuid.uuid4().hex}"
    for i, x in enumerate(arrays):
        with open_to_write(f"{name}.{i}") as f:
            f.write(np.ascontiguousarray(x).tobytes())
    return name


def _merge(batches, column="block"):
    held = []
    for b in batches:
        held.extend(unpack(x) for x in b.column(column).to_pylist())
    return summed(*(np.concatenate(x) for x in zip(*held)))


def _merge_words(folder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches)
        part = head.column("part")[0].as_py()
        keys, counts = _merge([head, *batches])
        total = np.cumsum(counts)
        marks = np.searchsorted(total, np.arange(1, MARKS) * (float(total[-1]) / MARKS))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([_save(folder, "words", keys.astype("<u8"), counts.astype("<u8"))]),
             pa.array([len(keys)], pa.int64()), pa.array([int(total[-1])], pa.int64()), pa.array([marks.tolist()], pa.list_(pa.int64()))],
            ["part", "file", "n", "tokens", "marks"])

    return run


class Words:
    """The sorted word hashes, range by range; a word's number is its place."""

    def __init__(self, parts: int, files: list):
        self.parts, self.files = parts, sorted(files)  # (part, file, n)
        self.first = np.concatenate([[0], np.cumsum([n for _, _, n in self.files])]).astype(np.int64)
        self.size = int(self.first[-1])
        self.bits = max(1, (self.size + 1).bit_length())
        self.begin = self.size  # the number of a text's beginning
        if self.bits > 32:
            raise ValueError("more than 2**32 different words: two numbers no longer fit one key")

    def array(self, k: int, i: int, dtype):
        return mapped(f"{self.files[k][1]}.{i}", dtype, self.files[k][2])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted ``hashes``, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        where = _range_of(hashes, self.parts).astype(np.int64)
        for k, (part, _, n) in enumerate(self.files):
            a, b = np.searchsorted(where, part, "left"), np.searchsorted(where, part, "right")
            if a < b:
                known = self.array(k, 0, "<u8")
                at = np.minimum(np.searchsorted(known, hashes[a:b]), n - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], self.first[k] + at, -1)
        return out


def _numbered(words: Words, data, offsets):
    """``(distinct word numbers, index of each token into them, row offsets)``."""
    tokens, of = _tokens(data, offsets)
    distinct, index = np.unique(tokens, return_inverse=True)
    return words.numbers(distinct), index, of


def _left_neighbours(x, of, begin):
    """What stands before each token; ``begin`` before a row's first."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[of[:-1]] = begin
    return left


def _small(x: np.ndarray) -> np.ndarray:
    """``x`` in the narrowest unsigned type that holds it."""
    return x.astype(f"<u{next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)}")


def _taken(first: np.ndarray, files: list, numbers: np.ndarray) -> np.ndarray:
    """Values at ``numbers`` of arrays that lie range by range in ``files`` (name, type); 0 for -1 and beyond the last."""
    out = np.zeros(len(numbers))
    order = np.argsort(numbers, kind="stable")
    bounds = np.searchsorted(numbers[order], first)
    for (name, kind), a, b, start, n in zip(files, bounds[:-1], bounds[1:], first[:-1], np.diff(first)):
        if a < b:
            out[order[a:b]] = mapped(name, kind, int(n))[numbers[order[a:b]] - start]
    return out


class Grams:
    """The sorted keys of the runs of one length, range by range; a run's number is its place.

    Runs that start at a text's beginning have the highest numbers, ``begin`` and on.
    """

    def __init__(self, files: list):
        self.files = sorted(files)  # (first key, file, n, runs from a beginning)
        self.starts = np.array([f[0] for f in self.files], np.uint64)
        self.first = np.concatenate([[0], np.cumsum([f[2] for f in self.files])]).astype(np.int64)
        self.size = int(self.first[-1])
        self.begin = self.size - sum(f[3] for f in self.files)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of ``keys``, -1 for unknown ones."""
        keys, index = np.unique(keys, return_inverse=True)
        out = np.full(len(keys), -1, np.int64)
        bounds = np.append(np.searchsorted(keys, self.starts, "left"), len(keys))
        for (_, name, n, _), first, a, b in zip(self.files, self.first, bounds[:-1], bounds[1:]):
            if a < b:
                known = mapped(f"{name}.0", "<u8", n)
                at = np.minimum(np.searchsorted(known, keys[a:b]), n - 1)
                out[a:b] = np.where(known[at] == keys[a:b], first + at, -1)
        return out[index]

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """Keys of sorted ``numbers``."""
        out = np.empty(len(numbers), np.uint64)
        bounds = np.searchsorted(numbers, self.first)
        for (_, name, n, _), first, a, b in zip(self.files, self.first, bounds[:-1], bounds[1:]):
            if a < b:
                out[a:b] = mapped(f"{name}.0", "<u8", n)[numbers[a:b] - first]
        return out


class Runs:
    """The words and the runs of 2, 3, ... words counted so far; ``of[m]`` are those of m words."""

    def __init__(self, words: Words):
        self.words, self.of, self.kept, self.bits = words, {1: words}, {}, np.uint64(words.bits)
        self.mask = (np.uint64(1) << self.bits) - np.uint64(1)

    def add(self, m: int, grams: Grams, kept: dict) -> None:
        """Take in the runs of m words; ``kept`` has the type of the counts that each file keeps."""
        if grams.size.bit_length() + self.words.bits > 64:
            raise ValueError(f"too many runs of {m} words: their number and a word's no longer fit one key")
        self.of[m], self.kept[m] = grams, kept

    def keys(self, before: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (before.astype(np.uint64) << self.bits) | right.astype(np.uint64)

    def before(self, m: int, run: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Number of the m - 1 words before each token, from the runs of m - 1 words that end at each."""
        return _left_neighbours(run, of, self.words.begin if m == 2 else -1)

    def next(self, m: int, before: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the runs of m words, -1 for unknown ones."""
        run = np.full(len(right), -1, np.int64)
        both = np.flatnonzero((before >= 0) & (right >= 0))
        run[both] = self.of[m].places(self.keys(before[both], right[both]))
        return run

    def suffixes(self, m: int, keys: np.ndarray) -> np.ndarray:
        """Numbers of the runs that runs of m words become without their first."""
        right = (keys & self.mask).astype(np.int64)
        if m == 2:
            return right
        prefix, index = np.unique((keys >> self.bits).astype(np.int64), return_inverse=True)
        shorter = self.suffixes(m - 1, self.of[m - 1].keys(prefix))
        return self.of[m - 1].places(self.keys(shorter[index], right))


def _count_runs(sent, m):
    def run(batches):
        runs, cuts = sent.value
        held = _Held()

        def blocks():
            keys, counts = held.take()
            return _blocks(keys, counts, np.searchsorted(cuts, keys, "right"))

        for b in batches:
            for _, _, data, offsets in text_slices(b, "text", SLICE):
                numbers, index, of = _numbered(runs.words, data, offsets)
                right = at = numbers[index]
                for k in range(2, m):
                    at = runs.next(k, runs.before(k, at, of), right)
                before = runs.before(m, at, of)
                some = before >= 0
                if held.add(runs.keys(before[some], right[some])):
                    yield blocks()
        yield blocks()

    return run


ROWS = "kind string, part int, block binary, start string, n long, counts array<long>"


def _rows(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows), (
            pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64())))],
        ["kind", "part", "block", "start", "n", "counts"])


def _to_ranges(kind, numbers, times, shorter):
    """Rows with the packed ``numbers`` and ``times`` for each range of the runs one word shorter."""
    part = np.searchsorted(shorter.first, numbers, "right") - 1
    batch = _blocks(numbers.astype(np.uint64), times, part)
    return [(kind, p, block, None, 0, []) for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]


def _of_contexts(prefix, counts, shorter):
    """Rows with what follows each context: words of count 1, 2, 3 or more, and the summed counts of the last; the same for a text's beginning."""
    level = np.minimum(counts, 3)
    inner = prefix < shorter.size
    rows = []
    for kind in (1, 2, 3):
        rows += _to_ranges(str(kind), *summed(prefix[inner & (level == kind)].astype(np.uint64)), shorter)
    rows += _to_ranges("t", *summed(prefix[inner & (level == 3)].astype(np.uint64), counts[inner & (level == 3)]), shorter)
    out = counts[~inner]
    return rows, [int((out == 1).sum()), int((out == 2).sum()), int((out >= 3).sum()), int(out.sum())]


def _counts_of(counts):
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum()), int(counts.sum())]


def _merge_runs(sent, m, order, folder):
    """Writes a range of runs of m words; returns its file, its marks, and blocks of the different left neighbours of the shorter runs.

    The highest order's counts are written and sent to its contexts; of the others only those of the runs from a
    text's beginning, which nothing precedes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, _ = sent.value
        shorter = runs.of[m - 1]
        keys, counts = _merge(batches)
        prefix = (keys >> runs.bits).astype(np.int64)
        first = int(np.searchsorted(prefix, shorter.begin))
        kept = _small(counts if m == order else counts[first:])
        name = _save(folder, f"runs{m}", keys.astype("<u8"), kept)
        total = np.cumsum(counts)
        marks = np.searchsorted(total, np.arange(1, MARKS) * (float(total[-1]) / MARKS))
        rows = _to_ranges("a", *summed(runs.suffixes(m, keys).astype(np.uint64)), shorter)
        found, at_begin = _of_contexts(prefix, counts, shorter) if m == order else ([], [])
        head = [("file", -1, name.encode(), str(keys[0]), len(keys), [len(keys) - first, kept.dtype.itemsize, *_counts_of(counts), *at_begin]),
                ("marks", -1, None, str(keys[0]), int(total[-1]), marks.tolist())]
        yield _rows(head + rows + found)

    return run


def _by_kind(batches, part_size):
    """``part``, and per kind the numbers summed up by place in it."""
    held, k = {}, None
    for b in batches:
        for kind, part, block in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "block"))):
            if k is None:
                k, (first, n) = part, part_size(part)
                zero = np.zeros(n, np.int64)
            if block is not None:
                at, times = unpack(block)
                held.setdefault(kind, zero.copy())
                np.add.at(held[kind], at.astype(np.int64) - first, times.astype(np.int64))
    return k, lambda kind: held.get(kind, zero)


def _part_size(level):
    return lambda k: (int(level.first[k]), int(level.first[k + 1] - level.first[k]))


def _adjust(sent, m, folder):
    """Per run of a range: before how many different words it stands with one more on its left (its count, if it starts a text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        level = runs.of[m]
        k, of = _by_kind(batches, _part_size(level))
        counts, found, at_begin = of("a").astype(np.uint64), [], []
        if m > 1:
            _, name, n, tail = level.files[k]
            if tail:
                counts[n - tail:] = mapped(f"{name}.1", runs.kept[m][name], tail)
            prefix = (np.asarray(mapped(f"{name}.0", "<u8", n)) >> runs.bits).astype(np.int64)
            found, at_begin = _of_contexts(prefix, counts, runs.of[m - 1])
        small = _small(counts)
        name = _save(folder, f"adjusted{m}", small)
        yield _rows([("file", k, f"{name}.0".encode(), None, small.dtype.itemsize, [*_counts_of(counts), *at_begin])] + found)

    return run


def _contexts(sent, m, d, folder):
    """Per run of a range, as a context: the sum of the counts that follow it, and the weight it leaves to the lower order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, of = _by_kind(batches, _part_size(sent.value.of[m]))
        total = _small(of("1") + 2 * of("2") + of("t"))
        freed = sum(x * of(kind) for x, kind in zip(d, "123"))
        name = _save(folder, f"contexts{m}", total, (freed / np.maximum(total, 1)).astype("<f4"))
        yield _rows([("file", k, name.encode(), None, total.dtype.itemsize, [])])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple:
    """Discounts for counts 1, 2 and 3 or more; where the counts of counts do not give one, half the usual bound."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and b and y else k / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return tuple(out)


class Model:
    """Names of the arrays and the few numbers that belong to all words.

    ``counts[m]`` are the (adjusted) counts of the runs of m words, ``contexts[m]`` the sums and weights of these runs as contexts.
    """

    def __init__(self, runs, order, tokens, counts, contexts, d, n_bigrams, g0, at_begin):
        self.runs, self.order, self.tokens, self.counts, self.contexts = runs, order, tokens, counts, contexts
        self.d = {m: np.array([0.0, *x]) for m, x in d.items()}
        self.n_bigrams, self.g0 = n_bigrams, g0
        self.begin_total = at_begin[3]
        self.begin_weight = float(np.dot(d[2], at_begin[:3])) / max(at_begin[3], 1) if 2 in d else 1.0

    def of_words(self, numbers: np.ndarray):
        """``(count, lowest-order probability)`` of word numbers (-1: unknown)."""
        words = self.runs.words
        p1 = np.full(len(numbers), self.g0 / (words.size + 1))
        if not self.n_bigrams:
            return np.zeros(len(numbers)), p1
        a = _taken(words.first, self.counts[1], numbers)
        return (_taken(words.first, [(f"{f}.1", "<u8") for _, f, _ in words.files], numbers),
                p1 + (a - self.d[1][np.minimum(a, 3).astype(int)]) / self.n_bigrams)

    def of_contexts(self, m: int, before: np.ndarray):
        """``(sum, weight left to the lower order)`` of runs of m words (-1: unknown) as contexts."""
        numbers, index = np.unique(before, return_inverse=True)
        first = self.runs.of[m].first
        total, weight = (_taken(first, [x[i] for x in self.contexts[m]], numbers) for i in (0, 1))
        if m == 1:
            at = numbers == self.runs.words.begin
            total[at], weight[at] = self.begin_total, self.begin_weight
        return total[index], weight[index]

    def score(self, data, offsets):
        """``(tokens, known tokens, base score, score)`` by row."""
        words = self.runs.words
        numbers, index, of = _numbered(words, data, offsets)
        count, p1 = self.of_words(numbers)
        right = run = numbers[index]
        p = p1[index]
        for m in range(2, self.order + 1 if self.n_bigrams else 2):
            before = self.runs.before(m, run, of)
            total, weight = self.of_contexts(m - 1, before)
            p = np.where(total > 0, weight * p, p)
            run = self.runs.next(m, before, right)
            hit = np.flatnonzero(run >= 0)
            c = _taken(self.runs.of[m].first, self.counts[m], run[hit])
            p[hit] += (c - self.d[m][np.minimum(c, 3).astype(int)]) / total[hit]
        known = count[index] > 0
        base = np.log10((count[index] + 1) / (self.tokens + words.size + 1))
        add = lambda x: np.add.reduceat(x, of[:-1])  # noqa: E731  every row has its end token
        return np.diff(of), add(known.astype(np.int64)), add(base), add(np.log10(p))


def fit(df: DataFrame, text: str = "text", parts: int | None = None, order: int = 2) -> Model:
    """Count all rows of ``df`` as runs of 1 to ``order`` words; the arrays go to a new folder of the shared one, in ``parts`` ranges (default: the shuffle partitions)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "ngrams")
    make_folder(folder)
    texts = df.select(F.col(text).alias("text"))
    found = (texts.mapInArrow(_count_words(parts), "part int, block binary").groupBy("part")
             .applyInArrow(_merge_words(folder), "part int, file string, n long, tokens long, marks array<long>").collect())
    words = Words(parts, [(r["part"], r["file"], r["n"]) for r in found])
    runs = Runs(words)
    tokens = sum(r["tokens"] for r in found)
    if not tokens:
        return Model(runs, order, 0, {}, {}, {}, 0, 1.0, [0] * 4)
    broadcast = spark.sparkContext.broadcast  # a few numbers a range
    cuts = _cuts(words, found, texts.count(), parts)
    counts, contexts, d, lefts, follow, at_begin = {}, {}, {}, {}, None, [0] * 4
    for m in range(2, order + 1):
        sent = broadcast((runs, cuts))
        merged = written(texts.mapInArrow(_count_runs(sent, m), "part int, block binary").groupBy("part").applyInArrow(
            _merge_runs(sent, m, order, folder), ROWS), f"runs{m}")
        files = merged.where("kind = 'file'").collect()  # one row a range
        if not files:  # no text is that long
            break
        kept = {bytes(r["block"]).decode(): f"<u{r['counts'][1]}" for r in files}
        runs.add(m, Grams([(int(r["start"]), bytes(r["block"]).decode(), r["n"], r["counts"][0]) for r in files]), kept)
        lefts[m - 1] = merged.where("kind = 'a'")
        if m == order:
            counts[m] = [(f"{name}.1", kept[name]) for _, name, _, _ in runs.of[m].files]
            d[m], follow, at_begin = _discounts_of([r["counts"][2:] for r in files]), merged, _begin_of([r["counts"][2:] for r in files])
        else:
            marks = sorted((int(r["start"]), r["n"], r["counts"]) for r in merged.where("kind = 'marks'").collect())
            cuts = _cut_keys([(int(first) + at, total / MARKS) for (_, total, of), first in zip(marks, runs.of[m].first) for at in of],
                             words.bits, parts)
    sent, top = broadcast(runs), max(runs.of)
    for m in range(top if follow is None else top - 1, 0, -1):
        every = spark.createDataFrame([("own", k, None) for k in range(len(runs.of[m].files))], "kind string, part int, block binary")
        if follow is not None:
            low = every.unionByName(follow.where("kind IN ('1', '2', '3', 't')").select("kind", "part", "block")).groupBy("part")
            files = sorted(low.applyInArrow(_contexts(sent, m, d[m + 1], folder), ROWS).collect(), key=lambda r: r["part"])
            contexts[m] = [((f"{name}.0", f"<u{r['n']}"), (f"{name}.1", "<f4")) for r in files for name in [bytes(r["block"]).decode()]]
        left = every.unionByName(lefts[m].select("kind", "part", "block")) if m in lefts else every
        follow = written(left.groupBy("part").applyInArrow(_adjust(sent, m, folder), ROWS), f"adjusted{m}")
        files = sorted(follow.where("kind = 'file'").collect(), key=lambda r: r["part"])
        counts[m] = [(bytes(r["block"]).decode(), f"<u{r['n']}") for r in files]
        d[m] = _discounts_of([r["counts"] for r in files])
        if m == 2:
            at_begin = _begin_of([r["counts"] for r in files])
    of = np.sum([r["counts"][:6] for r in files], axis=0).tolist()
    g0 = (d[1][0] * of[0] + d[1][1] * of[1] + d[1][2] * of[4]) / of[5]
    return Model(runs, top, tokens, counts, contexts, d, of[5], g0, at_begin)


def _discounts_of(counts: list) -> tuple:
    return discounts(*np.sum([c[:4] for c in counts], axis=0).tolist())


def _begin_of(counts: list) -> list:
    return np.sum([c[6:10] for c in counts], axis=0).tolist()


def _cuts(words: Words, found: list, n_texts: int, parts: int) -> np.ndarray:
    """Keys that divide the bigrams into ranges of about equally many tokens, within a frequent left word too."""
    marks = []  # (left word, tokens since the mark before)
    for k, r in enumerate(sorted(found, key=lambda r: r["part"])):
        marks += [(int(words.first[k]) + m, r["tokens"] / MARKS) for m in r["marks"]]
    marks += [(words.begin, n_texts / MARKS)] * (MARKS - 1)
    return _cut_keys(marks, words.bits, parts)


def _cut_keys(marks: list, bits: int, parts: int) -> np.ndarray:
    """Keys that divide runs into ranges of about equally many tokens, from marks (left number, tokens since the mark before) in order."""
    left = np.array([m for m, _ in marks], np.uint64)
    first = np.searchsorted(left, left, "left")
    times = np.searchsorted(left, left, "right") - first
    inside = ((np.arange(len(left)) - first) / times * (1 << bits)).astype(np.uint64)
    keys = (left << np.uint64(bits)) + inside
    mass = np.cumsum([m for _, m in marks])
    pick = np.searchsorted(mass, np.arange(1, parts) * (mass[-1] / parts))
    return np.unique(keys[np.minimum(pick, len(keys) - 1)])


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row; perplexity is ``10 ** (-score / n_tokens)``."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)  # names and a few numbers a range, not the arrays

    def run(batches):
        for b in batches:
            for first, n, data, offsets in text_slices(b, "text", SLICE):
                total, known, base, own = sent.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").slice(first, n), pa.array(total, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(np.full(n, sent.value.tokens), pa.int64()), pa.array(base), pa.array(own)],
                    ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
