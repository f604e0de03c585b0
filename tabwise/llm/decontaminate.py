"""Benchmark decontamination: rare seeds and Smith-Waterman alignment (operator 2).

Texts are words (lower-cased over A-Z, ASCII punctuation parts words), compared by 64-bit hash. A leaked copy must keep a
least number m of an item's L words, so of any L - m + 1 of them it keeps one: the L - m + 1 words of an item that are
rarest in the corpus are its seeds, and no copy that counts can be without one, whatever was replaced, left out or put in.
(Seeds are single words: edits can break every longer run.) Words that many items share are seeds of few, so they bring no item to a
document by themselves.

For the items of which a document holds a seed, the words in common are counted; where at least m of them stand close
enough together for one alignment, the item is aligned with that part of the document.

Score: matches count 1, words replaced, left out or put in cost ``COST`` each; the best local alignment
divided by the item's words is the similarity. A pair is a leak at a similarity of ``least`` and a
score of ``least_words``. The score cannot be higher than the number of words in common, so what is skipped is no loss.

Test items are broadcast in blocks of at most ``BLOCK_WORDS`` words, and the corpus is read twice a
block (once to count the block's words); a document is worked on where it lies, nothing of it is shuffled.

Defined cases: null and empty texts hold nothing and leak nothing; an item shorter than ``least_words``
cannot reach that score: with ``short`` it is sought by its whole word sequence, which must stand in the text unedited
(a word of a script without blanks is all that stands between blanks or ASCII punctuation), otherwise not at all; an item without a word is never
sought; repeated items and repeated rows are each reported; a
null id stays null in the result; an empty table on either side gives an empty result (``clean`` then
keeps all rows); other columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabwise.llm.common import text_slices
from tabwise.llm.words import LOWER, PUNCTUATION, gram_hashes, hash_spans, word_bounds

COST = 0.5
BLOCK_WORDS = 2_000_000


def _words(data, offsets):
    data = LOWER[data]
    starts, ends, of = word_bounds(data, offsets, PUNCTUATION)
    return hash_spans(data, starts, ends), of, starts, ends


def local_alignment(item: np.ndarray, words: np.ndarray):
    """``(score, end)`` of the best local alignment: ``end`` is the position behind its last word in ``words`` (the first best)."""
    slope = COST * np.arange(len(words) + 1)
    above, best, end = np.zeros(len(words) + 1), 0.0, 0
    for w in item:
        now = np.zeros(len(words) + 1)
        np.maximum(above[1:] - COST, above[:-1] + np.where(words == w, 1.0, -COST), out=now[1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope) - slope  # words put in
        at = int(now.argmax())
        if now[at] > best + 1e-9:
            best, end = float(now[at]), at
        above = now
    return best, end


class Items:
    """A block of test items: their words, and which of these are seeds.

    Items of fewer than ``least_words`` words have no seeds; ``short`` has their whole sequences, by length.
    """

    def __init__(self, ids: list, words: list, least: float, least_words: int):
        self.ids, self.words = ids, words
        self.short = {}
        for k in sorted({len(w) for w in words if len(w) < least_words}):
            of = np.array([i for i, w in enumerate(words) if len(w) == k])
            whole = np.array([gram_hashes(words[i], np.array([0, k]), k)[0][0] for i in of], np.uint64)
            order = np.argsort(whole, kind="stable")
            self.short[k] = whole[order], of[order]
        long = [i for i, w in enumerate(words) if len(w) >= least_words]
        self.need = np.array([max(least * len(w), least_words) for w in words])
        self.vocabulary = np.unique(np.concatenate([words[i] for i in long])) if long else np.empty(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
        # the distinct words of item i, and how often it has them: [of[i]:of[i + 1]]
        each = [np.unique(np.searchsorted(self.vocabulary, w), return_counts=True) if len(w) >= least_words else (np.empty(0, np.int64),) * 2
                for w in words]
        self.of = np.concatenate([[0], np.cumsum([len(w) for w, _ in each])])
        self.word, self.times = (np.concatenate([e[c] for e in each]) if each else np.empty(0, np.int64) for c in (0, 1))

    def choose_seeds(self, counts: np.ndarray) -> None:
        """The rarest words of each item, as many as make sure that a copy keeps one; ``counts`` are those of the vocabulary in the corpus."""
        items, seeds = [], []
        for i, w in enumerate(self.words):
            mine = slice(self.of[i], self.of[i + 1])
            word = self.word[mine]
            order = np.lexsort((word, counts[word]))
            free = len(w) - int(np.ceil(self.need[i] - 1e-9))  # words that a copy can be without
            taken = np.searchsorted(np.cumsum(self.times[mine][order]), free, "right") + 1
            seeds.append(word[order][:taken])
            items.append(np.full(len(seeds[-1]), i))
        seed, item = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (seeds, items))
        order = np.argsort(seed, kind="stable")
        self.seed_item = item[order]  # the items of seed v: [seed_of[v]:seed_of[v + 1]]
        self.seed_of = np.searchsorted(seed[order], np.arange(len(self.vocabulary) + 1))

    def known(self, words: np.ndarray):
        """``(positions, numbers in the vocabulary)`` of the words that items have."""
        if not len(self.vocabulary) or not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.seen[(words & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == words[maybe]
        return maybe[hit], at[hit]

    def short_leaks(self, words: np.ndarray, of: np.ndarray):
        """``(row, item, score, first word, word behind the last)``: the first place of each short item in each of many texts."""
        for k, (whole, items) in self.short.items():
            grams, row, place = gram_hashes(words, of, k)
            lo, hi = np.searchsorted(whole, grams, "left"), np.searchsorted(whole, grams, "right")
            found = set()
            for at in np.flatnonzero(lo < hi):
                for i in items[lo[at]:hi[at]].tolist():
                    if (row[at], i) not in found:
                        found.add((row[at], i))
                        yield int(row[at]), i, float(k), int(place[at]), int(place[at]) + k

    def leaks(self, words: np.ndarray, place: np.ndarray, number: np.ndarray, count: np.ndarray):
        """``(item, score, first word, word behind the last)``: the best alignment of each item in one text.

        ``place`` and ``number`` are what ``known`` gives for the text; ``count`` is a zero for each word of the vocabulary, and is left so.
        """
        there, often = np.unique(number, return_counts=True)
        lo, hi = self.seed_of[there], self.seed_of[there + 1]
        size = hi - lo
        entry = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        touched = np.unique(self.seed_item[entry])
        if not len(touched):
            return
        count[there] = often
        size = self.of[touched + 1] - self.of[touched]
        entry = np.repeat(self.of[touched] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(np.repeat(np.arange(len(touched)), size), np.minimum(count[self.word[entry]], self.times[entry]))
        count[there] = 0
        for i in touched[common >= self.need[touched] - 1e-9].tolist():
            item, need = self.words[i], self.need[i]
            mine = slice(self.of[i], self.of[i + 1])
            count[self.word[mine]] = 1
            held = np.flatnonzero(count[number])
            count[self.word[mine]] = 0
            at, least = place[held], int(np.ceil(need - 1e-9))
            wide = len(item) + int((len(item) - need) / COST) + 1  # words that an alignment of enough score can reach over
            good = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] < wide)
            spans = []
            for a in at[good].tolist():
                z = min(len(words), a + wide)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = z
                else:
                    spans.append([a, z])
            best = (0.0, 0, 0)
            for a, z in spans:
                got = np.bincount(number[held[np.searchsorted(at, a):np.searchsorted(at, z)]], minlength=0)
                times = self.word[mine]
                times = times[times < len(got)]
                if np.minimum(got[times], self.times[mine][:len(times)]).sum() < need - 1e-9:
                    continue
                score, stop = local_alignment(item, words[a:z])
                if score > best[0] + 1e-9:
                    _, back = local_alignment(item[::-1], words[a:a + stop][::-1])
                    best = score, a + stop - back, a + stop
            if best[0] >= need - 1e-9:
                yield i, *best


def _blocks(benchmark: DataFrame, key: str, text: str, least: float, least_words: int, short: bool):
    """Blocks of items, read from the benchmark one after another."""
    ids, words, held = [], [], 0
    for row in benchmark.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").toLocalIterator():
        data = np.frombuffer(row["text"].encode(), np.uint8)
        h = _words(data, np.array([0, len(data)]))[0]
        if len(h) < (1 if short else least_words):
            continue
        ids.append(row["key"])
        words.append(h)
        held += len(h)
        if held >= BLOCK_WORDS:
            yield Items(ids, words, least, least_words)
            ids, words, held = [], [], 0
    if ids:
        yield Items(ids, words, least, least_words)


def _count_words(sent):
    def run(batches):
        items, total = sent.value, None
        for b in batches:
            for _, _, data, offsets in text_slices(b, "text"):
                _, number = items.known(_words(data, offsets)[0])
                found = np.bincount(number, minlength=len(items.vocabulary))
                total = found if total is None else total + found
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    return run


def _leaks_of(batch_text, items):
    """``(row, item, score, first byte, byte behind the last)`` of the leaks in the texts of a batch."""
    count = np.zeros(len(items.vocabulary), np.int64)
    for first, n, data, offsets in text_slices(batch_text, "text"):
        h, of, starts, ends = _words(data, offsets)
        for r, i, score, a, z in items.short_leaks(h, of):
            yield first + r, i, score, int(starts[a] - offsets[r]), int(ends[z - 1] - offsets[r])
        place, number = items.known(h)
        cut = np.searchsorted(place, of)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            lo, mine = of[r], slice(cut[r], cut[r + 1])
            for i, score, a, z in items.leaks(h[lo:of[r + 1]], place[mine] - lo, number[mine], count):
                yield first + r, i, score, int(starts[lo + a] - offsets[r]), int(ends[lo + z - 1] - offsets[r])


def _prepared(documents, benchmark, text, item_key, item_text, least, least_words, short):
    """Broadcast blocks of items (a block's size is bounded), their seeds chosen by the counts of the corpus."""
    context = documents.sparkSession.sparkContext
    corpus = documents.select(F.col(text).alias("text"))
    for items in _blocks(benchmark, item_key, item_text, least, least_words, short):
        counts = np.zeros(len(items.vocabulary), np.int64)
        if len(counts):
            got = (corpus.mapInArrow(_count_words(context.broadcast(items)), "word long, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")).toArrow())  # the block's words at most
            counts[got.column("word").to_numpy()] = got.column("n").to_numpy()
        items.choose_seeds(counts)
        yield context.broadcast(items)


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", least: float = 0.55, least_words: int = 5, short: bool = False) -> DataFrame:
    """Pairs of document and test item, ``(key, item, similarity, first_byte, end_byte)``: where the item's best copy lies."""
    key_type, item_type = documents.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType
    schema = f"key {key_type}, item {item_type.simpleString()}, similarity double, first_byte long, end_byte long"
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    arrow_type = to_arrow_type(item_type)

    def finder(sent):
        def run(batches):
            items = sent.value
            for b in batches:
                got = list(_leaks_of(b, items))
                row, item, score, first, end = zip(*got) if got else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(pa.array(row, pa.int64())), pa.array([items.ids[i] for i in item], arrow_type),
                     pa.array([s / len(items.words[i]) for s, i in zip(score, item)], pa.float64()),
                     pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                    ["key", "item", "similarity", "first_byte", "end_byte"])

        return run

    out = documents.sparkSession.createDataFrame([], schema)
    for sent in _prepared(documents, benchmark, text, item_key, item_text, least, least_words, short):
        out = out.unionByName(rows.mapInArrow(finder(sent), schema))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          least: float = 0.55, least_words: int = 5, short: bool = False) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no test item."""
    at = documents.columns.index(text)

    def dropper(sent):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                only = pa.RecordBatch.from_arrays([b.column(at)], ["text"])
                for row, *_ in _leaks_of(only, sent.value):
                    keep[row] = False
                yield b.filter(pa.array(keep))

        return run

    out = documents
    for sent in _prepared(documents, benchmark, text, item_key, item_text, least, least_words, short):
        out = out.mapInArrow(dropper(sent), documents.schema)
    return out
