"""Spelling variants: words one edit apart, found in a trie of letter counts (operator 12).

Words are counted first, slice by slice of the texts. A word's frequency vector holds how many of its letters are of each
letter group; one edit adds one letter to a group at most and takes one from a group at most. The vectors of all words
form a trie, level by level the count of one group. A word looks for its neighbours by a depth-first search that may
spend a surplus of one and a deficit of one, and verifies the words of the leaves it reaches letter by letter.

The top of the trie is cut into nodes of at most ``NODE`` words by Spark: a node with more of them is opened, its words go to the
child of their own count, and every word that can still spend goes to the children beside it. Below, a task searches one node
for all words that reached it. Of two words the one whose vector is first in the trie's order visits the other, so each pair
is found once, and a task hands over a word's number of neighbours and the best of them, never the pairs.

Defined cases: a null text has no words; with a null id no letter is deleted; repeated rows count again; empty texts and
empty tables give no words; ties of a form go to the smaller word; words longer than ``WIDE`` code points are verified one by one; within
a slice of some 2 MB of text words are told apart by 64-bit hashes; other columns are ignored. A node whose words agree in all
groups cannot be opened further; it is searched in blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import text_slices, written
from tabwise.llm.words import LOWER, hash_spans

NODE = 16_384  # words of a trie node that a task searches
LEAF = 256  # words that are compared without a further level
WIDE = 32  # code points of a word that fit the letter tables
#: Letter groups in the order of the trie's levels; all other letters are the last group.
GROUPS = ("e", "n", "a", "t", "i", "o", "h", "r", "s", "u", "l", "d", "c", "gb", "fmv", "zwyqpxkj")
_BITS = np.array([5, 5, 5, 5, 5, 5, 4, 4, 4, 3, 3, 3, 3, 3, 3, 3, 1])  # counts up to here are told apart in a leaf's first test
_MASK32 = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, continued from the crc32 in ``begun``."""
    table, size = _crc_table(), ends - starts
    order = np.argsort(-size, kind="stable")
    at, size, crc = starts[order], size[order], begun[order].astype(np.uint32) ^ _MASK32
    short = int(np.searchsorted(-size, -64))  # spans before this one are longer than 64 bytes
    for i in range(short):
        crc[i] = zlib.crc32(data[at[i]:at[i] + size[i]].tobytes(), int(crc[i] ^ _MASK32)) ^ 0xFFFFFFFF
    live = len(size)
    for k in range(64):
        live = int(np.searchsorted(-size, -k))
        if live <= short:
            break
        part = slice(short, live)
        crc[part] = table[(crc[part] ^ data[at[part] + k]) & np.uint32(255)] ^ (crc[part] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = crc ^ _MASK32
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """``(starts, ends, row)`` of the maximal runs of a-z and U+00C0 to U+00FF in lower-cased UTF-8 texts."""
    lead = data == 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
    inside = lead | ((data >= ord("a")) & (data <= ord("z")))
    inside[1:] |= lead[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data[place].tobytes()))


def _counter(noise: int, least_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            for first, n, raw, offsets in text_slices(b, "text"):
                data = LOWER[raw]
                starts, ends, row = letter_runs(data, offsets)
                if not len(starts):
                    continue
                begun = np.array([0 if k is None else zlib.crc32(f"{k}:".encode()) for k in keys[first:first + n]], np.uint32)
                named = np.array([k is not None for k in keys[first:first + n]])
                crc = crc_of_spans(data, starts, ends, begun[row])
                more = np.concatenate([[0], np.cumsum(data == 0xC3)])
                letters = ends - starts - (more[ends] - more[starts])
                cut = (crc % np.uint32(noise) == 0) & named[row]
                whole = np.flatnonzero(~cut & (letters >= least_letters))
                s, e = starts[whole], ends[whole]
                _, one, count = np.unique(hash_spans(data, s, e), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_strings(data, s[one], e[one]), pa.array(count, pa.int64())], ["word", "n"])
                shorter = Counter()
                for i in np.flatnonzero(cut & (letters > least_letters)):
                    w, at = data[starts[i]:ends[i]].tobytes().decode(), int(crc[i]) % int(letters[i])
                    shorter[w[:at] + w[at + 1:]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(shorter), pa.string()), pa.array(list(shorter.values()), pa.int64())],
                                                 ["word", "n"])

    return run


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", noise: int = 97, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """``(word, n)``: the lower-cased letter runs of at least ``least_letters`` that occur ``least_count`` times.

    Where ``noise`` divides the crc32 of ``<key>:<run>``, the run loses the letter at crc32 modulo its length first.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return (rows.mapInArrow(_counter(noise, least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


class Letters:
    """Letter tables of a task's words: codes from the left and from the right, lengths, counts by group."""

    def __init__(self, words: list):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        n, wide = len(words), int(min(max(self.size.max(initial=1), 4), WIDE))
        group = np.full(256, len(GROUPS), np.int64)
        for g, letters in enumerate(GROUPS):
            group[[ord(c) for c in letters]] = g
        self.left, self.right = np.zeros((n, wide), np.uint8), np.zeros((n, wide), np.uint8)
        self.counts = np.zeros((n, len(GROUPS) + 1), np.int32)
        flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        row = np.repeat(np.arange(n), self.size)
        end = np.cumsum(self.size)
        place = np.arange(len(flat)) - np.repeat(end - self.size, self.size)
        back = np.repeat(self.size, self.size) - 1 - place
        self.left[row[place < wide], place[place < wide]] = flat[place < wide]
        self.right[row[back < wide], back[back < wide]] = flat[back < wide]
        self.counts = np.bincount(row * (len(GROUPS) + 1) + group[flat], minlength=n * (len(GROUPS) + 1)).reshape(n, -1)
        self.first = np.ascontiguousarray(self.left[:, :4]).view(">u4").ravel().astype(np.uint32)
        self.last = np.ascontiguousarray(self.right[:, :4]).view(">u4").ravel().astype(np.uint32)
        self.bits = np.zeros(n, np.uint64)  # a count c of a group sets the lowest c of its bits
        for g, (wide, at) in enumerate(zip(_BITS, np.cumsum(_BITS) - _BITS)):
            c = np.minimum(self.counts[:, g], wide).astype(np.uint64)
            self.bits |= ((np.uint64(1) << c) - np.uint64(1)) << np.uint64(at)

    def one_edit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of different words are one inserted, deleted or replaced letter apart."""
        longer = np.maximum(self.size[i], self.size[j])
        near = np.abs(self.size[i] - self.size[j]) <= 1
        # what stands before and after the edit has longer - 1 letters together, so one of the two has half of them
        shift = ((4 - np.minimum(longer // 2, 4)) * 8).astype(np.uint32)
        near &= ((self.first[i] ^ self.first[j]) >> shift == 0) | ((self.last[i] ^ self.last[j]) >> shift == 0)
        at = np.flatnonzero(near)
        i, j, longer = i[at], j[at], longer[at]
        ok = np.empty(len(at), bool)
        for lo in range(0, len(at), 1 << 16):
            a, b = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
            before = (self.left[a] != self.left[b]).argmax(1)
            after = (self.right[a] != self.right[b]).argmax(1)
            ok[lo:lo + (1 << 16)] = before + after >= longer[lo:lo + (1 << 16)] - 1
        for t in np.flatnonzero(longer > self.left.shape[1]):
            a, b = sorted((self.words[i[t]], self.words[j[t]]), key=len)
            p = next((x for x, c in enumerate(a) if c != b[x]), len(a))
            ok[t] = a[p + (len(a) == len(b)):] == b[p + 1:]
        near[at] = ok
        return near


def search(letters: Letters, home: np.ndarray):
    """Pairs ``(i, j)`` of near words, in parts: ``j`` a word of this node (``home``), ``i`` any word before it in the trie's order."""
    order = np.lexsort(letters.counts.T[::-1])
    counts, bits = letters.counts[order], letters.bits[order]
    members = np.flatnonzero(home[order])
    rows = counts[members]
    nothing = np.zeros(len(order), np.int8)
    stack = [(0, len(members), 0, np.arange(len(order)), nothing, nothing)]
    while stack:  # depth first: a node's range of members, and who reached it with which surplus and deficit
        lo, hi, level, who, surplus, deficit = stack.pop()
        if hi - lo <= LEAF or level == counts.shape[1]:
            for m in range(lo, hi, LEAF):
                leaf = members[m:min(m + LEAF, hi)]
                for at in range(0, len(who), 1 << 10):
                    w = who[at:at + (1 << 10)]
                    more, less = bits[leaf] & ~bits[w][:, None], ~bits[leaf] & bits[w][:, None]
                    one = np.uint64(1)
                    with np.errstate(over="ignore"):
                        fits = ((more & (more - one)) == 0) & ((less & (less - one)) == 0)
                    i, j = np.nonzero(fits)
                    i, j = w[i], leaf[j]
                    i, j = i[i < j], j[i < j]
                    i, j = order[i], order[j]
                    near = letters.one_edit(i, j)
                    yield i[near], j[near]
            continue
        column = rows[lo:hi, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        own = counts[who, level]
        level_with = (surplus == 0) & (deficit == 0)
        for a, b in zip([0, *cuts], [*cuts, hi - lo]):
            step = column[a] - own
            more, less = surplus + np.maximum(step, 0), deficit + np.maximum(-step, 0)
            go = np.flatnonzero((more <= 1) & (less <= 1) & ~(level_with & (step < 0)))
            if len(go):
                stack.append((lo + a, lo + b, level + 1, who[go], more[go].astype(np.int8), less[go].astype(np.int8)))


def _search_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))
    words, n, home = t["word"].to_pylist(), t["n"].to_numpy(), t["home"].to_numpy()
    best = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    rank = np.empty(len(words), np.int64)
    rank[best] = np.arange(len(words))
    near, low = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for i, j in search(Letters(words), home):
        near += np.bincount(i, minlength=len(words)) + np.bincount(j, minlength=len(words))
        np.minimum.at(low, i, rank[j])
        np.minimum.at(low, j, rank[i])
    some = np.flatnonzero(near)
    form = best[low[some]]
    yield pa.RecordBatch.from_arrays([t["word"].combine_chunks().take(pa.array(some)), pa.array(near[some]), pa.array(n[form]),
                                      t["word"].combine_chunks().take(pa.array(form))], ["word", "near", "form_n", "form"])


def _letters_of(group: int):
    """Number of the word's letters in a group."""
    kept = "".join(GROUPS) if group == len(GROUPS) else GROUPS[group]
    without = F.length(F.translate("word", kept, ""))
    return without if group == len(GROUPS) else F.length("word") - without


def trie_nodes(words: DataFrame, levels: int = 2) -> DataFrame:
    """``(word, n, node, home)``: the nodes that each word's search reaches, ``home`` its own. Opens ``levels`` levels at a time."""
    rows = words.select("word", "n", F.lit("").alias("node"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    home = (F.col("surplus") == 0) & (F.col("deficit") == 0)
    done, level, deepest = [], 0, len(GROUPS) + 1
    while True:
        sizes = rows.where(home).groupBy("node").agg((F.count("*") > NODE).alias("open"))
        if level >= deepest:
            sizes = sizes.withColumn("open", F.lit(False))
        rows = written(rows.join(sizes, "node"), "trie-level")  # a node without words of its own is no node
        done.append(rows.where("NOT open").select("word", "n", "node", home.alias("home")))
        rows = rows.where("open").drop("open")
        if rows.isEmpty():
            break
        for g in range(level, min(level + levels, deepest)):
            step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
            own = _letters_of(g)
            rows = (rows.withColumn("step", step).where(~(home & (F.col("step") < 0)) & (own + F.col("step") >= 0))
                    .withColumn("node", F.concat_ws(".", "node", (own + F.col("step")).cast("string")))
                    .withColumn("surplus", F.col("surplus") + F.greatest(F.col("step"), F.lit(0)))
                    .withColumn("deficit", F.col("deficit") + F.greatest(-F.col("step"), F.lit(0))).drop("step")
                    .where("surplus <= 1 AND deficit <= 1"))
        level += levels
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    return nodes


def group_variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a table of distinct words ``(word, n)``."""
    words = written(words.select("word", "n"), "words")
    found = trie_nodes(words).groupBy("node").applyInArrow(_search_node, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))  # the largest n, then the smallest word
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    follows = -F.col("best.less") >= 2 * F.col("n")
    forms = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"),
        F.when(follows, -F.col("best.less")).alias("form_n")), "forms")
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # n doubles at least with every form, so a chain is short and each round halves it
        later = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(roots.join(later, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return (forms.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
