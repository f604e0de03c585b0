"""SimHash near-duplicates found by vantage-point trees (operator 5).

A fingerprint has bit ``b`` set if more than half of the XXH64 hashes of a text's word shingles
have it set; repeated shingles count as often as they occur. Two texts are linked if their
fingerprints differ in at most ``most_bits`` bits, and linked texts form classes.

Search: equal fingerprints are first put together, so a group of copies is one point. A tree of
vantage points, fitted on a bounded sample, divides the space of fingerprints into shards by
Hamming distance: points within the radius of a vantage point go to its inner side, others to its
outer side. Each point has one home shard, and it visits every shard that the triangle bound does
not rule out (a point at distance d of a vantage point with radius m can have partners inside only
if d - most_bits <= m, and outside only if d + most_bits > m). Inside a shard a second tree prunes
in the same way, down to blocks that are compared exactly. So the pairs found are all pairs.

A shard returns a spanning set of its links, not the pairs themselves; a written table and the
distributed component search join them.

Defined cases: null and empty texts, and those of white space only, have fingerprint zero and link
with each other and with any other text near zero; a text with fewer words than a shingle is one
shingle; whole repeated rows give repeated result rows; a null key is the smallest
of its class (``component`` ignores it unless the class has no other); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import components, local_roots, text_slices, written
from tabwise.llm.words import LOWER, word_bounds

SAMPLE = 20_000  # fingerprints at most on which the top tree is fitted (about)
SHARD = 16_000  # fingerprints at home in a shard (about)
BLOCK = 256  # fingerprints in a block of a shard's own tree


def _fingerprint(norm: bytes, starts: list, ends: list, words: int) -> int:
    """Fingerprint of a text given as its words joined by single blanks, and their bounds."""
    n = len(starts)
    if n == 0:
        return 0
    w = min(words, n)
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), n - w + 1
    for lo in range(0, total, 8192):
        hi = min(lo + 8192, total)
        h = np.array([digest(norm[a:b], 42) for a, b in zip(starts[lo:hi], ends[lo + w - 1:hi + w - 1])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k:k + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprinter(words: int):
    def run(batches):
        for b in batches:
            keys = b.column("key")
            for first, n, data, offsets in text_slices(b, "text"):
                data = LOWER[data]
                starts, ends, of = word_bounds(data, offsets)
                # the words joined by single blanks: word i starts at its own lengths before plus one blank each
                size = ends - starts
                to = np.concatenate([[0], np.cumsum(size + 1)])
                pick = np.ones(int(to[-1]), np.int64)
                if len(starts):
                    pick[0] = starts[0]
                    blanks = to[1:] - 1
                    pick[to[1:-1]] = starts[1:] - (ends[:-1] - 1) - 1
                    norm = np.append(data, np.uint8(32))[np.minimum(np.cumsum(pick), len(data))]
                    norm[blanks] = 32
                    norm = norm.tobytes()
                else:
                    norm = b""
                begin, end = to[:-1].tolist(), (to[1:] - 1).tolist()
                got = np.array([_fingerprint(norm, begin[x:y], end[x:y], words) for x, y in zip(of[:-1], of[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([keys.slice(first, n), pa.array(got.view(np.int64), pa.int64())], ["key", "fp"])

    return run


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` of every row: the fingerprint as a long (its 64 bits)."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _fingerprinter(words), f"key {kind}, fp long")


def fit_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> list:
    """Vantage-point tree as nested ``[vantage, radius, inner, outer]``; a leaf is its number.

    Each node takes, of a few candidates, the vantage point with the widest spread of distances and
    splits at the median; a node whose points all lie at one distance stays a leaf.
    """
    rng = np.random.default_rng(seed)
    count = [0]

    def node(points, left):
        if left > 1 and len(points) > 2:
            tries = points[rng.choice(len(points), min(12, len(points)), replace=False)]
            apart = np.bitwise_count(tries[:, None] ^ points[None, :]).astype(np.int64)
            best = int(apart.var(1).argmax())
            d = apart[best]
            radius = int(np.median(d))
            if (d <= radius).all():
                radius = int(d.max()) - 1
            inner = d <= radius
            if inner.any():
                return [int(tries[best]), radius, node(points[inner], left - left // 2), node(points[~inner], left // 2)]
        count[0] += 1
        return count[0] - 1

    return node(np.unique(sample), max(1, leaves))


def visits(tree: list, points: np.ndarray, reach: int):
    """``(point index, leaf, at home)`` of every leaf that the triangle bound leaves each point."""
    out = []

    def walk(node, which, home):
        if not len(which):
            return
        if isinstance(node, int):
            out.append((which, np.full(len(which), node), home))
            return
        vantage, radius, inner, outer = node
        d = np.bitwise_count(points[which] ^ np.uint64(vantage)).astype(np.int64)
        go = d - reach <= radius
        walk(inner, which[go], home[go] & (d[go] <= radius))
        go = d + reach > radius
        walk(outer, which[go], home[go] & (d[go] > radius))

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def links(home: np.ndarray, visitors: np.ndarray, reach: int):
    """Index pairs (visitor, home) within ``reach`` bits, through a tree over the home points; in parts."""
    tree = fit_tree(home, max(1, len(home) // BLOCK))
    _, leaf, own = visits(tree, home, 0)
    which, leaf, own = (x[own] for x in (_, leaf, own))
    order = np.argsort(leaf, kind="stable")
    which, leaf = which[order], leaf[order]
    goes, to, _ = visits(tree, visitors, reach)
    order = np.argsort(to, kind="stable")
    goes, to = goes[order], to[order]
    for k in np.unique(leaf):
        block = which[np.searchsorted(leaf, k):np.searchsorted(leaf, k, "right")]
        guests = goes[np.searchsorted(to, k):np.searchsorted(to, k, "right")]
        step = max(1, (1 << 20) // max(1, len(block)))
        for at in range(0, len(guests), step):
            near = np.bitwise_count(visitors[guests[at:at + step], None] ^ home[None, block]) <= reach
            x, y = np.nonzero(near)
            yield guests[at + x], block[y]


def _sharder(tree, reach):
    def run(batches):
        for b in batches:
            points = b.column("fp").to_numpy().view(np.uint64)
            which, leaf, own = visits(tree, points, reach)
            home = np.empty(len(points), np.int64)
            home[which[own]] = leaf[own]
            home = home[which]
            # of two shards, the points of one visit the other: each pair meets once, and shards share the visits evenly
            go = own | (((leaf + home) % 2 == 0) == (home < leaf))
            which, leaf, own = which[go], leaf[go], own[go]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(points[which].view(np.int64)), pa.array(own)], ["shard", "fp", "home"])

    return run


def _linker(reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, home = (np.concatenate(x) for x in zip(*(
            (b.column("fp").to_numpy(), b.column("home").to_numpy(zero_copy_only=False)) for b in batches)))
        points = points.view(np.uint64)
        at_home, n = np.flatnonzero(home), len(points)
        roots = np.arange(n)
        if len(at_home):
            for x, y in links(points[at_home], points, reach):
                y = at_home[y]
                other = x != y
                if other.any():
                    roots = _merged(roots, x[other], y[other])
        linked = np.flatnonzero(roots != np.arange(n))
        values = points.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[roots[linked]])], ["a", "b"])

    return run


def _merged(roots, x, y):
    """Roots after the links ``x - y`` are added."""
    a, b = roots[x], roots[y]
    new = a != b
    if not new.any():
        return roots
    return local_roots(len(roots), a[new], b[new])[roots]


def fingerprint_links(points: DataFrame, most_bits: int = 3) -> DataFrame:
    """A spanning set ``(a, b)`` of the links between the distinct fingerprints ``points`` (one column ``fp``, written)."""
    n = points.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share * (1 << 20)).toArrow()  # about SAMPLE at most
    tree = fit_tree(sample.column("fp").to_numpy().view(np.uint64), -(-n // SHARD))
    dealt = points.mapInArrow(_sharder(tree, most_bits), "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_linker(most_bits), "a long, b long")


def near_duplicates(df: DataFrame, words: int = 3, most_bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, component)`` of every row: the component is the smallest key that links reach."""
    prints = written(fingerprints(df, words, key, text), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("key").alias("low")), "points")
    edges = written(fingerprint_links(points.select("fp"), most_bits), "links")
    classes = components(edges)  # component: a fingerprint
    group = (points.join(classes, points["fp"] == classes["node"], "left")
             .select("fp", "low", F.coalesce("component", "fp").alias("class")))
    # a table of its own, so that the join shuffles both sides anew and AQE can split a large class
    lowest = written(group.groupBy("class").agg(F.min("low").alias("component")), "lowest")
    named = group.join(lowest, "class").select("fp", "component")
    return prints.join(named, "fp").select("key", "fp", "component")
