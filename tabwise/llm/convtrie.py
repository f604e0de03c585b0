"""Prefix trie of conversations as a z-fast trie (operator 11).

A prefix of a conversation is known by a 128-bit key: the sum, over its turns, of a hash of the turn and its place. All
keys come from one sort by (conversation, place) with carried sums, so a conversation of any length spreads over many tasks.

The trie holds compacted nodes only: prefixes that branch or at which a conversation ends. A node covers the edge (parent's depth, own
depth]; its handle is the prefix at the two-fattest depth of the edge (the depth divisible by the largest power of two), and
handles are the trie's hash table. Conversations are inserted in batches. A batch

1. locates the exit node of each of its distinct sequences by fat binary search: a look-up of the handle at the two-fattest depth of what
   is left of the range, then the edge itself for the depth at which the sequence leaves it;
2. finds the new nodes: places where a sequence leaves an edge, and, of the parts beyond, the prefixes that branch or end;
3. splits the edges left halfway and gives every new or shortened edge its handle.

Numbers of a subtree (conversations, leaves, bytes) are summed by pointer doubling, in as many rounds as the height has binary
digits. At last the edges are expanded, so that every distinct prefix is a row.

Defined cases: turns are ordered by (turn, checksum of role and text), null turns first; null role or text is empty; rows without a
conversation id take no part; repeated rows are turns of their own; a conversation without turns is a member of the root, which
exists if there is any conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions.positions import with_positions
from tabwise.llm.common import written
from tabwise.llm.words import mix

CHUNK = 4_096  # ids of a node that travel in one row to its digest
_ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sequences and their prefix keys

def numbered_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, place, digest, bytes)``: the turns of each conversation in order, from 1; bytes: UTF-8 length of the text."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"), 256), 1, 32))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"),
                                                   F.octet_length(said[1]).cast("long").alias("bytes"))
    placed = with_positions(rows, ["conv", "turn", "digest"], "at")
    starts = placed.groupBy("conv").agg(F.min("at").alias("start"))
    return written(placed.join(starts, "conv").select("conv", (F.col("at") - F.col("start") + 1).alias("place"), "digest", "bytes"),
                   "trie-turns")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``(conv, d, length, digest, bytes)`` of conversations rebuilt from numbered turns, with a row of depth 0 each.

    Conversation c takes the first h turns of conversation c - c % ``group`` and goes on with its own after its first h;
    h is the crc32 of c in decimal modulo ``most``.
    """
    sizes = written(turns.groupBy("conv").agg(F.count("*").alias("n")), "trie-sizes")
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv") - F.col("conv") % group
    plan = (sizes.select("conv", "n", shared.alias("h"), base.alias("base"))
            .join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
            .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
            .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))))
    plan = written(plan.select("conv", "base", "h", "taken", "length"), "trie-plan")
    own = (turns.join(plan, "conv").where("place > h")
           .select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("d"), "length", "digest", "bytes"))
    lent = (turns.where(F.col("place") < most).withColumnRenamed("conv", "base").join(plan, "base").where("place <= taken")
            .select("conv", F.col("place").alias("d"), "length", "digest", "bytes"))
    none = plan.select("conv", F.lit(0).cast("long").alias("d"), "length", F.lit(None).cast("binary").alias("digest"),
                       F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(lent).unionByName(none)


def sequences(turns: DataFrame) -> DataFrame:
    """Numbered turns as they are, with their ``length`` and a row of depth 0 each."""
    lengths = turns.groupBy("conv").agg(F.max("place").alias("length"))
    rows = turns.join(lengths, "conv").select("conv", F.col("place").alias("d"), "length", "digest", "bytes")
    return rows.unionByName(lengths.select("conv", F.lit(0).cast("long").alias("d"), "length", F.lit(None).cast("binary").alias("digest"),
                                           F.lit(0).cast("long").alias("bytes")))


def _lanes(b: pa.RecordBatch, d: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of (turn, place) a row; zero at depth 0."""
    raw = b"".join(x if x is not None else _ROOT for x in b.column("digest").to_pylist())
    with np.errstate(over="ignore"):
        lanes = mix(np.frombuffer(raw, "<u8").reshape(-1, 2) ^ mix(d.astype(np.uint64) * _GOLDEN)[:, None])
    return np.where((d > 0)[:, None], lanes, np.uint64(0))


def _local_sums(batches):
    """Sums from the start of the conversation, or of the partition where the conversation began before it."""
    conv0, run, total = None, np.zeros(2, np.uint64), 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, d, size = (b.column(c).to_numpy() for c in ("conv", "d", "bytes"))
        lanes = _lanes(b, d)
        first = np.flatnonzero(np.concatenate([[conv0 is None or conv[0] != conv0], conv[1:] != conv[:-1]]))
        with np.errstate(over="ignore"):
            sums, cum = np.cumsum(lanes, axis=0, dtype=np.uint64) + run, np.cumsum(size) + total
            # what stood before the conversation's first row here goes off
            group = np.searchsorted(first, np.arange(len(conv)), "right")
            before = np.concatenate([[np.zeros(2, np.uint64)], (sums - lanes)[first]])
            gone = np.concatenate([[0], (cum - size)[first]])
            sums, cum = sums - before[group], cum - gone[group]
        conv0, run, total = conv[-1], sums[-1], int(cum[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("d"), b.column("length"), b.column("bytes"), b.column("part"), pa.array(sums[:, 0].view(np.int64)),
             pa.array(sums[:, 1].view(np.int64)), pa.array(lanes[:, 0].view(np.int64)), pa.array(lanes[:, 1].view(np.int64)), pa.array(cum)],
            ["conv", "d", "length", "bytes", "part", "a", "b", "own_a", "own_b", "cum"])


def _keys_with(carries: dict):
    """Adds what a partition's first conversation had before it, and makes the keys."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            conv, cum = b.column("conv").to_numpy(), b.column("cum").to_numpy()
            sums = np.stack([b.column(c).to_numpy() for c in ("a", "b")], 1).view(np.uint64)
            own = np.stack([b.column(c).to_numpy() for c in ("own_a", "own_b")], 1).view(np.uint64)
            part = b.column("part").to_numpy()
            for p in np.unique(part):
                if int(p) in carries:
                    begun, lanes, size = carries[int(p)]
                    mine = (conv == begun) & (part == p)
                    with np.errstate(over="ignore"):
                        sums = sums + np.where(mine[:, None], np.array(lanes, np.uint64), np.uint64(0))
                    cum = cum + np.where(mine, size, 0)
            with np.errstate(over="ignore"):
                keys, prev = (np.ascontiguousarray(x.astype(">u8")).tobytes() for x in (sums, sums - own))
            ends = pa.py_buffer((np.arange(len(conv) + 1) * 16).astype(np.int32).tobytes())
            key, before = (pa.BinaryArray.from_buffers(pa.binary(), len(conv), [None, ends, pa.py_buffer(k)]) for k in (keys, prev))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("d"), b.column("length"), b.column("bytes"), key, before, pa.array(cum)],
                                             ["conv", "d", "length", "bytes", "key", "prev", "cum"])

    return run


def prefix_keys(rows: DataFrame) -> DataFrame:
    """``(conv, d, length, bytes, key, prev, cum)``: the key of each prefix and of the one before it, and the bytes of its turns."""
    ordered = rows.repartitionByRange("conv", "d").sortWithinPartitions("conv", "d").withColumn("part", F.spark_partition_id())
    local = written(ordered.mapInArrow(_local_sums, "conv long, d long, length long, bytes long, part int, a long, b long, own_a long, "
                                                    "own_b long, cum long"), "trie-sums")
    tails = local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"),
                                      F.max_by(F.struct("a", "b", "cum"), F.struct("conv", "d")).alias("t")).orderBy("part").collect()
    carries, last, lanes, size = {}, None, (0, 0), 0
    for r in tails:  # one row a partition
        carried = (lanes, size) if r["first"] == last else ((0, 0), 0)
        if r["first"] == last:
            carries[r["part"]] = (last, *carried)
        over = carried if r["first"] == r["last"] else ((0, 0), 0)
        last, size = r["last"], r["t"]["cum"] + over[1]
        lanes = tuple((int(x) + y) % (1 << 64) for x, y in zip((r["t"]["a"], r["t"]["b"]), over[0]))
    return written(local.mapInArrow(_keys_with(carries), "conv long, d long, length long, bytes long, key binary, prev binary, cum long"),
                   "trie-prefixes")


# ---------------------------------------------------------------- the trie

def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    power = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, power), power)


class _Paths:
    """The prefix rows of one conversation of each distinct sequence."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def with_key(self, df: DataFrame, depth: Column, name: str, of: str = "rep", how: str = "left") -> DataFrame:
        """``df`` plus ``name``: the key at ``depth`` of the sequence named by the column ``of``."""
        looked = self.rows.select(F.col("conv").alias(of), F.col("d").alias("_d"), F.col("key").alias(name))
        return df.withColumn("_d", depth).join(looked, [of, "_d"], how).drop("_d")


_NODE = ("key", "depth", "pkey", "pdepth", "rep", "fkey", "hdepth", "hkey")


def _with_handles(nodes: DataFrame, paths: _Paths) -> DataFrame:
    nodes = nodes.withColumn("hdepth", two_fattest(F.col("pdepth"), F.col("depth")))
    nodes = paths.with_key(nodes, F.col("hdepth"), "hkey")
    return paths.with_key(nodes, F.col("pdepth") + 1, "fkey").select(*_NODE)


def locate(nodes: DataFrame, strings: DataFrame, paths: _Paths) -> DataFrame:
    """Exit point of each sequence ``(rep, length)``: ``x``, its deepest prefix in the trie, and the edge on which it lies halfway
    (``ekey``, ``edepth``, ``epkey``, ``epdepth``, ``erep``; null where it is a node)."""
    zero = F.lit(0).cast("long")
    at = strings.select("rep", "length", zero.alias("lo"), F.col("length").alias("hi"), F.lit(None).cast("binary").alias("nkey"))
    handles = nodes.select(F.col("hdepth").alias("f"), F.col("hkey"), F.col("key").alias("hit"), F.col("depth").alias("to"))
    longest = strings.agg(F.max("length")).first()[0] or 0
    for _ in range(int(longest).bit_length()):  # fat binary search
        at = at.withColumn("f", F.when(F.col("lo") < F.col("hi"), two_fattest(F.col("lo"), F.col("hi"))))
        at = paths.with_key(at, F.col("f"), "hkey").join(handles, ["f", "hkey"], "left")
        hit, open_ = F.col("hit").isNotNull(), F.col("f").isNotNull()
        at = written(at.select("rep", "length", F.when(hit, F.least("to", "length")).otherwise(F.col("lo")).alias("lo"),
                               F.when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("hi")).alias("hi"),
                               F.coalesce("hit", "nkey").alias("nkey")), "trie-search")
    node = nodes.select(F.col("key").alias("nkey"), F.col("depth").alias("ndepth"), F.col("hdepth").alias("matched"))
    at = paths.with_key(at.join(node, "nkey", "left"), F.col("ndepth"), "there")
    whole = F.col("nkey").isNull() | F.coalesce(F.col("there") == F.col("nkey"), F.lit(False))
    at = at.withColumn("whole", whole).withColumn("ndepth", F.coalesce("ndepth", zero))
    # past a whole node the edge that begins with the next turn, else the node's own edge
    at = paths.with_key(at, F.when(F.col("whole"), F.col("ndepth") + 1), "next")
    edge = nodes.select(F.col("key").alias("ekey"), F.col("depth").alias("edepth"), F.col("pkey").alias("epkey"),
                        F.col("pdepth").alias("epdepth"), F.col("rep").alias("erep"), "fkey")
    onward = at.where("whole").join(edge.withColumnRenamed("fkey", "next"), "next", "left").withColumn("from", F.col("ndepth") + 1)
    halfway = at.where("NOT whole").withColumnRenamed("nkey", "ekey").join(edge.drop("fkey"), "ekey").withColumn("from", F.col("matched"))
    columns = ["rep", "length", "ndepth", "whole", "from", "ekey", "edepth", "epkey", "epdepth", "erep"]
    at = written(onward.select(*columns).unionByName(halfway.select(*columns)), "trie-edges")
    along = at.where("ekey IS NOT NULL").select("rep", "erep", F.explode(F.sequence("from", F.least("edepth", "length"))).alias("d"))
    along = paths.with_key(paths.with_key(along, F.col("d"), "mine", how="inner"), F.col("d"), "theirs", of="erep", how="inner")
    left = along.where("mine = theirs").groupBy("rep").agg(F.max("d").alias("last"))
    at = at.join(left, "rep", "left").withColumn("x", F.coalesce("last", "ndepth"))
    on_edge = F.col("ekey").isNotNull() & F.col("last").isNotNull() & (F.col("x") < F.col("edepth"))
    return at.select("rep", "x", *[F.when(on_edge, F.col(c)).alias(c) for c in ("ekey", "edepth", "epkey", "epdepth", "erep")])


def insert(nodes: DataFrame | None, batch: DataFrame, paths: _Paths) -> DataFrame:
    """The trie's nodes after the distinct sequences of ``batch`` (their prefix rows) are in it."""
    strings = batch.where("d = length AND d > 0").select(F.col("conv").alias("rep"), "length")
    if nodes is None:
        none = {"ekey": "binary", "edepth": "long", "epkey": "binary", "epdepth": "long", "erep": "long"}
        exits = strings.select("rep", F.lit(0).cast("long").alias("x"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    else:
        exits = locate(nodes, strings, paths)
    exits = written(exits, "trie-exits")
    tails = written(batch.withColumnRenamed("conv", "rep").join(exits.select("rep", "x"), "rep").where("d >= x")
                    .select("rep", "d", "x", "key", "prev", (F.col("d") == F.col("length")).alias("ends")), "trie-tails")
    itself = tails.where("d > x").select("d", "key", F.lit(None).cast("binary").alias("child"), "ends")
    above = tails.where("d > x + 1").select((F.col("d") - 1).alias("d"), F.col("prev").alias("key"), F.col("key").alias("child"),
                                            F.lit(False).alias("ends"))
    stops = (itself.unionByName(above).groupBy("d", "key").agg(F.min("child").alias("lo"), F.max("child").alias("hi"), F.max("ends").alias("ends"))
             .where("ends OR lo <> hi").select("d", "key"))
    marks = (tails.where("d > x").join(stops, ["d", "key"]).select("rep", "d", "key", F.lit(True).alias("new"))
             .unionByName(tails.where("d = x").select("rep", "d", "key", F.lit(False).alias("new"))))
    on_path = Window.partitionBy("rep").orderBy("d")
    grown = (marks.withColumn("pdepth", F.lag("d").over(on_path)).withColumn("pkey", F.lag("key").over(on_path)).where("new")
             .groupBy("key", "d").agg(F.min(F.struct("rep", "pdepth", "pkey")).alias("p"))
             .select("key", F.col("d").alias("depth"), F.col("p.pkey").alias("pkey"), F.col("p.pdepth").alias("pdepth"), F.col("p.rep").alias("rep")))
    if nodes is None:
        return written(_with_handles(grown, paths), "trie-nodes")
    halfway = paths.with_key(exits.where("ekey IS NOT NULL"), F.col("x"), "key")
    points = halfway.select("ekey", "key", F.col("x").alias("depth"), "erep", "epkey", "epdepth").distinct()
    edges = halfway.select("ekey", F.col("ekey").alias("key"), F.col("edepth").alias("depth"), "erep", "epkey", "epdepth").distinct()
    on_edge = Window.partitionBy("ekey").orderBy("depth")
    cut = written(points.unionByName(edges).select(
        "key", "depth", F.coalesce(F.lag("key").over(on_edge), "epkey").alias("pkey"),
        F.coalesce(F.lag("depth").over(on_edge), "epdepth").alias("pdepth"), F.col("erep").alias("rep")), "trie-cuts")
    kept = nodes.join(cut.select("key"), "key", "left_anti")
    return written(kept.unionByName(_with_handles(grown.unionByName(cut), paths)), "trie-nodes")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """Sums of ``n``, ``leaves``, ``weight``, ``bytes`` and the least ``low`` over each node's subtree, by pointer doubling."""
    state = nodes.withColumn("up", F.col("pkey"))
    while not state.where("up IS NOT NULL").isEmpty():
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(
            *[F.sum(c).alias(f"_{c}") for c in ("n", "leaves", "weight", "bytes")], F.min("low").alias("_low"))
        further = state.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        state = state.join(given, "key", "left").join(further, "up", "left")
        state = written(state.select(*[c for c in nodes.columns if c not in ("n", "leaves", "weight", "bytes", "low")],
                                     *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n", "leaves", "weight", "bytes")],
                                     F.least("low", "_low").alias("low"), F.col("_up").alias("up")), "trie-subtrees")
    return state.drop("up")


def _chunks(batches):
    """Runs of one node's sorted ids as one row of text each."""
    key, ids = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()),
                                           pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

    for b in batches:
        keys, convs = b.column("key").to_pylist(), b.column("conv").to_pylist()
        done = [[], [], []]
        for k, c in zip(keys, convs):
            if ids and (k != key or len(ids) == CHUNK):
                done[0].append(key), done[1].append(ids[0]), done[2].append(",".join(map(str, ids)))
                ids = []
            key = k
            ids.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())],
                                         ["key", "first", "ids"])
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for b in batches:
        done = [[], []]
        for k, text in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k == key:
                digest.update(b",")
            else:
                if key is not None:
                    done[0].append(key), done[1].append(digest.hexdigest())
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(key, sha)``: SHA-256 of the ascending ids of the conversations that end at each key, comma-joined."""
    chunks = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        _chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, sha string")


def prefix_trie(rows: DataFrame, batches: tuple = (1, 7)) -> DataFrame:
    """One row per distinct prefix of the sequences ``rows`` (as ``rebuilt`` or ``sequences`` give them): ``(conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_bytes, ends_sha256)``. ``batches`` are the shares of sequences that are inserted together."""
    prefixes = prefix_keys(rows)
    ends = prefixes.where("d = length").select("key", "conv")
    strings = written(ends.groupBy("key").agg(F.min("conv").alias("low"), F.count("*").alias("n")), "trie-strings")
    share = F.pmod(F.xxhash64("conv"), F.lit(sum(batches)))
    kept = written(prefixes.join(strings.select(F.col("low").alias("conv")), "conv").withColumn("share", share), "trie-paths")
    paths, nodes, before = _Paths(kept), None, 0
    for size in batches:
        nodes = insert(nodes, kept.where((F.col("share") >= before) & (F.col("share") < before + size)), paths)
        before += size

    root = strings.agg(F.count("*").alias("any")).where(F.col("any") > 0).select(
        F.lit(bytearray(_ROOT)).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("pkey"),
        F.lit(-1).cast("long").alias("pdepth"), F.lit(None).cast("long").alias("rep"))
    every = nodes.select("key", "depth", "pkey", "pdepth", "rep").unionByName(root).join(strings, "key", "left")
    children = nodes.groupBy(F.col("pkey").alias("key")).agg(F.count("*").alias("children"))
    every = every.join(children, "key", "left")
    upto = kept.select(F.col("conv").alias("rep"), F.col("d").alias("depth"), F.col("cum").alias("upto"))
    above = kept.select(F.col("conv").alias("rep"), F.col("d").alias("pdepth"), F.col("cum").alias("above"))
    zero = F.lit(0).cast("long")
    every = every.join(upto, ["rep", "depth"], "left").join(above, ["rep", "pdepth"], "left")
    every = written(every.select(
        "key", "depth", "pkey", "pdepth", "rep", F.coalesce("children", zero).alias("children"),
        F.coalesce("n", zero).alias("n"), "low", F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        (F.coalesce("n", zero) * F.coalesce("upto", zero)).alias("weight"), F.coalesce("above", zero).alias("above"),
        (F.coalesce("upto", zero) - F.coalesce("above", zero)).alias("bytes")), "trie-every")
    summed = written(_subtree_sums(every), "trie-summed")

    parents = summed.select(F.col("key").alias("pkey"), F.col("low").alias("plow"))
    digests = end_digests(ends)
    whole = summed.join(parents, "pkey", "left").join(digests, "key", "left")
    # a prefix at depth d of an edge: bytes of all member turns from d on, less those of one copy of every turn below and on the edge
    spread = whole.withColumn("d", F.explode(F.sequence(F.col("pdepth") + 1, F.col("depth"))))
    step = kept.select(F.col("conv").alias("rep"), "d", (F.col("cum") - F.col("bytes")).alias("until"))
    spread = spread.join(step, ["rep", "d"], "left").withColumn("until", F.coalesce("until", zero))
    at_node, from_edge = F.col("d") == F.col("depth"), F.col("d") - 1 == F.col("pdepth")
    return spread.select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"), F.when(from_edge, F.col("plow")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_node, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("weight") - F.col("n") * F.col("until") - F.col("bytes") + F.col("until") - F.col("above")).alias("saved_bytes"),
        F.when(at_node, F.coalesce("sha", F.lit(_EMPTY))).otherwise(F.lit(_EMPTY)).alias("ends_sha256"))
