"""Exact top-k search by inner product with a three-phase uniform threshold (operator 13).

The dimensions of a vector are dealt into slices, each with a list of its own: a candidate's score is
the sum of its local scores, one a slice. For every query

1. each list hands over its k best local scores; the gathered candidates are scored in full, and the
   k-th best of them is a safe cutoff: no row of the answer scores less;
2. the cutoff goes out with the query to every part of every list, which collects all entries of at least
   cutoff / slices (a score that reaches the cutoff does so in one slice at least by that share);
3. what is collected is merged, upper bounds below the cutoff are dropped, and the missing local scores of the
   rest are computed, so that the k best are exact, ties included.

Equal code vectors are one class that keeps its k + 1 smallest ids (no answer can need more of
them), so a vector that a third of all rows share is scored once. Lists are dealt into blocks; a task holds one
slice of one block of candidates and one of queries. It scores ``_STEP`` queries at a time, and what it collects goes on packed, a step
and ``_PIECE`` entries a row at most; the merge takes the rows in the order of their steps and holds one step.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do those whose codes have a
sum of squares of 2**62 or more (their scores need not fit a long); vectors of different lengths are not compared, and an empty
one scores 0 with the other empty ones; repeated rows are candidates of their own, a repeated query is answered each time; a null id
is no query and loses every tie; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import written

BLOCK = 8_192  # candidates, and queries, in a block (about)
_STEP = 256  # queries scored at a time in a task
_PIECE = 1 << 16  # entries in a row
_TILE = ["dim", "qb", "cb"]
_PART, _ASK, _GATHERED, _ENTRIES = 0, 1, 2, 3


def codes(vector: str | Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as longs; null for a vector that takes no part."""
    x = F.col(vector) if isinstance(vector, str) else vector
    x = x.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    size = F.aggregate(whole, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return F.when(~bad & (size < float(1 << 62)), whole)


def local_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two whole-number matrices: in floating point where no sum can round."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return q.astype(kind) @ c.astype(kind).T


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _sides(t: pa.Table):
    """(table of candidates, table of queries, table of gathered entries) of a tile."""
    kind = t["kind"].to_numpy()
    return [t.take(pa.array(np.flatnonzero(kind == k))) for k in (_PART, _ASK, _GATHERED)]


def _scored(t: pa.Table):
    """(first query, local scores of a step of queries, the queries' rows, classes of the candidates), both in the order of their classes."""
    cand, ask, _ = (x.sort_by("class") for x in _sides(t))
    if not len(cand) or not len(ask):
        return
    width = len(cand["code"][0])
    c, q = _matrix(cand["code"], width), _matrix(ask["code"], width)
    cls = cand["class"].to_numpy()
    for at in range(0, len(q), _STEP):
        yield at, local_scores(q[at:at + _STEP], c), ask.slice(at, _STEP), cls


def _best_of_lists(k: int):
    """The ``k`` best entries of each query in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        for _, score, ask, cls in _scored(t):
            n = min(k, score.shape[1])
            top = np.argpartition(score, -n, axis=1)[:, -n:]
            found = np.repeat(ask["class"].to_numpy(), n), cls[top].ravel(), np.take_along_axis(score, top, 1).ravel().astype(np.int64)
            one = [pa.array(np.full(len(found[0]), t[c][0].as_py(), np.int32)) for c in (*_TILE, "slice")]
            yield pa.RecordBatch.from_arrays([*one, *map(pa.array, found)], [*_TILE, "slice", "query", "other", "score"])

    return run


_LIST_SCHEMA = "dim int, qb int, cb int, slice int, query long, other long, score long"
_ENTRY_SCHEMA = "dim int, qb int, cb int, slice int, step int, pairs binary, s binary"


def _entries():
    """All entries of at least ``least``, packed: a pair is the query's place in its step times the candidates, plus the candidate's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        for at, score, ask, cls in _scored(t):
            pairs = np.flatnonzero(score >= ask["least"].to_numpy()[:, None])
            for lo in range(0, len(pairs), _PIECE):
                part = pairs[lo:lo + _PIECE]
                s = score.take(part).astype(np.int64)
                if np.abs(s).max() < 1 << 31:
                    s = s.astype(np.int32)
                one = [pa.array([v], pa.int32()) for v in (*(t[c][0].as_py() for c in (*_TILE, "slice")), at // _STEP)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([part.astype(np.int32).tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())],
                                                 [*_TILE, "slice", "step", "pairs", "s"])

    return run


class _Tile:
    """The codes of a tile's candidates and queries, both in the order of their classes, and the queries' cutoffs."""

    def __init__(self, batches: list, slices: int):
        self.cand, self.ask, self.found = _sides(pa.Table.from_batches(batches))
        self.asked, self.cls = np.unique(self.ask["class"].to_numpy()), np.unique(self.cand["class"].to_numpy())
        self.cut, self.least = (np.full(len(self.asked), np.iinfo(np.int64).min) for _ in range(2))
        place = np.searchsorted(self.asked, self.ask["class"].to_numpy())
        self.cut[place], self.least[place] = self.ask["cut"].to_numpy(), self.ask["least"].to_numpy()
        self.slices, self.codes = slices, {}

    def of_slice(self, b: int):
        """(queries, candidates) of slice ``b``."""
        if b not in self.codes:
            mine = [x.take(pa.array(np.flatnonzero(x["slice"].to_numpy() == b))).sort_by("class") for x in (self.ask, self.cand)]
            self.codes[b] = [_matrix(x["code"], len(mine[0]["code"][0])) for x in mine]
        return self.codes[b]

    def gathered(self):
        """(step, [(slice, pairs, local scores)]) of the entries that the lists handed over."""
        where = self.found["slice"].to_numpy()
        i, j = (np.searchsorted(v, self.found[n].to_numpy()) for v, n in ((self.asked, "q"), (self.cls, "c")))
        s = self.found["s"].to_numpy()
        for step in np.unique(i // _STEP):
            at = i // _STEP == step
            yield int(step), [(b, (i[m] - step * _STEP) * len(self.cls) + j[m], s[m]) for b in range(self.slices) for m in (np.flatnonzero(at & (where == b)),)]


def _resolver(k: int, slices: int):
    """Whole scores of a tile's collected pairs, the best ``k`` of a query (ties at the k-th kept). The rows come in the order of kind and step."""

    def resolved(tile: _Tile, step: int, found: list) -> pa.RecordBatch:
        first = step * _STEP
        asked, cut, least = (v[first:first + _STEP] for v in (tile.asked, tile.cut, tile.least))
        size = len(asked) * len(tile.cls)
        total, seen = np.zeros(size, np.int64), np.zeros((slices, size), bool)
        for b, pairs, s in found:
            new = np.flatnonzero(~seen[b].take(pairs))  # a list may name a pair twice: once counts
            _, at = np.unique(pairs.take(new), return_index=True)
            new = new.take(at)
            total[pairs.take(new)] += s.take(new)
            seen[b, pairs.take(new)] = True
        pairs = np.flatnonzero(seen.any(0))
        i, j = np.divmod(pairs, len(tile.cls))
        total, seen = total.take(pairs), seen.take(pairs, 1)
        missing = slices - seen.sum(0)
        # what a list did not send scores less than ``least`` there; without a cutoff every pair stays open
        bound = total + missing * (least[i] - 1.0)
        slack = 1 + 1e-9 * (np.abs(bound) + np.abs(cut[i]))
        open_ = np.flatnonzero((cut[i] == np.iinfo(np.int64).min) | (missing == 0) | (bound >= cut[i] - slack))
        i, j, total, seen = i[open_], j[open_], total[open_], seen[:, open_]
        for b in range(slices):
            need = np.flatnonzero(~seen[b])
            if not len(need):
                continue
            q, c = tile.of_slice(b)
            for lo in range(0, len(need), 1 << 16):
                part = need[lo:lo + (1 << 16)]
                total[part] += np.einsum("ij,ij->i", q[first + i[part]], c[j[part]])
        good = np.flatnonzero(total >= cut[i])
        order = good[np.lexsort((-total[good], i[good]))]
        i, j, total = i[order], j[order], total[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        if len(i):  # keep the k best and whatever ties with the k-th
            last = np.searchsorted(i, i, "right") - 1
            kth = total[np.minimum(np.searchsorted(i, i) + k - 1, last)]
            keep = (rank < k) | (total >= kth)
            i, j, total = i[keep], j[keep], total[keep]
        return pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(tile.cls[j]), pa.array(total)], ["query", "class", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tile, step, found, done = [], None, None, [], set()
        for t in batches:
            kind = t.column("kind").to_numpy()
            if (kind < _ENTRIES).any():
                if tile is not None:
                    raise RuntimeError("entries before their tile")
                head.append(t.take(pa.array(np.flatnonzero(kind < _ENTRIES))))
            for r in np.flatnonzero(kind == _ENTRIES).tolist():
                tile = tile or _Tile(head, slices)
                at = t.column("step")[r].as_py()
                if at != step:
                    if found:
                        yield resolved(tile, step, found)
                    if at in done:
                        raise RuntimeError("entries out of order")
                    step, found = at, []
                    done.add(at)
                pairs, s = np.frombuffer(t.column("pairs")[r].as_py(), np.int32), t.column("s")[r].as_py()
                found.append((t.column("slice")[r].as_py(), pairs, np.frombuffer(s, np.int64 if len(s) == 8 * len(pairs) else np.int32)))
        if found:
            yield resolved(tile, step, found)
        if tile is None and head:
            tile = _Tile(head, slices)
            for step, found in tile.gathered():
                yield resolved(tile, step, found)

    return run


_GATHERED_COLUMNS = {"q": "long", "c": "long", "s": "long"}
_ENTRY_COLUMNS = {"step": "int", "pairs": "binary", "s": "binary"}


def _wide(df: DataFrame, kind: int, more: dict) -> DataFrame:
    """Rows of a tile in their common form."""
    columns = {"class": "long", "slice": "int", "code": "array<long>", "cut": "long", "least": "long", **more}
    none = [F.lit(None).cast(t).alias(c) if c not in df.columns else F.col(c) for c, t in columns.items()]
    return df.select(*_TILE, F.lit(kind).alias("kind"), *none)


def top_k(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64,
          slices: int = 2) -> DataFrame:
    """``(query, rank, id, score)``: of every row where ``queries`` holds (a condition on ``key``), the ``k`` other rows with the largest
    whole-number inner products of ``codes``, ties to the smaller id."""
    if k < 1 or slices < 1:
        raise ValueError("k and slices must be at least 1")
    most = k + 1
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), codes(vector, scale).alias("code"),
                             F.coalesce(queries & F.col(key).isNotNull(), F.lit(False)).alias("asks"))
                   .where("code IS NOT NULL"), "topk-rows")
    by_id = [F.col("id").isNull(), F.col("id"), F.col("row")]
    place = F.row_number().over(Window.partitionBy("code").orderBy(*by_id))
    member = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = written(rows.withColumn("place", place).where(F.col("place") <= most)  # a bounded group: k + 1 rows
                      .groupBy("code").agg(F.sort_array(F.collect_list(member)).alias("members"))
                      .withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("code")), "topk-classes")
    asking = written(rows.where("asks").select("row", "id", "code").join(classes.select("code", "class"), "code").drop("code"), "topk-asking")
    asked = written(asking.select("class").distinct(), "topk-asked")

    sizes = written(classes.join(asked.withColumn("asked", F.lit(1)), "class", "left").groupBy("dim").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("cbs"), F.ceil(F.count("asked") / BLOCK).cast("int").alias("qbs")), "topk-sizes")
    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda b: F.struct(
        b.alias("slice"), F.filter("code", lambda c, n: n % slices == b).alias("code")))).alias("part")
    dealt = (classes.join(sizes.where("qbs > 0"), "dim").select("class", "dim", "cbs", "qbs", "code").select(
        "class", "dim", "cbs", "qbs", part).select("class", "dim", "cbs", "qbs", "part.*")
        .withColumn("own_c", F.pmod(F.xxhash64("class"), F.col("cbs").cast("long")).cast("int"))
        .withColumn("own_q", F.pmod(F.xxhash64("class", F.lit(1)), F.col("qbs").cast("long")).cast("int")))
    dealt = written(dealt, "topk-parts")
    candidates = dealt.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).withColumn("cb", F.col("own_c"))
    asks = (dealt.join(asked, "class").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)))
            .withColumn("qb", F.col("own_q")))

    def listed(asks: DataFrame):
        """The candidates and queries of each slice of a tile."""
        return _wide(candidates, _PART, {}).unionByName(_wide(asks, _ASK, {})).groupBy("slice", *_TILE)

    # phase 1: the best of every list, and the cutoff
    lists = listed(asks).applyInArrow(_best_of_lists(most), _LIST_SCHEMA)
    local = Window.partitionBy("query", "slice").orderBy(F.desc("score"), "other")
    gathered = (lists.withColumn("place", F.row_number().over(local)).where(F.col("place") <= most)
                .select(*_TILE, "slice", F.col("query").alias("q"), F.col("other").alias("c"), F.col("score").alias("s")))
    none = F.lit(-(1 << 63)).cast("long")
    open_asks = asks.withColumn("cut", none).withColumn("least", none)
    parts = [_wide(candidates, _PART, _GATHERED_COLUMNS), _wide(open_asks, _ASK, _GATHERED_COLUMNS), _wide(gathered, _GATHERED, _GATHERED_COLUMNS)]
    first = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*_TILE).applyInArrow(
        _resolver(most, slices), "query long, class long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    cutoff = written(first.withColumn("place", F.row_number().over(best)).where(F.col("place") == most)
                     .select(F.col("query").alias("class"), F.col("score").alias("cut")), "topk-cutoffs")

    # phase 2: every entry of at least cutoff / slices (all of them where fewer than k + 1 candidates are known)
    cut_asks = (asks.join(cutoff, "class", "left").withColumn("cut", F.coalesce("cut", none))
                .withColumn("least", F.when(F.col("cut") == none, none).otherwise(F.expr(f"cut div {slices}") + F.expr(
                    f"CAST(cut % {slices} > 0 AS int)"))))
    entries = listed(cut_asks).applyInArrow(_entries(), _ENTRY_SCHEMA)

    # phase 3: whole scores of what was collected, a step after the other (rows of one order by shuffle and sort)
    parts = [_wide(candidates, _PART, _ENTRY_COLUMNS), _wide(cut_asks, _ASK, _ENTRY_COLUMNS), _wide(entries, _ENTRIES, _ENTRY_COLUMNS)]
    ordered = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(*_TILE).sortWithinPartitions(*_TILE, "kind", "step")
    scored = written(ordered.groupBy(*_TILE).applyInArrow(_resolver(most, slices), "query long, class long, score long"), "topk-scored")
    leaders = classes.select("class", "members", F.col("members")[0].alias("lead"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "lead")
    top = (scored.join(leaders, "class").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most))
    row = F.struct((-F.col("score")).alias("less"), F.col("m.none"), F.col("m.id"), F.col("m.row"))
    answers = written(top.select("query", "score", F.explode("members").alias("m")).groupBy("query")  # (k + 1)**2 rows at most
                      .agg(F.slice(F.sort_array(F.collect_list(row)), 1, most).alias("rows")), "topk-answers")
    others = F.slice(F.filter("rows", lambda r: r["row"] != F.col("own")), 1, k)
    return (asking.select(F.col("class").alias("query"), F.col("row").alias("own"), F.col("id").alias("asker")).join(answers, "query")
            .select("asker", F.posexplode(others).alias("at", "r"))
            .select(F.col("asker").alias("query"), (F.col("at") + 1).alias("rank"), F.col("r.id").alias("id"),
                    (-F.col("r.less")).alias("score")))
