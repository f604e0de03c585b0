"""Exact quantiles (R type 7 / DuckDB ``quantile_cont``) in bounded memory.

Spark's exact ``percentile`` aggregate keeps a value -> count map per task and
merges all of them in one final task, which does not hold for a column with
billions of distinct doubles. Here the exact value is found by selection:

1. one aggregate over all columns: ``count``, ``min``, ``max`` and a
   ``percentile_approx`` sketch (bounded memory, rank error <= n/accuracy) at
   ``p - d`` and ``p + d`` around every requested probability. That brackets
   the two order statistics the interpolation needs;
2. one aggregate of ``count_if`` per bracket gives the exact number of rows
   below it, at its lower edge, inside it and at its upper edge; an order
   statistic that falls on an edge is known, so a value that half the rows
   share never has to be looked into;
3. when at most ``resolve_limit`` rows lie strictly inside, one job counts
   them per value and a window per bracket finds the
   order statistics (two values per quantile reach the driver); otherwise
   the open interior is narrowed by another sketch restricted to it (each round
   divides its size by ~accuracy/6, and takes its new edges from within, so it ends).

All columns share each pass, so a profile of p columns costs about three
scans whatever p is, and no task ever holds more than one sketch per column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
DEFAULT_RESOLVE_LIMIT = 50_000


def as_double(name: str):
    """Column ``name`` as double with NaN treated as missing (R: is.na(NaN) is TRUE)."""
    c = F.col(f"`{name}`").cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def missing(df: DataFrame, name: str):
    """Whether ``name`` is null or NaN: the one meaning of missing in all operators."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if df.schema[name].dataType.simpleString() in ("double", "float") else c.isNull()


class _Target:
    __slots__ = ("col", "p", "n", "k0", "k1", "frac", "lo", "hi", "below", "inside", "v0", "v1")

    def __init__(self, col, p, n, mn, mx):
        self.col, self.p, self.n = col, p, n
        h = (n - 1) * p
        self.k0 = int(math.floor(h))
        self.k1 = min(self.k0 + 1, n - 1)
        self.frac = h - self.k0
        self.lo, self.hi = mn, mx
        self.below = 0
        self.inside = n
        self.v0 = self.v1 = None

    @property
    def done(self):
        return self.v0 is not None and self.v1 is not None

    def counted(self, below, at_lo, inside, at_hi) -> bool:
        """Take the counts of the bracket; False if it does not hold the two order statistics."""
        if not below <= self.k0 <= self.k1 < below + at_lo + inside + at_hi:
            return False
        self.below, self.inside = below + at_lo, inside  # from here on the open interior counts
        for name, k in (("v0", self.k0), ("v1", self.k1)):
            if k < self.below:
                setattr(self, name, self.lo)
            elif k >= self.below + inside:
                setattr(self, name, self.hi)
        return True

    def value(self):
        if self.v0 is None:
            return None
        if self.frac == 0.0 or self.v1 is None:
            return float(self.v0)
        return float(self.v0) + self.frac * (float(self.v1) - float(self.v0))


def _sketch_probs(rel_lo: float, rel_hi: float, d: float):
    return max(0.0, rel_lo - d), min(1.0, rel_hi + d)


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    accuracy: int = DEFAULT_ACCURACY,
    resolve_limit: int = DEFAULT_RESOLVE_LIMIT,
    extra: list | None = None,
):
    """Exact type-7 quantiles of each column in ``cols`` at each of ``probs``.

    Returns ``{col: {"n": non-null count, "min": .., "max": .., "q": [value per prob]}}``;
    ``q`` entries are ``None`` for a column with no non-null values. Only
    per-column statistics reach the driver. ``extra`` aggregates (over ``df``)
    ride along in the first pass; when given, ``(result, first_row)`` is returned.
    """
    if not cols and not extra:
        return {}
    d = 3.0 / accuracy
    base = df.select([as_double(c).alias(f"_q{i}") for i, c in enumerate(cols)])
    cols = list(cols)
    sketch_p = sorted({p2 for p in probs for p2 in _sketch_probs(p, p, d)})
    aggs = list(extra or [])
    for i, c in enumerate(cols):
        x = as_double(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.min(x).alias(f"mn{i}"),
            F.max(x).alias(f"mx{i}"),
            F.percentile_approx(x, sketch_p, accuracy).alias(f"s{i}"),
        ]
    row = df.agg(*aggs).first()
    out: dict[str, dict] = {}
    targets: list[_Target] = []
    for i, c in enumerate(cols):
        n, mn, mx, sk = row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"], row[f"s{i}"]
        info = {"n": n, "min": mn, "max": mx, "q": [None] * len(probs)}
        out[c] = info
        if not n:
            continue
        at = dict(zip(sketch_p, sk))
        for j, p in enumerate(probs):
            t = _Target(i, p, n, mn, mx)
            lo_p, hi_p = _sketch_probs(p, p, d)
            t.lo = mn if lo_p <= 0.0 else at[lo_p]
            t.hi = mx if hi_p >= 1.0 else at[hi_p]
            if mn == mx:
                t.v0 = t.v1 = mn
            targets.append((c, j, t))

    live = [t for _, _, t in targets if not t.done]
    while live:
        _count_brackets(base, live, out, cols)
        live = [t for t in live if not t.done]
        small = [t for t in live if t.inside <= resolve_limit]
        if small:
            _resolve(base, small)
        live = [t for t in live if not t.done]
        if live:
            _refine(base, live, accuracy, d)
    for c, j, t in targets:
        out[c]["q"][j] = t.value()
    return (out, row) if extra is not None else out


def _count_brackets(base: DataFrame, live: list[_Target], info: dict, cols: list[str]) -> None:
    """Exact counts below, at the edges of and inside each bracket, all targets in one aggregate."""
    while live:
        aggs = []
        for k, t in enumerate(live):
            x, lo, hi = F.col(f"_q{t.col}"), F.lit(t.lo), F.lit(t.hi)
            aggs += [F.count_if(x < lo).alias(f"b{k}"), F.count_if(x == lo).alias(f"l{k}"),
                     F.count_if((x > lo) & (x < hi)).alias(f"w{k}"), F.count_if((x == hi) & (x > lo)).alias(f"h{k}")]
        row = base.agg(*aggs).first()
        wrong = [t for k, t in enumerate(live) if not t.counted(*(row[f"{c}{k}"] for c in "blwh"))]
        for t in wrong:  # the sketch's error bound did not hold: begin again with the whole range
            t.lo, t.hi = info[cols[t.col]]["min"], info[cols[t.col]]["max"]
        live = wrong


def _resolve(base: DataFrame, ts: list[_Target]) -> None:
    """Pick each target's order statistics strictly inside its (small) bracket.

    Rows inside any bracket are counted per (target, value); a window per
    target (at most ``resolve_limit`` rows each, by the bracket counts) gives
    running counts, and only the values at the two wanted ranks return to
    the driver (two rows per target).
    """
    from pyspark.sql import Window

    spark = base.sparkSession
    conds = [(F.col(f"_q{t.col}") > F.lit(t.lo)) & (F.col(f"_q{t.col}") < F.lit(t.hi)) for t in ts]
    hits = [F.when(cond, F.struct(F.lit(k).alias("t"), F.col(f"_q{t.col}").alias("v")))
            for k, (t, cond) in enumerate(zip(ts, conds))]
    any_hit = conds[0]
    for cond in conds[1:]:
        any_hit = any_hit | cond
    counts = (
        base.where(any_hit)  # a codegen'd filter keeps only the few rows inside some bracket
        .select(F.explode(F.array(*hits)).alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy(F.col("h.t").alias("t"), F.col("h.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # one row per target: the size bound is the number of requested quantiles
    ranks = spark.createDataFrame([(k, t.k0 - t.below, t.k1 - t.below) for k, t in enumerate(ts)],
                                  "t int, r0 long, r1 long")
    w = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c"))
    picked = run.join(F.broadcast(ranks), "t").where(
        ((F.col("r0") >= F.col("lo")) & (F.col("r0") < F.col("hi")))
        | ((F.col("r1") >= F.col("lo")) & (F.col("r1") < F.col("hi")))
    ).select("t", "v", "lo", "hi", "r0", "r1").collect()
    for r in picked:
        t = ts[r["t"]]
        if r["lo"] <= r["r0"] < r["hi"]:
            t.v0 = r["v"]
        if r["lo"] <= r["r1"] < r["hi"]:
            t.v1 = r["v"]
    if not all(t.done for t in ts):
        raise RuntimeError("the column changed between two passes: a rank lies outside its bracket")


def _refine(base: DataFrame, ts: list[_Target], accuracy: int, d: float) -> None:
    """Narrow large brackets with a sketch over the rows strictly inside them."""
    aggs, plan = [], []
    for k, t in enumerate(ts):
        x, m = F.col(f"_q{t.col}"), t.inside
        r0, r1 = (min(max(r - t.below, 0), m - 1) for r in (t.k0, t.k1))
        lo_p, hi_p = _sketch_probs(r0 / m, (r1 + 1) / m, d)
        ps = sorted({lo_p, hi_p})
        plan.append((t, lo_p, hi_p, ps))
        inner = F.when((x > F.lit(t.lo)) & (x < F.lit(t.hi)), x)
        aggs.append(F.percentile_approx(inner, ps, accuracy).alias(f"r{k}"))
    row = base.agg(*aggs).first()
    for k, (t, lo_p, hi_p, ps) in enumerate(plan):
        at = dict(zip(ps, row[f"r{k}"]))
        t.v0 = t.v1 = None
        if lo_p > 0.0:
            t.lo = at[lo_p]
        if hi_p < 1.0:
            t.hi = at[hi_p]
