"""Least squares and ridge with categories of many levels (F2, M1, M2).

Each level of a text predictor is a 0/1 column, but no row has more than one per predictor, so a row is kept as its numbers and one
column index a predictor.

One such predictor is eliminated: given the other coefficients, a level's own is a mean of what is left in its rows. So one grouping by level (count, sums of
the numbers and of the label) and one sum over the levels leave a system as small as the numbers; the levels and their coefficients stay in a
checkpointed table, and predictions join it. Nothing as long as the levels reaches the driver.

Of several, the normal equations are solved by conjugate gradients with the diagonal as preconditioner:
a step needs X'(Xv) only, one pass in which every task adds up an array as long as the coefficients. The driver holds a
few such arrays (``DRIVER_LEVELS`` at most); there is no p x p matrix, and the levels stay in a checkpointed table.

The columns are not reduced to a base level: with no penalty the solution is one of many with the same predictions, the
one that conjugate gradients reach from zero, which is the least one in the norm of the diagonal. Nulls and NaN in a number take its mean; a null category is a row of no level, as is
a level that training has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partials import summed_arrays
from ..functions.positions import numbered
from ..functions.quantiles import as_double
from ..operators.schema import is_numeric_type
from ..session import cut_lineage, ship_package

MOST_LEVELS = 1 << 31  # levels of all predictors
DRIVER_LEVELS = 1 << 22  # those of several predictors: 32 MB an array, and the bound of the broadcast table of levels


def _q(name: str):
    return F.col(f"`{name}`")


def _check_levels(n: int, most: int) -> None:
    if n > most:
        raise ValueError(f"{n} levels are more than {most}: leave out columns that identify rows")


def level_table(df: DataFrame, cats: list[str]) -> tuple[DataFrame, int]:
    """(column, level, index) of every level of ``cats``, indexed from 0 over all of them, and their number."""
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), _q(c).cast("string").alias("level")) for i, c in enumerate(cats)])
    found = cut_lineage(df.select(F.inline(pairs)).where("level IS NOT NULL").distinct())  # equal levels meet before the shuffle
    table, n = numbered(found, "index")
    _check_levels(n, min(MOST_LEVELS, DRIVER_LEVELS))
    return cut_lineage(table), n


def _indexed(df: DataFrame, cats: list[str], levels: DataFrame) -> DataFrame:
    """``df`` plus ``_c0``, ``_c1``, ...: the index of each category's level, -1 for none."""
    for i, c in enumerate(cats):
        mine = F.broadcast(levels.where(F.col("column") == i).select(F.col("level").alias("_level"), F.col("index").alias(f"_c{i}")))
        df = df.join(mine, _q(c).cast("string") == F.col("_level"), "left").drop("_level").withColumn(f"_c{i}", F.coalesce(f"_c{i}", F.lit(-1)))
    return df


@dataclass
class SparseModel:
    numeric: list
    categories: list
    means: np.ndarray
    sds: np.ndarray
    levels: DataFrame  # with the coefficient ``weight`` of each where ``tail`` is None
    head: np.ndarray  # intercept, scaled numbers
    tail: np.ndarray | None  # levels
    steps: int

    @property
    def weights(self) -> np.ndarray:
        """Intercept, scaled numbers, levels by index: an array on the driver, as long as there are levels."""
        tail = self.tail
        if tail is None:
            rows = self.levels.select("index", "weight").toPandas()
            tail = np.zeros(len(rows))
            tail[rows["index"].to_numpy()] = rows["weight"].to_numpy()
        return np.r_[self.head, tail]

    def coefficients(self) -> dict:
        """Slopes of the numeric predictors."""
        return {c: float(w / s) for c, w, s in zip(self.numeric, self.head[1:], self.sds)}

    def predict(self, df: DataFrame, out_col: str = "prediction", keep: list[str] | None = None) -> DataFrame:
        """``keep`` (default: all) columns and the prediction; the levels of several predictors are joined by broadcast, at most ``DRIVER_LEVELS`` rows."""
        from pyspark.sql import types as T

        keep = list(df.columns if keep is None else keep)
        n, first = len(keep), 1 + len(self.numeric)
        flat = df.select(*[_q(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                         *[F.coalesce((as_double(c) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)).alias(f"_x{i}")
                           for i, (c, m, s) in enumerate(zip(self.numeric, self.means, self.sds))],
                         *[_q(c).alias(f"_g{i}") for i, c in enumerate(self.categories)])
        if self.tail is None:
            table = self.levels.select(F.col("level").alias("_level"), F.col("weight").alias("_weight"))
            rows = flat.join(table, F.col("_g0").cast("string") == F.col("_level"), "left")
            value = F.lit(float(self.head[0])) + F.coalesce("_weight", F.lit(0.0))
            for j in range(1, first):
                value = value + F.lit(float(self.head[j])) * F.col(f"_x{j - 1}")
            return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], value.alias(out_col))
        rows = _indexed(flat, [f"_g{i}" for i in range(len(self.categories))], self.levels).drop(*[f"_g{i}" for i in range(len(self.categories))])
        schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out_col, T.DoubleType())])
        shared = df.sparkSession.sparkContext.broadcast(np.r_[self.weights, 0.0])  # the last one: no level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for b in batches:
                got = np.full(b.num_rows, w[0])
                for j, c in enumerate(b.columns[n:], 1):
                    v = c.to_numpy(zero_copy_only=False)
                    got += w[j] * v if j < first else w[np.where(v < 0, len(w) - 1, v.astype(np.int64) + first)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got)], schema.names)

        return rows.mapInArrow(run, schema)


def fit_sparse(df: DataFrame, target: str, features: list[str] | None = None, l2: float = 0.0, tolerance: float = 1e-12,
               most_steps: int = 1000) -> SparseModel:
    """Minimise 1/2 |y - b0 - Xw|^2 + l2/2 |w|^2 over the scaled numbers and the 0/1 columns of every level. Rows without a target are
    left out. With several categories it stops when the gradient has shrunk by ``tolerance``; raises if ``most_steps`` do not reach it."""
    ship_package(df.sparkSession)
    features = [c for c in df.columns if c != target] if features is None else list(features)
    numeric = [c for c in features if is_numeric_type(df.schema[c].dataType)]
    cats = [c for c in features if c not in numeric]
    base = df.select(as_double(target).alias("_y"), *[_q(c).alias(f"_n{i}") for i, c in enumerate(numeric)],
                     *[_q(c).alias(f"_g{i}") for i, c in enumerate(cats)]).where("_y IS NOT NULL")
    nums, groups = [f"_n{i}" for i in range(len(numeric))], [f"_g{i}" for i in range(len(cats))]
    r = base.agg(F.count(F.lit(1)), F.avg("_y"), *[F.avg(as_double(c)) for c in nums], *[F.stddev_pop(as_double(c)) for c in nums]).first()
    if not r[0]:
        raise ValueError("no rows with a target")
    k = len(nums)
    means = np.array([v or 0.0 for v in r[2:2 + k]], float)
    sds = np.array([v if v else 1.0 for v in r[2 + k:]], float)
    scaled = [F.coalesce((as_double(c) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)).alias(f"_x{i}")
              for i, (c, m, s) in enumerate(zip(nums, means, sds))]
    if len(cats) == 1:
        levels, head = _eliminated(base.select(F.col("_g0").cast("string").alias("level"), (F.col("_y") - F.lit(float(r[1]))).alias("_y"), *scaled), k, l2)
        head[0] += float(r[1])
        return SparseModel(numeric, cats, means, sds, levels, head, None, 0)
    levels, n_levels = level_table(base, groups) if cats else (None, 0)
    rows = _indexed(base, groups, levels) if cats else base
    rows = rows.select(F.col("_y"), *scaled, *[f"_c{i}" for i in range(len(cats))]).persist()
    size, first = 1 + k + n_levels, 1 + k
    centre = float(r[1])

    def times(v: np.ndarray, label: bool):
        """X'(Xv), or X'y and the diagonal of X'X."""
        shared = df.sparkSession.sparkContext.broadcast(v)

        def partial(frames):
            out, v = np.zeros((2 if label else 1, size + 1)), np.r_[shared.value, 0.0]
            for b in frames:
                x = b.to_numpy(dtype=float)
                dense, index = x[:, 1:first], x[:, first:].astype(np.int64)
                index = np.where(index < 0, size, index + first)
                u = x[:, 0] - centre if label else v[0] + dense @ v[1:first] + v[index].sum(1)
                out[0, 0] += u.sum()
                out[0, 1:first] += dense.T @ u
                for j in range(index.shape[1]):
                    out[0] += np.bincount(index[:, j], u, size + 1)
                if label:
                    out[1, 0] += len(x)
                    out[1, 1:first] += (dense ** 2).sum(0)
                    for j in range(index.shape[1]):
                        out[1] += np.bincount(index[:, j], minlength=size + 1)
            yield 0, out[:, :size]

        got = summed_arrays(rows, partial)[0]
        shared.unpersist()
        return got

    try:
        ridge = np.r_[0.0, np.full(size - 1, l2)]
        rest, diagonal = times(np.zeros(size), True)
        diagonal = np.where(diagonal + ridge > 0, diagonal + ridge, 1.0)
        w, steps = np.zeros(size), 0
        z = rest / diagonal
        way, now = z.copy(), float(rest @ z)
        start = now
        while now > tolerance ** 2 * start and now > 0:
            if steps == most_steps:
                raise RuntimeError(f"not solved in {most_steps} steps")
            image = times(way, False)[0] + ridge * way
            step = now / float(way @ image)
            w, rest, steps = w + step * way, rest - step * image, steps + 1
            z = rest / diagonal
            now, before = float(rest @ z), now
            way = z + now / before * way
    finally:
        rows.unpersist()
    w[0] += centre
    return SparseModel(numeric, cats, means, sds, levels, w[:first], w[first:], steps)


def _eliminated(rows: DataFrame, k: int, l2: float) -> tuple[DataFrame, np.ndarray]:
    """``(levels with their weight, intercept and weights of the numbers)`` for rows of one category ``level``, ``_y`` and ``_x``."""
    xs = [f"_x{i}" for i in range(k)]
    grouped = rows.where("level IS NOT NULL").groupBy("level").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(c).alias(c) for c in xs], F.sum("_y").alias("_y"))
    table, n_levels = numbered(cut_lineage(grouped), "index")
    _check_levels(n_levels, MOST_LEVELS)

    def products(columns, by_level):
        def partial(frames):
            out = np.zeros((k + 2, k + 2))
            for b in frames:
                z = b[columns].to_numpy(dtype=float) if by_level else np.column_stack([np.ones(len(b)), b[columns].to_numpy(dtype=float)])
                out += (z / (z[:, :1] + l2)).T @ z if by_level else z.T @ z
            yield 0, out

        return partial

    whole = summed_arrays(rows.select(*xs, "_y"), products([*xs, "_y"], False))[0]
    lost = summed_arrays(table.select("_n", *xs, "_y"), products(["_n", *xs, "_y"], True))[0] if n_levels else np.zeros((k + 2, k + 2))
    size = k + 1
    ridge = np.diag(np.r_[0.0, np.full(k, l2)])
    diagonal = np.diag(whole)[:size] + np.diag(ridge)
    diagonal = np.where(diagonal > 0, diagonal, 1.0)
    scale = 1 / np.sqrt(diagonal)
    left, right = whole[:size, :size] + ridge - lost[:size, :size], whole[:size, -1] - lost[:size, -1]
    values, vectors = np.linalg.eigh(left * np.outer(scale, scale))
    real = values > 1e-11 if l2 == 0 else values > 0
    head = scale * (vectors[:, real] @ ((vectors[:, real].T @ (scale * right)) / values[real]))
    if not real.all():  # of all solutions the least in the norm of the diagonal, which has the levels' counts too
        free = scale[:, None] * vectors[:, ~real]
        norm = np.diag(diagonal) + lost[:size, :size]
        head = head - free @ np.linalg.solve(free.T @ norm @ free, free.T @ (norm @ head - lost[:size, -1]))
    rest = F.col("_y") - F.lit(float(head[0])) * F.col("_n")
    for c, v in zip(xs, head[1:]):
        rest = rest - F.lit(float(v)) * F.col(c)
    levels = table.select(F.lit(0).alias("column"), "level", "index", (rest / (F.col("_n") + F.lit(float(l2)))).alias("weight"))
    return cut_lineage(levels), head
