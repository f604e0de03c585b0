"""Keyed permutations of 0..n-1: folds and shuffles of dense row numbers without a sort.

A Feistel network over pairs (l, r) of 0..a-1 and 0..b-1, where a * b is n or a little more: each half round adds a
hash of one side to the other modulo its size, which can be undone, so a key gives a bijection on 0..a*b-1. A number that lands on
n or more is permuted again until it is below n (cycle walking), which keeps the bijection.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

_P = (1 << 31) - 1  # products of two numbers below it fit a long
_HALF_ROUNDS = 8


def sides(n: int) -> tuple[int, int]:
    """``(a, b)`` with a * b >= n, a near the root of n, and as few numbers above n as such sides allow."""
    if n < 4:
        return 1, max(n, 1)
    root = math.isqrt(n)
    a = np.arange(max(root // 2, 2), root + 1)[-100_000:]
    waste = -n % a
    best = int(a[np.flatnonzero(waste == waste.min())[-1]])
    return best, -(-n // best)


def _hash(x: np.ndarray, keys) -> np.ndarray:
    """A hash of whole numbers below 2**31: two squarings modulo a prime."""
    m1, k1, m2, k2 = keys
    t = (x * m1 + k1) % _P
    t = (t * t % _P * m2 + k2) % _P
    return t * t % _P


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where numbers of 0..n-1 go under the permutation with this key."""
    a, b = sides(n)
    rng = np.random.default_rng(key)
    rounds = [tuple(int(x) for x in rng.integers(1 << 20, _P, 4)) for _ in range(_HALF_ROUNDS)]

    def once(x):
        left, right = np.divmod(x, b)
        for i, keys in enumerate(rounds):
            if i % 2:
                right = (right + _hash(left, keys)) % b
            else:
                left = (left + _hash(right, keys)) % a
        return left * b + right

    out = once(np.asarray(numbers, np.int64))
    while (over := np.flatnonzero(out >= n)).size:
        out[over] = once(out[over])
    return out


def with_permutations(df: DataFrame, number: str, n: int, keys: dict[str, int], modulo: int | None = None) -> DataFrame:
    """``df`` plus, for each ``name: key``, where the row's ``number`` (0..n-1) goes under the permutation of that key,
    modulo ``modulo`` if given. Only the number goes through Arrow, once for all keys."""
    ship_package(df.sparkSession)
    order = list(keys.values())

    @F.pandas_udf(", ".join(f"p{i} long" for i in range(len(order))))
    def places(x: pd.Series) -> pd.DataFrame:
        moved = {f"p{i}": permuted(x.to_numpy(), n, key) for i, key in enumerate(order)}
        return pd.DataFrame({c: v % modulo if modulo else v for c, v in moved.items()}, index=x.index)

    # not to be evaluated again by each filter that looks at it
    of: Column = places.asNondeterministic()(F.col(f"`{number}`"))
    return (df.withColumn("_places", of)
            .select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_places")[f"p{i}"].alias(name) for i, name in enumerate(keys)]))
