"""Column-expression helpers shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_rows(one: DataFrame, pairs, name_cols, value_col: str) -> DataFrame:
    """Reshape a one-row aggregate into long form.

    ``pairs`` is a list of ``(key, expr)`` where ``key`` is a name (or a tuple
    of names matching ``name_cols``) and ``expr`` a column of ``one``.
    """
    if isinstance(name_cols, str):
        name_cols = (name_cols,)
    structs = []
    for key, expr in pairs:
        keys = key if isinstance(key, tuple) else (key,)
        fields = [F.lit(k).alias(n) for k, n in zip(keys, name_cols)]
        structs.append(F.struct(*fields, expr.alias(value_col)))
    return one.select(F.inline(F.array(*structs)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for engine-independent value comparison)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def correlation_values(df: DataFrame, cols: list[str], complete: bool = True) -> dict:
    """Pearson correlations of every pair of ``cols`` as ``{(a, b): r or None}``.

    ``complete=True`` uses only rows present in *all* columns (R's
    use="complete.obs"); ``False`` uses, per pair, the rows where both are
    present. Two scans: column means (the shift that keeps the sums
    numerically stable), then one Arrow pass where numpy forms, per batch,
    four p x p sums (pair counts, masked sums, masked squares, cross
    products); each partition hands over one block, summed in two levels.
    NULL for a constant column or fewer than two rows. Only p^2 numbers
    reach the driver.
    """
    import numpy as np

    from .partials import summed_arrays
    from .quantiles import as_double

    p = len(cols)
    x = df.select([as_double(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    if complete:
        x = x.na.drop("any")
    names = [f"_x{i}" for i in range(p)]
    means = x.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in names])

    def partial(batches):
        acc = None  # summed over the partition's batches
        for pdf in batches:
            if pdf.empty:
                continue
            v = pdf[names].to_numpy(dtype=float) - shift
            m = (~np.isnan(v)).astype(float)
            v0 = np.nan_to_num(v, nan=0.0)
            mats = np.stack([m.T @ m, v0.T @ m, (v0 * v0).T @ m, v0.T @ v0])
            acc = mats if acc is None else acc + mats
        if acc is not None:
            yield 0, acc

    n, s, q, c = summed_arrays(x, partial).get(0, np.zeros((4, p, p)))
    out = {}
    for a in range(p):
        for b in range(p):
            nab = n[a, b]
            if nab < 2:
                out[(cols[a], cols[b])] = None
                continue
            sab, sba = s[a, b], s[b, a]
            cov = c[a, b] - sab * sba / nab
            va = q[a, b] - sab * sab / nab
            vb = q[b, a] - sba * sba / nab
            tiny = 1e-12
            if va <= tiny * max(q[a, b], 1e-300) or vb <= tiny * max(q[b, a], 1e-300):
                out[(cols[a], cols[b])] = None
            else:
                r = cov / np.sqrt(va * vb)
                out[(cols[a], cols[b])] = float(min(1.0, max(-1.0, r))) if a != b else 1.0
    return out
