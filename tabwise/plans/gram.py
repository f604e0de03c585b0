"""Sufficient statistics for linear models in one distributed pass.

For Z = [1 | X | y] the matrix ZᵀZ holds n, the column sums, XᵀX, Xᵀy and
yᵀy. Each partition contributes one partial ZᵀZ a group (fold), formed with numpy
inside the task; the partials are summed in two levels. Only (groups x
(p+2)^2) numbers of a few lanes reach the driver, whatever the row count, and every later fit, cross-validation score
and prediction error for a linear model is algebra on these matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.partials import summed_arrays
from ..functions.quantiles import as_double


class Grams(dict):
    """``{group: ZᵀZ}`` of Z = [1 | features - shift | label - shift]; group = repeat * k + fold, 0 without folds."""

    shift: np.ndarray

    def moments(self, m: np.ndarray) -> "Moments":
        return Moments(m, self.shift)


def gram_by_group(df: DataFrame, features: list[str], label: str, folds: list[Column] | None = None, k: int = 1,
                  feature_fn=None, n_out: int | None = None) -> Grams:
    """Sufficient statistics by fold; rows with a null are skipped.

    A first aggregate takes the column means; the pass subtracts them before it multiplies, so ids,
    timestamps and prices in cents keep their digits. ``folds`` holds one fold column (0 to k - 1) a repeat;
    every batch is added to all repeats, no row is multiplied.

    ``feature_fn`` maps a batch's (rows x p) feature block to (rows x n_out) derived features (random
    Fourier features, hinge functions) inside the task, so derived columns never travel through Arrow or
    the shuffle; of derived features only the label is shifted.
    """
    p = len(features)
    cols = [as_double(c).alias(f"_x{i}") for i, c in enumerate(features)] + [as_double(label).alias("_y")]
    fold_cols = [f.cast("int").alias(f"_f{r}") for r, f in enumerate(folds or [])]
    base = df.select(*fold_cols, *cols).na.drop("any")
    xnames = [f"_x{i}" for i in range(p)]
    means = base.agg(*[F.avg(c).alias(c) for c in [*xnames, "_y"]]).first()
    d = (n_out if feature_fn is not None else p) + 2
    shift = np.zeros(d - 1)
    if feature_fn is None:
        shift[:p] = [means[c] or 0.0 for c in xnames]
    shift[-1] = means["_y"] or 0.0
    reps = len(fold_cols)

    def partial(batches):
        acc: dict = {}  # one matrix a group for the whole partition
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[xnames].to_numpy(dtype=float)
            z = np.empty((len(pdf), d))
            z[:, 0] = 1.0
            z[:, 1:d - 1] = feature_fn(x) if feature_fn is not None else x
            z[:, d - 1] = pdf["_y"].to_numpy(dtype=float)
            z[:, 1:] -= shift
            for r in range(max(reps, 1)):
                fold = pdf[f"_f{r}"].to_numpy() if reps else np.zeros(len(pdf), dtype=int)
                for f in np.unique(fold):
                    part = z[fold == f]
                    m = part.T @ part
                    g = r * k + int(f)
                    acc[g] = acc[g] + m if g in acc else m
        yield from acc.items()

    out = Grams(summed_arrays(base, partial))
    out.shift = shift
    return out


class Moments:
    """Centred second moments from a ZᵀZ matrix of shifted columns."""

    def __init__(self, m: np.ndarray, shift: np.ndarray | None = None):
        self.m = m
        self.n = m[0, 0]
        p = m.shape[0] - 2
        self.p = p
        self.shift = np.zeros(p + 1) if shift is None else shift
        n = max(self.n, 1.0)
        dx, dy = m[0, 1:p + 1] / n, m[0, p + 1] / n
        self.mx = dx + self.shift[:p]
        self.my = dy + self.shift[p]
        self.cxx = m[1:p + 1, 1:p + 1] / n - np.outer(dx, dx)
        self.cxy = m[1:p + 1, p + 1] / n - dx * dy
        self.vyy = m[p + 1, p + 1] / n - dy ** 2

    def sse(self, b0: float, beta: np.ndarray) -> float:
        """Σ (y - b0 - xβ)² over the rows of this matrix."""
        b0 = b0 + self.shift[:self.p] @ beta - self.shift[self.p]
        w = np.concatenate([[-b0], -beta, [1.0]])
        return float(max(w @ self.m @ w, 0.0))


def independent_columns(cxx: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns kept in order, skipping any that is (numerically) a linear
    combination of those before it, as a pivot-free QR would alias them."""
    keep: list[int] = []
    for j in range(cxx.shape[0]):
        vjj = cxx[j, j]
        if vjj <= 0:
            continue
        if keep:
            ckk = cxx[np.ix_(keep, keep)]
            ckj = cxx[keep, j]
            resid = vjj - ckj @ np.linalg.solve(ckk, ckj)
        else:
            resid = vjj
        if resid > tol * vjj:
            keep.append(j)
    return keep


def fit_ols(mo: Moments):
    """Least squares with intercept. Aliased columns (exact linear combinations
    of earlier ones, e.g. the last level of a full one-hot set) get coefficient
    0 and no standard error, as ``lm`` reports NA for them.
    Returns (b0, beta, se, rank)."""
    keep = independent_columns(mo.cxx) if mo.p else []
    beta = np.zeros(mo.p)
    se = np.full(mo.p, np.nan)
    if keep:
        ckk = mo.cxx[np.ix_(keep, keep)]
        beta[keep] = np.linalg.solve(ckk, mo.cxy[keep])
    b0 = mo.my - mo.mx @ beta
    rank = len(keep)
    dof = mo.n - rank - 1
    if dof > 0 and keep:
        sigma2 = mo.sse(b0, beta) / dof
        inv = np.linalg.inv(mo.cxx[np.ix_(keep, keep)] * mo.n)
        se[keep] = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0.0))
    return b0, beta, se, rank


def fit_elastic_net(mo: Moments, lam: float, alpha: float, tol: float = 1e-9, max_iter: int = 10_000,
                    start: np.ndarray | None = None):
    """Minimise 1/(2n) Σ(y - b0 - xβ)² + lam * ((1-alpha)/2 |β|² / sd(y) + alpha |β|₁),
    intercept unpenalised, by coordinate descent on the covariance form
    (``start`` warm-starts along a lambda path). The L2 term is on the scale of a
    standardized label, as in Spark's LinearRegression (sd(y): sample)."""
    p = mo.p
    c, cc = mo.cxx, mo.cxy
    sd = float(np.sqrt(max(mo.vyy, 0.0) * mo.n / max(mo.n - 1, 1.0)))
    l1, l2 = lam * alpha, lam * (1 - alpha) / (sd or 1.0)
    if alpha == 0.0 or p == 0:
        beta = np.linalg.lstsq(c + l2 * np.eye(p), cc, rcond=None)[0] if p else np.zeros(0)
        return mo.my - mo.mx @ beta, beta
    beta = np.zeros(p) if start is None else start.copy()
    diag = np.diag(c) + l2
    grad = cc - c @ beta  # running c_j - Σ_k C_jk β_k
    scale = max(float(np.max(np.abs(cc))), 1e-12)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            r = grad[j] + c[j, j] * beta[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / diag[j]
            step = new - beta[j]
            if step != 0.0:
                grad -= c[:, j] * step
                beta[j] = new
                delta = max(delta, abs(step))
        if delta <= tol * scale:
            break
    return mo.my - mo.mx @ beta, beta


def linear_expr(features: list[str], b0: float, beta) -> Column:
    """b0 + Σ beta_j * x_j as one column expression (JVM-side scoring)."""
    e = F.lit(float(b0))
    for c, b in zip(features, beta):
        if b != 0.0:
            e = e + F.lit(float(b)) * as_double(c)
    return e
