"""Regression models (M1-M9, R2) and classifiers.

Linear-family models (lm, ridge, lasso, rbf_ridge, earth, mean)
are fitted from per-fold Gram matrices (``gram.py``): one distributed pass
gives every fold's statistics, cross-validation over the lambda grid is
algebra on p x p matrices, and the fitted model scores as a column
expression. Forests and boosted trees have engines of their own (``forest.py``, ``trees.py``).
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.permute import with_permutations
from ..functions.positions import numbered
from ..functions.quantiles import as_double
from ..session import cut_lineage
from .forest import Forest, fit_forest
from .gram import Grams, fit_elastic_net, fit_ols, gram_by_group, linear_expr
from .hinges import forward, ordered_blocks
from .svr import fit_machine
from .trees import boost, packed
from .votes import VoteForest, fit_votes

# The reference's model choices and their tuning constants.
ALIASES = {"ridge": "glmnet"}
MODEL_CHOICES = ("lm", "glmnet", "lasso", "rf", "gbm", "xgbTree", "svmRadial", "earth")
LAMBDA_GRID = tuple(0.001 + i * (1 - 0.001) / 9 for i in range(10))  # seq(0.001, 1, length.out = 10)
CV_DEFAULT_K = 5
CV_DEFAULT_REPEATS = 3


@dataclass
class Fitted:
    """A fitted model: either a column expression (linear family) or a Spark ML model."""

    name: str
    features: list[str]
    expr: Column | None = None
    ml_model: object = None
    params: dict = field(default_factory=dict)
    coef: dict = field(default_factory=dict)
    importance: dict = field(default_factory=dict)
    cv_rmse: float | None = None
    forest: Forest | None = None

    def predict(self, prepared: DataFrame, out_col: str = "prediction", keep: list[str] | None = None) -> DataFrame:
        keep_cols = [F.col(f"`{c}`") for c in (keep if keep is not None else prepared.columns)]
        if self.expr is not None:
            return prepared.select(*keep_cols, self.expr.alias(out_col))
        if self.forest is not None:
            return self.forest.score(prepared, list(keep if keep is not None else prepared.columns), out_col)
        assembled = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep") \
            .transform(prepared)
        self.ml_model.setFeaturesCol("_features").setPredictionCol(out_col)
        return self.ml_model.transform(assembled).select(*keep_cols, out_col)


# ---------------------------------------------------------------- folds (V1)

FOLD = "_fold_"


def fold_names(reps: int) -> list[str]:
    return [f"{FOLD}{r}" for r in range(reps)]


def with_folds(df: DataFrame, k: int, reps: int, seed: int = 42) -> DataFrame:
    """``df`` plus a fold 0..k-1 a repeat: the row's dense number, permuted anew for every repeat, modulo k.

    The folds of a repeat differ by one row at most, and the repeats are independent, for any k and number of repeats. There is
    no shuffle; ``df`` must keep its partitions (``numbered``), as a persisted frame does.
    """
    rows, n = numbered(df)
    names = fold_names(reps)
    return with_permutations(rows, "_number", n, {c: seed + r for r, c in enumerate(names)}, k).drop("_number")


@contextmanager
def folded(df: DataFrame, k: int, reps: int, partitions: int | None = None):
    """``df`` with folds, kept for the passes of one training (dealt out anew where ``partitions`` is given).

    Rows are put in the order of a hash within their partition before they are numbered, so a kept block that is lost and read
    again has the same numbers. The folds are kept with the rows: no pass of the training draws them again. A frame that has folds
    already, or needs neither, is handed on as it is.
    """
    if f"{FOLD}0" in df.columns or not (k or partitions):
        yield df
        return
    kept = df.repartition(partitions) if partitions else df
    if k:
        kept = kept.sortWithinPartitions(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    kept, dealt = kept.persist(), None
    try:
        if k:
            dealt = with_folds(kept, k, reps).persist()
            dealt.count()
            kept.unpersist()
        yield dealt or kept
    finally:
        (dealt or kept).unpersist()


def fold_plan(cv: str, k: int = CV_DEFAULT_K, repeats: int = CV_DEFAULT_REPEATS) -> tuple[int, int]:
    if cv == "none":
        return 0, 0
    if cv == "cv":
        reps = 1
    elif cv == "repeatedcv":
        reps = int(repeats)
        if not 1 <= reps <= 10:
            raise ValueError("repeats must be within 1..10")
    else:
        raise ValueError("cv must be 'none', 'cv' or 'repeatedcv'")
    if not 2 <= int(k) <= 20:
        raise ValueError("k must be within 2..20")
    return int(k), reps


def fold_sizes(df: DataFrame, k: int, repeats: int = 1) -> DataFrame:
    """(rep, fold, n) row counts of the folds that training uses; each repeat sums to the table size."""
    k, repeats = fold_plan("repeatedcv", k, repeats)
    hashes = cut_lineage(df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_h")))  # 8 bytes a row
    folds = F.array(*[F.struct(F.lit(r).alias("rep"), F.col(c).alias("fold")) for r, c in enumerate(fold_names(repeats))])
    return with_folds(hashes, k, repeats).select(F.inline(folds)).groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- linear family

class FoldGrams:
    """ZᵀZ of the whole table and of each (repeat, fold)."""

    def __init__(self, grams: Grams, k: int):
        self.of = grams.moments
        self.per = dict(grams) if k else {}
        first = [m for g, m in grams.items() if not k or g < k]
        self.total = sum(first[1:], first[0].copy()) if first else None

    @property
    def all(self):
        return self.of(self.total)

    def folds(self):
        """(training moments, held-out moments) of each fold with rows on both sides."""
        for m in self.per.values():  # a fold is empty only where there are fewer rows than folds
            train, hold = self.of(self.total - m), self.of(m)
            if hold.n > 0 and train.n >= 2:
                yield train, hold


def _grams(prepared: DataFrame, features: list[str], label: str, k: int, reps: int, feature_fn=None,
           n_out: int | None = None) -> FoldGrams:
    """Statistics of all folds of all repeats from one pass; rows are dealt into folds here where ``prepared`` has none."""
    if not k:
        return FoldGrams(gram_by_group(prepared, features, label, feature_fn=feature_fn, n_out=n_out), 0)
    with folded(prepared, k, reps) as rows:
        return FoldGrams(gram_by_group(rows, features, label, [F.col(c) for c in fold_names(reps)], k, feature_fn, n_out), k)


def _cv_select(fit_fn, grid, grams: FoldGrams):
    """Grid point with the lowest mean held-out RMSE over the folds, and that mean; ties -> first; no folds: the first point.
    ``fit_fn(moments, g, start)`` may warm-start from the previous grid point."""
    scores, n = np.zeros(len(grid)), 0
    for train, hold in grams.folds():
        n += 1
        start = None
        for gi in sorted(range(len(grid)), key=lambda i: -(grid[i] or 0)):
            b0, beta = fit_fn(train, grid[gi], start)
            start = beta
            scores[gi] += math.sqrt(hold.sse(b0, beta) / hold.n)
    if not n:
        return grid[0], None
    best = int(np.argmin(scores))
    return grid[best], float(scores[best] / n)


def fit_linear(prepared, features, label, name="lm", cv="cv", k=CV_DEFAULT_K, repeats=CV_DEFAULT_REPEATS,
               grams=None) -> Fitted:
    """M1 lm, M2 ridge ("glmnet", alpha 0), M3 lasso (alpha 1), M9 mean."""
    kk, reps = fold_plan(cv, k, repeats)
    name = ALIASES.get(name, name)
    g = grams if grams is not None else _grams(prepared, features, label, kk, reps)
    mo = g.all
    if name == "mean" or not features:
        _, score = _cv_select(lambda m, _g, _s: (m.my, np.zeros(m.p)), [None], g)
        return Fitted("mean", features, expr=F.lit(float(mo.my)), params={"mean": float(mo.my)}, cv_rmse=score)
    if name == "lm":
        b0, beta, se, rank = fit_ols(mo)
        _, score = _cv_select(lambda m, _g, _s: fit_ols(m)[:2], [None], g)
        t = {f: (float(abs(b / s)) if s and not np.isnan(s) and s > 0 else None) for f, b, s in zip(features, beta, se)}
        return Fitted("lm", features, expr=linear_expr(features, b0, beta), params={"intercept": float(b0), "rank": rank},
                      coef=dict(zip(features, map(float, beta))), importance=t, cv_rmse=score)
    alpha = {"glmnet": 0.0, "lasso": 1.0}[name]
    fit_fn = lambda m, lam, start=None: fit_elastic_net(m, lam, alpha, start=start)
    lam, score = _cv_select(fit_fn, list(LAMBDA_GRID), g)  # no resampling: the first lambda of the grid, stated
    b0, beta = fit_fn(mo, lam)
    return Fitted(name, features, expr=linear_expr(features, b0, beta),
                  params={"alpha": alpha, "lambda": lam, "intercept": float(b0)},
                  coef=dict(zip(features, map(float, beta))),
                  importance={f: abs(float(b)) for f, b in zip(features, beta)}, cv_rmse=score)


def fourier_features(n_features: int, sigma: float, components: int, seed: int):
    """Random Fourier features of the kernel exp(-sigma |x - x'|^2): w ~ N(0, 2 sigma I), b ~ U(0, 2 pi)."""
    rng = np.random.default_rng(seed)
    return (rng.normal(0.0, math.sqrt(2 * sigma), size=(components, n_features)), rng.uniform(0, 2 * math.pi, size=components))


def fit_svr(prepared, features, label, sigma=0.1, c=1.0, epsilon=0.1, components=100, seed=42, cv="cv", k=CV_DEFAULT_K,
            repeats=CV_DEFAULT_REPEATS) -> Fitted:
    """M7 svmRadial: epsilon-insensitive regression with an RBF kernel, by random Fourier features of it."""
    w, b = fourier_features(len(features), sigma, components, seed)
    kk, reps = fold_plan(cv, k, repeats)
    with folded(prepared, kk, reps) as rows:
        m = fit_machine(rows, features, label, w, b, c, epsilon, fold_names(reps), kk)
    return Fitted("svmRadial", features, expr=rff_score_expr(features, w, b, m.weights, m.intercept),
                  params={"sigma": sigma, "C": c, "epsilon": epsilon, "components": components, "passes": m.passes,
                          "objective": m.objective, "intercept": m.intercept},
                  cv_rmse=float(np.mean(m.held_out)) if m.held_out else None)


def fit_rbf_ridge(prepared, features, label, sigma=0.1, components=100, seed=42, cv="cv",
                  k=CV_DEFAULT_K, repeats=CV_DEFAULT_REPEATS) -> Fitted:
    """Kernel ridge: cross-validated ridge on random Fourier features, squared loss. The features are computed with numpy
    inside the Gram pass; scoring is a column expression."""
    w, b = fourier_features(len(features), sigma, components, seed)
    scale = math.sqrt(2.0 / components)

    def rff(x):
        return scale * np.cos(x @ w.T + b)

    kk, reps = fold_plan(cv, k, repeats)
    g = _grams(prepared, features, label, kk, reps, rff, components)
    fit_fn = lambda m, lam, start=None: fit_elastic_net(m, lam, 0.0)
    lam, score = _cv_select(fit_fn, list(LAMBDA_GRID), g)
    mo = g.all
    b0, beta = fit_fn(mo, lam)
    return Fitted("rbf_ridge", features, expr=rff_score_expr(features, w, b, beta * scale, b0),
                  params={"sigma": sigma, "components": components, "lambda": lam, "intercept": float(b0)},
                  cv_rmse=score)


def rff_score_expr(features: list[str], w: np.ndarray, b: np.ndarray, coef: np.ndarray, b0: float) -> Column:
    """b0 + Σ_j coef_j cos(w_j · x + b_j), scored per Arrow batch with numpy.

    A components x features sum of cosines is too large for one generated
    method, so Spark would interpret it row by row; the pandas UDF evaluates
    it as two matrix products per batch instead."""
    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(dtype=float)
        return pd.Series(b0 + np.cos(v @ w.T + b) @ coef)

    return score(F.struct(*[as_double(f).alias(f"_x{i}") for i, f in enumerate(features)]))


def _prune_hinges(mo, terms: list, max_terms: int, penalty: float):
    """Backward pruning of the columns ``terms`` of the moments by GCV to at most ``max_terms`` terms (intercept included).
    Returns (chosen columns, intercept, coefficients, GCV)."""
    n = mo.n

    def rss(sel):
        sel = list(sel)
        if not sel:
            return mo.vyy * n, np.zeros(0)
        beta = np.linalg.lstsq(mo.cxx[np.ix_(sel, sel)], mo.cxy[sel], rcond=None)[0]
        return float(max(mo.vyy - beta @ mo.cxy[sel], 0.0) * n), beta

    def gcv(sel):
        size = len(sel) + 1
        c = size + penalty * (size - 1) / 2
        return (rss(sel)[0] / n) / (1 - c / n) ** 2 if c < n else float("inf")

    path, cur = [list(terms)], list(terms)
    while cur:
        _, j = min((rss([t for t in cur if t != j])[0], j) for j in cur)
        cur = [t for t in cur if t != j]
        path.append(list(cur))
    chosen = min((s for s in path if len(s) + 1 <= max_terms), key=gcv)
    beta = rss(chosen)[1]
    return chosen, float(mo.my - mo.mx[chosen] @ beta), beta, float(gcv(chosen))


# The reference's number of terms after pruning, and the published defaults of what it leaves open.
HINGE_TERMS = 10
HINGE_THRESHOLD = 0.001
HINGE_PAIRS = 10


def fit_hinge(prepared, features, label, max_terms=HINGE_TERMS, pairs=HINGE_PAIRS, penalty=2.0, threshold=HINGE_THRESHOLD, cv="none",
              k=CV_DEFAULT_K, repeats=CV_DEFAULT_REPEATS) -> Fitted:
    """M8 earth, degree 1: hinge pairs max(0, x - t), max(0, t - x) are added with t any value of any feature (``hinges.py``), at most
    ``pairs`` and while a pair raises R squared by ``threshold``; one Gram pass over the chosen hinges then serves the pruning by GCV.
    Every held-out fold has hinges of its own, chosen in the same passes."""
    kk, reps = fold_plan(cv, k, repeats)
    folds = [(r, f) for r in range(reps) for f in range(kk)] if kk else []
    with folded(prepared, kk, reps) as rows:
        with ordered_blocks(rows, features, label, fold_names(reps) if kk else []) as (blocks, scale):
            models = forward(blocks, scale, len(features), folds, reps if kk else 0, pairs, threshold)
        terms = sorted({t for m in models for t in m.terms})
        if not terms:
            return fit_linear(rows, features, label, "mean", cv, k, repeats)
        of = np.array([t[0] for t in terms], dtype=int)
        at, sides = np.array([t[1] for t in terms]), np.array([t[2] for t in terms])

        def hinges(x):
            return np.maximum(0.0, (x[:, of] - at) * sides)

        g = _grams(rows, features, label, kk, reps, hinges, len(terms))
    number = {t: j for j, t in enumerate(terms)}
    mine = [[number[t] for t in m.terms] for m in models]
    held = []
    for f, chosen_of in zip(range(len(folds)), mine[1:]):
        hold = g.per.get(f)
        if hold is not None and g.of(hold).n > 0:
            chosen, b0, coef, _ = _prune_hinges(g.of(g.total - hold), chosen_of, max_terms, penalty)
            beta = np.zeros(len(terms))
            beta[chosen] = coef
            held.append(math.sqrt(g.of(hold).sse(b0, beta) / g.of(hold).n))
    chosen, b0, coef, gcv = _prune_hinges(g.all, mine[0], max_terms, penalty)
    expr = F.lit(b0)
    named, imp = {}, {}
    for c, j in zip(map(float, coef), chosen):
        i, t, side = terms[j]
        f = features[i]
        expr = expr + F.lit(c) * F.greatest(F.lit(0.0), (F.col(f"`{f}`") - F.lit(t)) * F.lit(side))
        named[f"h({f},{t},{int(side)})"] = c
        imp[f] = imp.get(f, 0.0) + abs(c)
    return Fitted("earth", features, expr=expr, params={"terms": len(chosen) + 1, "gcv": gcv}, coef=named,
                  importance=imp, cv_rmse=float(np.mean(held)) if held else None)


# ---------------------------------------------------------------- trees

# The reference's tuning constants of its boosted models (and the published defaults of what it leaves open).
BOOSTING = {
    "gbm": {"rounds": 100, "depth": 3, "rate": 0.1, "l2": 0.0, "least": 10.0, "bag": 0.5},
    "xgbTree": {"rounds": 100, "depth": 6, "rate": 0.3, "l2": 1.0, "least": 1.0, "bag": 1.0},
}


def fit_boosted(prepared, features, label, name, seed=42, max_depth=None, cv="none", k=CV_DEFAULT_K,
                repeats=CV_DEFAULT_REPEATS, **constants) -> Fitted:
    """M5 gbm and M6 xgbTree: second-order boosting over binned features; the models of all folds share every pass."""
    kk, reps = fold_plan(cv, k, repeats)
    used = BOOSTING[name] | constants | ({"depth": max_depth} if max_depth else {})
    with folded(prepared, kk, reps) as rows, packed(rows, features, label, fold_names(reps), kk) as blocks:
        model = boost(blocks, seed=seed, **used)
    return Fitted(name, features, expr=model.expr(features), params=used, importance=dict(zip(features, map(float, model.gain))),
                  cv_rmse=float(np.mean(model.held_out)) if model.held_out else None, ml_model=None)


def tree_estimator(max_depth: int | None = None, seed: int = 42):
    """Spark's learner of a single tree, depth 10 at most where nothing else is given."""
    from pyspark.ml.regression import DecisionTreeRegressor

    depth = max_depth or 10
    return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=7, seed=seed), {"maxDepth": depth}


FOREST_LEAST = 5  # fixed value: the reference's learner leaves nodes of at most 5 rows whole


def fit_random_forest(prepared, features, label, seed=42, num_trees=500, max_depth=None, cv="none", k=CV_DEFAULT_K,
                      repeats=CV_DEFAULT_REPEATS) -> Fitted:
    """M4 rf: trees grown to the end (``forest.py``), root of p features a node; with resampling also without each fold."""
    kk, reps = fold_plan(cv, k, repeats)
    mtry = max(1, min(int(math.floor(math.sqrt(len(features)))), len(features)))
    scores = []
    with folded(prepared, kk, reps) as rows:
        for fold in map(F.col, fold_names(reps) if kk else []):
            for f in range(kk):
                held = fit_forest(rows.where(fold != f), features, label, num_trees, mtry, FOREST_LEAST, seed, max_depth).score(
                    rows.where(fold == f), [label], "_held")
                err = F.col("_held") - F.col(f"`{label}`")
                r = held.agg(F.sqrt(F.avg(err * err)).alias("rmse")).first()["rmse"]
                if r is not None:
                    scores.append(r)
        model = fit_forest(rows, features, label, num_trees, mtry, FOREST_LEAST, seed, max_depth)
    return Fitted("rf", features, params={"mtry": mtry, "trees": num_trees, "least": FOREST_LEAST}, forest=model,
                  importance=dict(zip(features, map(float, model.gain))), cv_rmse=float(np.mean(scores)) if scores else None)


def fit_tree(prepared, features, label, name="tree", seed=42, max_depth=None, cv="none", k=CV_DEFAULT_K,
             repeats=CV_DEFAULT_REPEATS) -> Fitted:
    """R2: a single tree; with resampling it is also fitted without each fold, for the mean held-out RMSE."""
    if name not in ("tree", "rpart"):
        raise ValueError(f"unknown tree model {name}")
    est, params = tree_estimator(max_depth, seed)
    kk, reps = fold_plan(cv, k, repeats)
    est = est.setFeaturesCol("_features").setLabelCol(label).setPredictionCol("_held")
    scores = []
    with folded(prepared, kk, reps) as rows:
        data = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(rows)
        for fold in map(F.col, fold_names(reps) if kk else []):
            for f in range(kk):
                held = est.fit(data.where(fold != f)).transform(data.where(fold == f))
                err = F.col("_held") - F.col(f"`{label}`")
                r = held.agg(F.sqrt(F.avg(err * err)).alias("rmse")).first()["rmse"]
                if r is not None:
                    scores.append(r)
        model = est.fit(data)
    imp = dict(zip(features, map(float, model.featureImportances.toArray())))
    return Fitted(name, features, ml_model=model, params=params, importance=imp,
                  cv_rmse=float(np.mean(scores)) if scores else None)


def fit_model(name: str, prepared: DataFrame, features: list[str], label: str, cv="cv", k=CV_DEFAULT_K,
              repeats=CV_DEFAULT_REPEATS, seed=42, num_trees=500, grams=None, max_depth=None) -> Fitted:
    name = ALIASES.get(name, name)
    if name in ("lm", "glmnet", "lasso", "mean"):
        return fit_linear(prepared, features, label, name, cv, k, repeats, grams=grams)
    if name == "svmRadial":
        return fit_svr(prepared, features, label, cv=cv, k=k, repeats=repeats, seed=seed)
    if name == "rbf_ridge":
        return fit_rbf_ridge(prepared, features, label, cv=cv, k=k, repeats=repeats, seed=seed)
    if name == "earth":
        return fit_hinge(prepared, features, label, cv=cv, k=k, repeats=repeats)
    if name in BOOSTING:
        return fit_boosted(prepared, features, label, name, seed, max_depth, cv, k, repeats)
    if name == "rf":
        return fit_random_forest(prepared, features, label, seed, num_trees, max_depth, cv, k, repeats)
    return fit_tree(prepared, features, label, name, seed, max_depth, cv, k, repeats)


# ---------------------------------------------------------------- classification

def detect_task(df: DataFrame, target: str) -> str:
    """Numeric target -> "regression", anything else -> "classification"."""
    from ..operators.schema import is_numeric_type

    return "regression" if is_numeric_type(df.schema[target].dataType) else "classification"


def with_class_folds(kept: DataFrame, label: str, k: int, out: str = f"{FOLD}0") -> DataFrame:
    """``kept`` plus a fold 0..k-1 that is balanced within one row in every class of ``label``.

    A row's number within its class is counted on from partition to partition, without a shuffle; ``kept`` must be in the order of
    ``label`` within its partitions, and keep them. One row a partition and class is broadcast.
    """
    part = kept.select(F.spark_partition_id().alias("_part"), F.col(label).alias("_class"))
    counts = sorted(tuple(r) for r in part.groupBy("_part", "_class").count().collect())
    shifts, of_class, at, last = [], {}, 0, None
    for p, c, n in counts:
        at = 0 if p != last else at
        shifts.append((int(p), float(c), of_class.get(c, 0) - at))
        of_class[c], at, last = of_class.get(c, 0) + n, at + n, p
    table = F.broadcast(kept.sparkSession.createDataFrame(shifts or [(0, 0.0, 0)], "_part int, _class double, _shift long"))
    mid = F.monotonically_increasing_id()
    rows = kept.select("*", mid.alias("_mid")).withColumn("_part", F.shiftright("_mid", 33).cast("int"))
    rows = rows.join(table, (rows["_part"] == table["_part"]) & (rows[label] == table["_class"])).drop(table["_part"])
    number = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift")
    return rows.withColumn(out, F.pmod(number, F.lit(k)).cast("int")).drop("_part", "_class", "_shift", "_mid")


def compare_classifiers(df: DataFrame, target: str, features: list[str] | None = None, models=("logistic", "tree", "rf"),
                        seed: int = 42, num_trees: int = 100, tree_depth: int = 10, rf_depth: int = 5, predictions: bool = False,
                        cv: str = "none", k: int = CV_DEFAULT_K, partitions: int | None = None, confusion: bool = False):
    """Classifiers of a text target on predictors prepared by F1 (mean and mode fills, one-hot levels, near-constant and
    correlated ones dropped, scaled): training accuracy and, with ``cv``, accuracy on stratified held-out folds
    (model, accuracy, cv_accuracy, error). ``features`` are the predictors to use, by default all columns.

    With ``predictions`` returns (report, {model: DataFrame of (label, predicted)}), with ``confusion`` (report, table (model, label,
    predicted, n) of the held-out rows, of the training rows without ``cv``). The tree sizes are arguments."""
    from pyspark.ml.feature import IndexToString, StringIndexer

    from .features import preprocess

    kk, _ = fold_plan(cv, k, 1)
    features = [c for c in df.columns if c != target] if features is None else list(features)
    base = df.select(F.col(f"`{target}`").cast("string").alias("_class"), *[F.col(f"`{f}`") for f in features]).where(
        F.col("_class").isNotNull())
    indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(base)
    pre, prepared = preprocess(indexer.transform(base).drop("_class"), "_label")
    label, feats = prepared.columns[0], pre.features
    kept = prepared.repartition(partitions) if partitions else prepared
    kept = kept.sortWithinPartitions(label, F.xxhash64(*[F.col(f"`{c}`") for c in prepared.columns])).persist()
    names = F.array(*[F.lit(x) for x in indexer.labels])
    back = IndexToString(inputCol="_pred", outputCol="predicted", labels=indexer.labels)
    rows, pred, tables = [], {}, []

    def fit(name, data):
        if name == "rf":
            return fit_votes(data, feats, label, len(indexer.labels), num_trees, rf_depth, seed)
        return _classifier(name, seed, tree_depth).setFeaturesCol("_features").setLabelCol(label).setPredictionCol("_pred").fit(data)

    def named(out, *more):
        return back.transform(out).select(F.get(names, F.col(label).cast("int")).alias("label"), "predicted", *more)

    def counts(fitted, data):
        """(label, predicted, n)"""
        if isinstance(fitted, VoteForest):
            return named(fitted.counted(data, label), "n").groupBy("label", "predicted").agg(F.sum("n").alias("n"))
        return named(fitted.transform(data)).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))

    def share(table):
        r = table.agg(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))), F.sum("n")).first()
        return (r[0] or 0) / r[1]

    try:
        folds = with_class_folds(kept, label, kk) if kk else kept
        data = VectorAssembler(inputCols=feats, outputCol="_features").transform(folds)
        for m in models:
            try:
                fitted = fit(m, data)
                counted = [(m, *r) for r in counts(fitted, data).collect()]  # classes x classes
                accuracy, held = share(_confusion(df, counted)), None
                if kk:
                    counted = []
                    for f in range(kk):
                        there = counts(fit(m, data.where(F.col(f"{FOLD}0") != f)), data.where(F.col(f"{FOLD}0") == f))
                        counted += [(m, *r) for r in there.collect()]
                    held = share(_confusion(df, counted))
                rows.append((m, accuracy, held, None))
                pred[m] = named(fitted.transform(data))
                tables += counted
            except Exception as e:  # one failure does not stop the others
                rows.append((m, None, None, f"{m} failed: {e}"))
    finally:
        kept.unpersist()
    report = df.sparkSession.createDataFrame(rows, "model string, accuracy double, cv_accuracy double, error string")
    if confusion:
        return report, _confusion(df, tables).groupBy("model", "label", "predicted").agg(F.sum("n").alias("n"))
    return (report, pred) if predictions else report


def _confusion(df: DataFrame, rows: list) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "model string, label string, predicted string, n long")


def _classifier(name, seed, tree_depth):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    if name == "logistic":
        return LogisticRegression(maxIter=100)
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=tree_depth, seed=seed)
    raise ValueError(f"unknown classifier {name}")
