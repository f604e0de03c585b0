"""Numbers behind each chart (P1-P9, P11-P13). Drawing is left to any client.

Every operator returns a small aggregated table or the plotted points; none
brings rows to the driver. Binning uses statistics from one aggregate that
enter the plan as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import qnorm, qnorm_expr
from ..functions.positions import key_positions
from ..functions.quantiles import as_double, exact_quantiles
from ..functions.stats import correlation_values
from ..session import cut_lineage
from .schema import is_numeric_type, numeric_columns


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def melt_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Wide -> long (variable, value) over the numeric columns, values as double."""
    cols = numeric_columns(df) if cols is None else list(cols)
    wide = df.select([as_double(c).alias(c) for c in cols])
    return wide.unpivot([], cols, "variable", "value")


def _box_aggs(cols, res, k):
    aggs, fences = [], {}
    for i, c in enumerate(cols):
        q1, med, q3 = res[c]["q"]
        x = as_double(c)
        if q1 is None:
            fences[c] = (None, None, None, None, None)
            aggs += [F.lit(None).cast("double").alias(f"_lw{i}"), F.lit(None).cast("double").alias(f"_uw{i}"),
                     F.lit(0).cast("bigint").alias(f"_o{i}")]
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        fences[c] = (q1, med, q3, lo, hi)
        aggs += [
            F.min(F.when(x >= F.lit(lo), x)).alias(f"_lw{i}"),
            F.max(F.when(x <= F.lit(hi), x)).alias(f"_uw{i}"),
            F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"_o{i}"),
        ]
    return aggs, fences


def boxplot_stats(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, **kw) -> DataFrame:
    """Per variable n, q1, median, q3, whiskers (most extreme values inside
    1.5 IQR) and outlier count. Exact quartiles, then one aggregate; no unpivot."""
    cols = numeric_columns(df) if cols is None else list(cols)
    res = exact_quantiles(df, cols, [0.25, 0.5, 0.75], **kw)
    aggs, fences = _box_aggs(cols, res, k)
    row = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        q1, med, q3, _, _ = fences[c]
        rows.append((c, res[c]["n"], q1, med, q3, row[f"_lw{i}"], row[f"_uw{i}"], row[f"_o{i}"]))
    return df.sparkSession.createDataFrame(
        rows, "variable string, n long, q1 double, median double, q3 double, lower_whisker double, "
              "upper_whisker double, outliers long")


SALTS = 32  # a group's values meet its few numbers in so many parts, so a group of any size spreads


def _salted(groups: DataFrame) -> DataFrame:
    """Each group's row once for every salt."""
    return groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _value_pairs(df: DataFrame, by: str, col: str) -> DataFrame:
    """The distinct (group, value) pairs: ``_g, _v``, rows ``_c``, position ``_start`` in the order of both, and a salt."""
    base = df.select(_q(by).alias("_g"), as_double(col).alias("_v")).where(F.col("_v").isNotNull())
    return key_positions(base, ["_g", "_v"]).withColumnRenamed("_n", "_c").withColumn(
        "_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))


def _quantiles_of(pairs: DataFrame, by: str, probs) -> DataFrame:
    groups = pairs.groupBy("_g").agg(F.min("_start").alias("_first"), F.sum("_c").alias("_n"))
    wanted = []
    for j, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        k0 = F.floor(h)
        for side, k in ((0, k0), (1, F.least(k0 + 1, F.col("_n") - 1))):
            wanted.append(F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), (F.col("_first") + k).alias("_pos"),
                                   (h - k0).alias("frac")))
    picks = _salted(groups).select(F.col("_g").alias("_pg"), "_n", F.col("_salt").alias("_ps"), F.inline(F.array(*wanted)))
    hit = pairs.join(picks, pairs["_g"].eqNullSafe(picks["_pg"]) & (F.col("_salt") == F.col("_ps")) & (F.col("_pos") >= F.col("_start"))
                     & (F.col("_pos") < F.col("_start") + F.col("_c")))
    agg = hit.groupBy("_g", "_n", "j").agg(
        F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("v0"),
        F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("v1"),
        F.first("frac").alias("frac"),
    ).withColumn("q", F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0")))
    wide = agg.groupBy(F.col("_g").alias(by), F.col("_n").alias("n")).pivot("j", list(range(len(probs)))).agg(
        F.first("q"))
    return wide.select(by, "n", *[F.col(str(j)).alias(f"q_{j}") for j in range(len(probs))])


def grouped_quantiles(df: DataFrame, by: str, col: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact type-7 quantiles of ``col`` within each group of ``by``.

    Rows are counted by (group, value) map-side and the distinct pairs numbered in order, so neither a group nor
    a value that holds a third of the rows meets in one task; a group's order statistics are the
    pairs whose positions cover (group start + k). Result: (by, n, q_0, q_1, ...).
    """
    return _quantiles_of(_value_pairs(df, by, col), by, probs)


def boxplot_by(df: DataFrame, x: str, y: str, k: float = 1.5) -> DataFrame:
    """Box statistics of ``y`` per category of ``x`` (n, q1, median, q3,
    whiskers, outliers). Null categories form their own box, as in a chart. A numeric ``x`` is no category:
    it gives one box of all rows, with ``x`` null. The table is read once: fences meet the numbered (category, value) pairs."""
    if is_numeric_type(df.schema[x].dataType):
        df = df.select(F.lit(None).cast(df.schema[x].dataType).alias(x), _q(y))
    pairs = _value_pairs(df, x, y)
    qs = _quantiles_of(pairs, x, (0.25, 0.5, 0.75))
    side = qs.select(_q(x).alias("_sg"), "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"),
                     (F.col("q_0") - k * (F.col("q_2") - F.col("q_0"))).alias("_lo"),
                     (F.col("q_2") + k * (F.col("q_2") - F.col("q_0"))).alias("_hi"))
    side = _salted(side).withColumnRenamed("_salt", "_ss")
    joined = pairs.join(side, pairs["_g"].eqNullSafe(side["_sg"]) & (F.col("_salt") == F.col("_ss")))
    v, c = F.col("_v"), F.col("_c")
    outside = F.sum(F.when((v < F.col("_lo")) | (v > F.col("_hi")), c).otherwise(F.lit(0).cast("long")))
    return joined.groupBy(F.col("_g").alias(x), "n", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("lower_whisker"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("upper_whisker"),
        outside.alias("outliers"),
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """P4 for large tables: 2-D counts on a bins x bins grid over the data range
    (bin index clamped so the maximum lands in the last bin)."""
    xv, yv = as_double(x), as_double(y)
    base = df.select(xv.alias("_x"), yv.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    r = base.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).first()
    if r["x0"] is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, n long")

    def idx(v, lo, hi):
        w = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.floor((v - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")

    return base.groupBy(idx(F.col("_x"), r["x0"], r["x1"]).alias("bx"), idx(F.col("_y"), r["y0"], r["y1"]).alias("by")) \
        .agg(F.count(F.lit(1)).alias("n"))


def scatter_points(df: DataFrame, x: str | None = None, y: str | None = None, n: int | None = None,
                   seed: int = 0) -> DataFrame:
    """The (x, y) points to draw, default the first two numeric columns: all of them, or with ``n`` a sample
    of ``n`` rows (P11)."""
    num = numeric_columns(df)
    if x is None or y is None:
        if len(num) < 2:
            raise ValueError("need at least 2 numeric columns for a scatter plot")
        x, y = num[0], num[1]
    rows = df if n is None else plot_sample(df, n, seed)
    return rows.select(as_double(x).alias(x), as_double(y).alias(y))


def line_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """P5: (x, y) points of one line, ordered by x (range-partitioned sort)."""
    return df.select(_q(x).alias(x), as_double(y).alias(y)).orderBy(_q(x), _q(y))


def line_buckets(df: DataFrame, x: str, y: str, buckets: int = 1000) -> DataFrame:
    """P5 for large tables: per x-bucket min/max/first-last envelope of y."""
    xv = as_double(x)
    base = df.select(xv.alias("_x"), as_double(y).alias("_y")).where(F.col("_x").isNotNull())
    r = base.agg(F.min("_x").alias("a"), F.max("_x").alias("b")).first()
    if r["a"] is None:
        return df.sparkSession.createDataFrame([], "bucket int, x_min double, x_max double, y_min double, y_max double")
    w = (r["b"] - r["a"]) / buckets if r["b"] > r["a"] else 1.0
    b = F.least(F.floor((F.col("_x") - F.lit(r["a"])) / F.lit(w)), F.lit(buckets - 1)).cast("int")
    return base.groupBy(b.alias("bucket")).agg(
        F.min("_x").alias("x_min"), F.max("_x").alias("x_max"), F.min("_y").alias("y_min"), F.max("_y").alias("y_max"))


def _histogram(df: DataFrame, col: str, origin: float, width: float, nbins: int, empty_bins: bool) -> DataFrame:
    idx = F.greatest(F.ceil((as_double(col) - F.lit(origin)) / F.lit(width)) - 1, F.lit(0))
    idx = F.least(idx.cast("bigint"), F.lit(nbins - 1).cast("bigint"))
    counts = df.select(idx.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    if empty_bins:
        counts = df.sparkSession.range(nbins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    return counts.select(
        "bin",
        (F.lit(origin) + F.col("bin") * F.lit(width)).alias("x_min"),
        (F.lit(origin) + (F.col("bin") + 1) * F.lit(width)).alias("x_max"),
        (F.lit(origin) + (F.col("bin") + 0.5) * F.lit(width)).alias("center"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"))


_NO_BINS = "bin long, x_min double, x_max double, center double, count long"


def histogram_edges(lo: float, hi: float, bins: int) -> tuple[float, float]:
    """(origin, width) for ``bins`` bins: width = range/(bins-1), the first bin
    centred on the minimum, the last on the maximum."""
    if hi == lo:
        return lo - 0.05, 0.1
    width = (hi - lo) / (bins - 1) if bins > 1 else (hi - lo)
    origin = lo - width / 2 if bins > 1 else lo
    return origin, width


def histogram(df: DataFrame, col: str, bins: int = 15, empty_bins: bool = True) -> DataFrame:
    """(bin, x_min, x_max, center, count) with right-closed bins; empty bins kept (``bins`` rows)."""
    if not 1 <= bins:
        raise ValueError("bins must be positive")
    r = df.agg(F.min(as_double(col)).alias("lo"), F.max(as_double(col)).alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], _NO_BINS)
    origin, width = histogram_edges(r["lo"], r["hi"], bins)
    nb = bins if r["hi"] > r["lo"] else 1
    return _histogram(df, col, origin, width, nb, empty_bins)


def histogram_width(df: DataFrame, col: str, width: float = 10.0, empty_bins: bool = False) -> DataFrame:
    """Fixed-width, right-closed bins with edges at width/2 + k*width. The bins that hold rows; ``empty_bins`` fills
    the others in (range / width rows, made on Spark)."""
    r = df.agg(F.min(as_double(col)).alias("lo"), F.max(as_double(col)).alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], _NO_BINS)
    boundary = width / 2
    origin = boundary + math.floor((r["lo"] - boundary) / width) * width
    nb = max(1, int(math.ceil((r["hi"] - origin) / width)))
    return _histogram(df, col, origin, width, nb, empty_bins)


FIRST_FOR_PAIRS = 5  # fixed values: the reference's default numbers of columns
FIRST_FOR_MATRIX = 8


def _pairs(df: DataFrame, cols: list[str], complete: bool) -> DataFrame:
    if len(cols) < 2:
        raise ValueError("correlations need at least 2 numeric columns")
    vals = correlation_values(df, cols, complete=complete)
    rows = [(a, b, vals[(a, b)]) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, corr double")


def correlation_pairs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Upper triangle of the complete-rows correlation matrix, no diagonal:
    (var1, var2, corr), of ``cols`` or of all numeric columns; needs at least 2."""
    return _pairs(df, numeric_columns(df) if cols is None else list(cols), True)


def default_columns(df: DataFrame, most: int) -> tuple[list[str], list[str]]:
    """The numeric columns that the reference would draw by default, and those it would leave out."""
    num = numeric_columns(df)
    return num[:most], num[most:]


def pair_correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P9 (panel values): pairwise correlations of ``cols`` or of all numeric
    columns, each pair over the rows where both are present."""
    return _pairs(df, numeric_columns(df) if cols is None else list(cols), False)


def pair_matrix(df: DataFrame, cols: list[str] | None = None, n: int = 10_000, points: int = 512, seed: int = 0) -> DataFrame:
    """All panels of the pair plot as one table (panel, var1, var2, x, y): ``corr`` (y the correlation, x
    null), ``density`` (a column's curve, var2 null) and ``point`` (the sample of P11, each pair)."""
    cols = numeric_columns(df) if cols is None else list(cols)
    null = F.lit(None).cast("double")
    out = pair_correlations(df, cols).select(F.lit("corr").alias("panel"), "var1", "var2", null.alias("x"), F.col("corr").alias("y"))
    for c in cols:
        out = out.unionByName(density_curve(df, c, points).select(
            F.lit("density").alias("panel"), F.lit(c).alias("var1"), F.lit(None).cast("string").alias("var2"), "x",
            F.col("density").alias("y")))
    pairs = F.array(*[F.struct(F.lit("point").alias("panel"), F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                               as_double(a).alias("x"), as_double(b).alias("y"))
                      for i, a in enumerate(cols) for b in cols[i + 1:]])
    return out.unionByName(plot_sample(df, n, seed).select(F.inline(pairs)))


def density_curve(df: DataFrame, col: str, points: int = 512, grid_bins: int = 2048, **kw) -> DataFrame:
    """P9 (diagonal panels): Gaussian kernel density, bandwidth nrd0, evaluated
    on ``points`` x values from binned counts (the kernel runs over bin centres,
    not rows: one aggregate for the counts, then a bins x points sum on Spark)."""
    res = exact_quantiles(df, [col], [0.25, 0.75], extra=[F.stddev_samp(as_double(col)).alias("sd")], **kw)
    info, row = res[0][col], res[1]
    n, lo, hi = info["n"], info["min"], info["max"]
    spark = df.sparkSession
    if not n or n < 2:
        return spark.createDataFrame([], "x double, density double")
    q1, q3 = info["q"]
    sd = row["sd"] or 0.0
    spread = min(sd, (q3 - q1) / 1.34) if (q3 - q1) > 0 else sd
    if spread <= 0:
        spread = sd or abs(lo) or 1.0
    bw = 0.9 * spread * n ** (-0.2)
    a, b = lo - 3 * bw, hi + 3 * bw
    w = (b - a) / grid_bins
    x = as_double(col)
    # at most grid_bins (value, count) pairs reach the driver: bounded by the parameter
    counts = df.select(F.least(F.floor((x - F.lit(a)) / F.lit(w)), F.lit(grid_bins - 1)).cast("int").alias("k")) \
        .where(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect()
    import numpy as np

    ks = np.array([r["k"] for r in counts], dtype=float)
    cs = np.array([r["c"] for r in counts], dtype=float)
    centres = a + (ks + 0.5) * w
    xs = np.linspace(a, b, points)
    z = (xs[:, None] - centres[None, :]) / bw
    dens = (np.exp(-0.5 * z * z) * cs[None, :]).sum(axis=1) / (n * bw * math.sqrt(2 * math.pi))
    return spark.createDataFrame([(float(u), float(v)) for u, v in zip(xs, dens)], "x double, density double")


def plot_sample(df: DataFrame, n: int = 10_000, seed: int = 0) -> DataFrame:
    """``n`` rows drawn at random without replacement (all rows of a table of at most ``n``).

    Each row draws its own number, so equal rows are kept or left independently. Rows under a threshold
    (about 3 n expected, from one count) are checkpointed, which fixes their numbers, and the ``n``
    smallest are taken: the last step merges about 3 n rows whatever the table's size. The draw repeats for the
    same seed and the same input files."""
    total = df.count()
    if total <= n:
        return df
    frac = min(1.0, 3.0 * n / total + 10.0 * math.sqrt(n) / total)
    while True:
        kept = cut_lineage(df.withColumn("_r", F.rand(seed)).where(F.col("_r") < frac))
        if frac >= 1.0 or kept.count() >= n:
            return kept.orderBy("_r").limit(n).drop("_r")
        frac = min(1.0, frac * 2)


_CHUNK = 10_000  # rows of one value that one task of qq_points writes


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """(position, theoretical, sample): the sorted sample against normal
    quantiles at (i - a)/(n + 1 - 2a), a = 3/8 for n <= 10, else 1/2.

    Equal values are counted first and numbered as one; a frequent value is cut into chunks that are dealt out before
    its points are written."""
    base = df.select(as_double(col).alias("sample")).where(F.col("sample").isNotNull())
    ranked = key_positions(base, ["sample"])
    n = ranked.agg(F.sum("_n")).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], "position long, theoretical double, sample double")
    a = 3.0 / 8.0 if n <= 10 else 0.5
    chunks = ranked.select("sample", "_start", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_CHUNK}"))).alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is not merged by AQE, which sees few bytes
    points = chunks.repartition(parts, "sample", "_c").select("sample", F.explode(F.sequence(
        F.col("_start") + F.col("_c") * _CHUNK + 1, F.col("_start") + F.least(F.col("_n"), (F.col("_c") + 1) * _CHUNK))).alias("position"))
    prob = (F.col("position") - F.lit(a)) / F.lit(n + 1 - 2 * a)
    return points.select("position", qnorm_expr(prob).alias("theoretical"), "sample")


def qq_line(df: DataFrame, col: str) -> dict:
    """The reference line through the sample quartiles (type 7) and the normal quartiles."""
    q1, q3 = exact_quantiles(df, [col], [0.25, 0.75])[col]["q"]
    z1, z3 = qnorm(0.25), qnorm(0.75)
    slope = (q3 - q1) / (z3 - z1)
    return {"slope": slope, "intercept": q1 - slope * z1}


def metrics_long(metrics: DataFrame, id_col: str = "model", cols=("rmse", "mape", "r_squared")) -> DataFrame:
    """(model, metric, value), rows with a null value dropped."""
    return metrics.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([id_col], list(cols), "metric", "value").where(F.col("value").isNotNull())
