"""Model-facing statistics: feature stats, Pearson correlation, Ridge baseline.

All are sufficient-statistics aggregates (sums over rows, d x d numbers back to the driver);
the only driver-side work is solving a d x d system.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) --------------------------------------
RIDGE_ALPHA = 1.0
MIN_TRAIN_ROWS = 5


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, std, min, max) with the population std."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}")]
    parts = ", ".join(f"'{c}', `m{i}`, `s{i}`, `mn{i}`, `mx{i}`" for i, c in enumerate(cols))
    return df.agg(*aggs).select(F.expr(f"stack({len(cols)}, {parts}) as (column, mean, std, min, max)"))


def correlation_matrix(df: DataFrame, cols: list[str], means: dict[str, float | None] | None = None) -> DataFrame:
    """(feature_i, feature_j, corr): two passes (means, unless they are given, then centred cross sums)
    for stability; a constant column gives NULL instead of a division error."""
    spark = df.sparkSession
    if means is None:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    cen = [F.col(c) - F.lit(means[c]) for c in cols]
    aggs = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.sum(cen[i] * cen[j]).alias(f"c{i}_{j}"))
    row = df.agg(*aggs).first()
    recs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = min(i, j), max(i, j)
            sxy, sxx, syy = row[f"c{lo}_{hi}"], row[f"c{i}_{i}"], row[f"c{j}_{j}"]
            den = (sxx * syy) ** 0.5 if sxx is not None and syy is not None else 0.0
            recs.append((a, b, (sxy / den) if den else None))
    return spark.createDataFrame(recs, "feature_i string, feature_j string, corr double")


def ridge_fit(df: DataFrame, xcols: list[str], ycol: str, alpha: float = RIDGE_ALPHA):
    """Ridge with an unpenalised intercept from two passes, means and then centred cross sums:
    returns (n, w, b) or None."""
    d = len(xcols)
    m = df.agg(F.count(F.lit(1)).alias("n"), F.avg(ycol).alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(xcols)]).first()
    n = m["n"]
    if n < MIN_TRAIN_ROWS:
        return None
    mx, my = np.array([m[f"m{i}"] for i in range(d)]), m["y"]
    cen = [F.col(c) - F.lit(m[f"m{i}"]) for i, c in enumerate(xcols)]
    aggs = [F.sum(x * (F.col(ycol) - F.lit(my))).alias(f"y{i}") for i, x in enumerate(cen)]
    aggs += [F.sum(cen[i] * cen[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i, d)]
    r = df.agg(*aggs).first()
    A = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float).reshape(d, d)
    A += alpha * np.eye(d)
    c = np.array([r[f"y{i}"] for i in range(d)])
    w = np.linalg.solve(A, c)
    b = my - float(mx @ w)
    return n, w, b


def ridge_baseline(df: DataFrame, xcols: list[str], ycol: str, split_col: str | None = "split", alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Fit on train, mean squared error on val (no split: fit and evaluate on all rows).
    Empty result when fewer than 5 training rows."""
    spark: SparkSession = df.sparkSession
    train = df.where(F.col(split_col) == "train") if split_col else df
    val = df.where(F.col(split_col) == "val") if split_col else df
    fit = ridge_fit(train, xcols, ycol, alpha)
    if fit is None:
        return spark.createDataFrame([], "baseline_mse double, n_train bigint, n_val bigint")
    n, w, b = fit
    pred = F.lit(float(b))
    for c, wi in zip(xcols, w):
        pred = pred + F.col(c) * F.lit(float(wi))
    return val.agg(
        F.avg((F.col(ycol) - pred) * (F.col(ycol) - pred)).alias("baseline_mse"),
        F.lit(int(n)).cast("bigint").alias("n_train"),
        F.count(F.lit(1)).cast("bigint").alias("n_val"),
    )
