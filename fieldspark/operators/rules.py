"""Row-local cleaning rules: confidence, bounds, agronomic limits, outliers, sparse columns.

Every rule is a projection (fused by Catalyst into one codegen stage). Rules that need data
statistics are split into ``fit_*`` (one distributed aggregate, a handful of scalars back) and
``apply_*`` (pure expressions with the statistics inlined as literals), so frozen statistics can
be re-applied to new data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.quantiles import quantiles_with_stats

# --- fixed values (must equal the reference's behaviour) --------------------------------------
MAX_YIELD_PENALTY = 0.3  # soft mode: confidence multiplier when yield > max_yield
SEASON_PENALTY = 0.1  # soft mode: confidence multiplier when yield > 0 outside harvest months
OUTLIER_PENALTY = 0.5  # soft mode: confidence multiplier per flagged column
ZSCORE_LIMIT = 3.0
MIN_OUTLIER_VALUES = 10  # outlier statistics need at least this many non-null values


def init_confidence(df: DataFrame, soft: bool = True) -> DataFrame:
    return df.withColumn("confidence", F.lit(1.0)) if soft else df


def out_of_bounds(c: str, lo: float, hi: float) -> Column:
    x = F.col(c)
    return x.isNotNull() & ((x < F.lit(float(lo))) | (x > F.lit(float(hi))))


def physical_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], flag: str | None = None) -> DataFrame:
    """Cells outside ``[lo, hi]`` become NULL (hard even in soft mode); ``flag`` counts them per row."""
    present = {c: b for c, b in bounds.items() if c in df.columns}
    for c, (lo, hi) in present.items():
        if lo > hi:
            raise ValueError(f"lower bound {lo} of {c!r} is above upper bound {hi}")
    cols: dict[str, Column] = {}
    bad = [out_of_bounds(c, lo, hi).cast("int") for c, (lo, hi) in present.items()]
    if flag:
        cols[flag] = sum(bad[1:], bad[0]) if bad else F.lit(0)
    for c, (lo, hi) in present.items():
        cols[c] = F.when(out_of_bounds(c, lo, hi), F.lit(None)).otherwise(F.col(c))
    return df.withColumns(cols) if cols else df


def agronomic_rules(
    df: DataFrame,
    max_yield: float | Column | None = None,
    harvest_months: list[int] | Column | None = None,
    soft: bool = False,
    date_col: str = "date",
    yield_col: str = "yield",
    flag: str | None = None,
) -> DataFrame:
    """Max-yield and harvest-season rules on ``yield``.

    Hard mode nulls the cell (a row nulled by the max-yield rule is no longer ``> 0`` and is not
    counted again by the season rule); soft mode multiplies ``confidence`` by 0.3 / 0.1.
    ``max_yield`` / ``harvest_months`` may be literals or per-row columns (preset join).
    A missing date counts as out of season.
    """
    if yield_col not in df.columns:
        return df.withColumn(flag, F.lit(0)) if flag else df
    y = F.col(yield_col)
    mx = F.lit(float(max_yield)) if isinstance(max_yield, (int, float)) else max_yield
    too_high = (y > mx) if mx is not None else F.lit(False)
    too_high = F.coalesce(too_high, F.lit(False))
    if harvest_months is None or (isinstance(harvest_months, list) and not harvest_months) or date_col not in df.columns:
        season_bad = F.lit(False)
    elif isinstance(harvest_months, list):
        in_season = F.month(F.col(date_col)).isin([int(m) for m in harvest_months])
        season_bad = ~F.coalesce(in_season, F.lit(False))
    else:
        in_season = F.array_contains(harvest_months, F.month(F.col(date_col)))
        season_bad = F.coalesce(F.size(harvest_months) > 0, F.lit(False)) & ~F.coalesce(in_season, F.lit(False))
    if soft:
        conf = F.col("confidence") if "confidence" in df.columns else F.lit(1.0)
        conf = conf * F.when(too_high, F.lit(MAX_YIELD_PENALTY)).otherwise(F.lit(1.0))
        conf = conf * F.when(F.coalesce(y > 0, F.lit(False)) & season_bad, F.lit(SEASON_PENALTY)).otherwise(F.lit(1.0))
        out = {"confidence": conf}
        if flag:
            out[flag] = F.lit(0)
        return df.withColumns(out)
    after_max = F.when(too_high, F.lit(None)).otherwise(y)
    season_hit = F.coalesce(after_max > 0, F.lit(False)) & season_bad
    out = {yield_col: F.when(season_hit, F.lit(None)).otherwise(after_max)}
    if flag:
        out[flag] = too_high.cast("int") + season_hit.cast("int")
    return df.withColumns(out)


@dataclass
class OutlierStats:
    method: str
    limits: dict[str, tuple[float, float]]  # column -> (lo, hi); value outside is an outlier
    zstats: dict[str, tuple[float, float]]  # column -> (mean, std) for z-score


def fit_outliers(df: DataFrame, cols: list[str], method: str = "iqr", k: float = 1.5, accuracy: int | None = None) -> OutlierStats:
    """Thresholds per column (columns with < 10 non-null values, or std 0 for z-score, are skipped)."""
    cols = [c for c in cols if c in df.columns]
    if method == "none" or not cols:
        return OutlierStats(method, {}, {})
    if method == "zscore":
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        z = {}
        for i, c in enumerate(cols):
            n, m, s = row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]
            if n >= MIN_OUTLIER_VALUES and s is not None and s != 0:
                z[c] = (float(m), float(s))
        return OutlierStats(method, {}, z)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    stats = {c: (row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}
    usable = [c for c in cols if stats[c][0] >= MIN_OUTLIER_VALUES]
    q = quantiles_with_stats(df, {c: F.col(c) for c in usable}, [0.25, 0.75], {c: stats[c] for c in usable}, accuracy=accuracy)
    limits = {}
    for c in usable:
        q1, q3 = q[c]
        iqr = q3 - q1
        limits[c] = (q1 - k * iqr, q3 + k * iqr)
    return OutlierStats(method, limits, {})


def outlier_flag(c: str, st: OutlierStats) -> Column:
    x = F.col(c)
    if st.method == "zscore":
        m, s = st.zstats[c]
        return F.coalesce(F.abs(x - F.lit(m)) / F.lit(s) > F.lit(ZSCORE_LIMIT), F.lit(False))
    lo, hi = st.limits[c]
    return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


def apply_outliers(df: DataFrame, st: OutlierStats, soft: bool = False, flag: str | None = None) -> DataFrame:
    cols = list(st.zstats) if st.method == "zscore" else list(st.limits)
    cols = [c for c in cols if c in df.columns]
    out: dict[str, Column] = {}
    flags = [outlier_flag(c, st) for c in cols]
    if soft:
        if cols:
            conf = F.col("confidence") if "confidence" in df.columns else F.lit(1.0)
            for f in flags:
                conf = conf * F.when(f, F.lit(OUTLIER_PENALTY)).otherwise(F.lit(1.0))
            out["confidence"] = conf
        if flag:
            out[flag] = F.lit(0)
    else:
        for c, f in zip(cols, flags):
            out[c] = F.when(f, F.lit(None)).otherwise(F.col(c))
        if flag:
            ints = [f.cast("int") for f in flags]
            out[flag] = sum(ints[1:], ints[0]) if ints else F.lit(0)
    return df.withColumns(out) if out else df


def null_ratios(df: DataFrame, cols: list[str] | None = None) -> dict[str, float]:
    """Share of NULL cells per column, all columns in one aggregate."""
    cols = cols or df.columns
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"r{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"r{i}"] if row[f"r{i}"] is not None else 0.0) for i, c in enumerate(cols)}


def sparse_columns(ratios: dict[str, float], threshold: float = 0.5, protect: tuple[str, ...] = ()) -> list[str]:
    """Columns whose null ratio is strictly above the threshold."""
    return [c for c, r in ratios.items() if r > threshold and c not in protect]


def drop_sparse(df: DataFrame, threshold: float = 0.5, protect: tuple[str, ...] = ()) -> DataFrame:
    to_drop = sparse_columns(null_ratios(df), threshold, protect)
    return df.drop(*to_drop) if to_drop else df
