"""Feature engineering: scaling, categorical encoding, feature rows, finite guard, schema hash."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import is_finite, schema_hash
from fieldspark.operators.lookup import frequent_values, lookup
from fieldspark.operators.ordered import global_position
from fieldspark.session import cut_lineage
from fieldspark.operators.quantiles import quantiles

# --- fixed values (must equal the reference's behaviour) --------------------------------------
ZERO_SCALE_EPS = 10 * sys.float_info.epsilon  # a scale below this is treated as 0 -> 1
MISSING_CATEGORY = "nan"  # text of a missing categorical cell before encoding


@dataclass
class ScalerParams:
    kind: str  # "standard" | "robust"
    columns: list[str]
    center: dict[str, float]
    scale: dict[str, float]


def _safe_scale(s: float | None) -> float:
    return 1.0 if s is None or s < ZERO_SCALE_EPS else float(s)


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard") -> ScalerParams:
    """standard: (x - mean) / population std; robust: (x - median) / IQR; zero scale -> 1."""
    if kind == "standard":
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        center = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        scale = {c: _safe_scale(row[f"s{i}"]) for i, c in enumerate(cols)}
    elif kind == "robust":
        q = quantiles(df, {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75])
        center = {c: q[c][1] for c in cols}
        scale = {c: _safe_scale(None if q[c][0] is None else q[c][2] - q[c][0]) for c in cols}
    else:
        raise ValueError("kind must be 'standard' or 'robust'")
    return ScalerParams(kind, list(cols), center, scale)


def apply_scaler(df: DataFrame, p: ScalerParams) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(p.center[c])) / F.lit(p.scale[c]) for c in p.columns})


def scaler_table(spark: SparkSession, p: ScalerParams) -> DataFrame:
    rows = [(c, p.kind, p.center[c], p.scale[c]) for c in p.columns]
    return spark.createDataFrame(rows, "column string, type string, center double, scale double")


def category_text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(MISSING_CATEGORY))


def fit_categories(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct text values, code = 0-based position in sorted order.

    The distinct values are ranked with the bucketed global position, not a single-task window.
    """
    distinct = df.select(category_text(col).alias("value")).distinct()
    ranked = global_position(distinct, "_pos", ["value"])
    return ranked.select("value", (F.col("_pos") - 1).cast("int").alias("code"))


def category_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, code, value) mapping table for every encoded column."""
    out = None
    for c in cols:
        t = fit_categories(df, c).select(F.lit(c).alias("column"), "code", "value")
        out = t if out is None else out.unionByName(t)
    return out


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code", categories: DataFrame | None = None) -> DataFrame:
    """Adds ``<col><suffix>`` with the category code, looked up in the category table without moving all
    rows of a value to one task; a fitted ``category_table`` can be passed to reuse codes, unseen
    values get NULL."""
    out = df
    for c in cols:
        fitted = (
            categories.where(F.col("column") == c).select("value", "code") if categories is not None else fit_categories(df, c)
        )
        out = lookup(out, category_text(c), fitted.select(F.col("value").alias("_v"), F.col("code").alias(c + suffix)), "_v")
    return out


WIDE_CATEGORIES = 4096  # columns that the wide one-hot form makes at most


def label_encode_skewed(df: DataFrame, cols: list[str], suffix: str = "_code", categories: DataFrame | None = None) -> DataFrame:
    """``label_encode`` for columns of many categories of which a few fill most rows: rows with one of
    the FREQUENT most frequent values take their code by broadcast and stay where they are; the others
    move to the table of all categories, at most a small share of all rows for each value."""
    out = df
    for c in cols:
        fitted = cut_lineage(categories.where(F.col("column") == c).select("value", "code") if categories is not None else fit_categories(df, c))
        cats = fitted.select(F.col("value").alias("_v"), F.col("code").alias(c + suffix))
        often = cut_lineage(frequent_values(df, category_text(c)))
        first = F.broadcast(often.join(fitted, "value", "left").select(F.col("value").alias("_f"), F.col("code").alias("_fc")))
        marked = out.join(first, category_text(out[c]) == F.col("_f"), "left")
        held = marked.where("_f is not null").withColumn(c + suffix, F.col("_fc")).drop("_f", "_fc")
        rest = marked.where("_f is null").drop("_f", "_fc")
        out = held.unionByName(rest.join(cats, category_text(rest[c]) == cats["_v"], "left").drop("_v"))
    return out


def onehot_categories(df: DataFrame, col: str) -> list[str]:
    """Sorted category texts: they name the columns of the wide form, WIDE_CATEGORIES at most. A column with
    more raises an error; ``onehot_sparse`` encodes any number."""
    found = [r["v"] for r in df.select(category_text(col).alias("v")).distinct().limit(WIDE_CATEGORIES + 1).collect()]
    if len(found) > WIDE_CATEGORIES:
        raise ValueError(f"{col!r} has more than {WIDE_CATEGORIES} categories; use onehot_sparse")
    return sorted(found)


def onehot_sparse(df: DataFrame, cols: list[str], categories: DataFrame | None = None) -> DataFrame:
    """Adds ``onehot_indices ARRAY<INT>``: the slots that are 1 in the one-hot vector over all ``cols``
    (in the order of ``cols``, each by sorted category), and its length ``onehot_size``. For any number
    of categories: one slot a column and row, nothing but a count per column on the driver. Unseen
    values have no slot."""
    cats = cut_lineage(category_table(df, cols)) if categories is None else categories
    counts = {r["column"]: r["n"] for r in cats.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, slots, start = label_encode(df, cols, "_slot", cats), [], 0
    for c in cols:
        slots.append(F.col(f"{c}_slot") + F.lit(start))
        start += counts.get(c, 0)
    out = out.withColumn("onehot_indices", F.array_compact(F.array(*slots))).withColumn("onehot_size", F.lit(start))
    return out.drop(*[f"{c}_slot" for c in cols])


def onehot_encode(df: DataFrame, cols: list[str], categories: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """One 0/1 column ``<col>_<value>`` per sorted category; unseen values -> all zeros. Columns are
    part of the schema; ``onehot_sparse`` is the form for many categories."""
    names: list[str] = []
    exprs: dict[str, Column] = {}
    for c in cols:
        cats = (categories or {}).get(c) or onehot_categories(df, c)
        for v in cats:
            n = f"{c}_{v}"
            exprs[n] = (category_text(c) == F.lit(v)).cast("double")
            names.append(n)
    return df.withColumns(exprs), names


def nonfinite_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_nonfinite): NULL, NaN or +-Inf cells per column."""
    aggs = [F.count_if(~is_finite(F.col(c).cast("double"))).cast("bigint").alias(f"n{i}") for i, c in enumerate(cols)]
    parts = ", ".join(f"'{c}', `n{i}`" for i, c in enumerate(cols))
    return df.agg(*aggs).select(F.expr(f"stack({len(cols)}, {parts}) as (column, n_nonfinite)"))


def assert_finite(df: DataFrame, cols: list[str]) -> None:
    bad = [r["column"] for r in nonfinite_counts(df, cols).where("n_nonfinite > 0").collect()]
    if bad:
        raise ValueError(f"NaN, Inf or missing values in feature columns {bad}; clean the table first")


@dataclass
class FeatureSpec:
    numeric: list[str]
    categorical: list[str]
    target: str | None = None
    scaling: str = "standard"
    encoding: str = "label"
    fit_on: str = "all"  # "all" (reference parity) or "train" (no leakage; needs a split column)


def select_features(df: DataFrame, target: str | None, categorical: list[str], exclude: tuple[str, ...] = ("rid", "confidence"), **spec) -> FeatureSpec:
    """Every numeric column but the target and ``exclude``, and the categorical ones that are there."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target and f.name not in exclude and f.name not in categorical]
    return FeatureSpec(numeric, [c for c in categorical if c in df.columns], target, **spec)


def feature_matrix(df: DataFrame, spec: FeatureSpec, key: str = "rid", split_col: str | None = None, categories: DataFrame | None = None):
    """Rows of ``features ARRAY<FLOAT>`` (numeric scaled first, then categorical) and
    ``target FLOAT``. Returns (frame, feature_names, scaler params)."""
    num = [c for c in spec.numeric if c in df.columns and c != spec.target]
    cat = [c for c in spec.categorical if c in df.columns]
    check = num + ([spec.target] if spec.target and spec.target in df.columns else [])
    if check:
        assert_finite(df, check)
    fit_df = df.where(F.col(split_col) == "train") if spec.fit_on == "train" and split_col else df
    params = fit_scaler(fit_df, num, spec.scaling) if num else ScalerParams(spec.scaling, [], {}, {})
    out = apply_scaler(df, params)
    names = list(num)
    feats: list[Column] = [F.col(c) for c in num]
    if spec.encoding == "label":
        out = label_encode(out, cat, categories=categories)
        feats += [F.col(c + "_code") for c in cat]
        names += cat
    else:
        out, oh = onehot_encode(out, cat)
        feats += [F.col(n) for n in oh]
        names += oh
    cols = [F.col(key), F.array(*[f.cast("float") for f in feats]).alias("features")]
    if spec.target and spec.target in df.columns:
        cols.append(F.col(spec.target).cast("float").alias("target"))
    if split_col and split_col in df.columns:
        cols.append(F.col(split_col))
    return out.select(*cols), names, params


def schema_lock(columns: list[str]) -> str:
    import hashlib

    return hashlib.sha256(",".join(sorted(str(c) for c in columns)).encode()).hexdigest()[:16]


def schema_hash_by_group(catalog: DataFrame, group: str, name_col: str = "column") -> DataFrame:
    """Schema-drift detection over a (group, column) catalogue: order-insensitive hash per group."""
    return catalog.groupBy(group).agg(schema_hash(F.collect_list(name_col)).alias("schema_hash"))
