"""The full clean: a fixed chain of DataFrame -> DataFrame steps plus lazy diagnostics.

Order (as the reference runs it): confidence -> units -> coercion -> categorical fill ->
sparse-column drop -> physical bounds -> agronomic rules -> outliers -> missing values ->
de-duplication -> [growing degree days].

Data-dependent barriers are single aggregates over all columns at once (null counts; outlier
thresholds; fill constants), so a clean costs a fixed number of passes whatever the width.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import coerce_numeric, nan_to_null, parse_timestamp
from fieldspark.operators.dedup import dedup_keep_last
from fieldspark.operators.gdd import gdd
from fieldspark.operators.impute import apply_constants, fit_constants, impute_categorical, impute_drop, impute_ffill, impute_time
from fieldspark.operators.rules import (
    OutlierStats,
    agronomic_rules,
    apply_outliers,
    fit_outliers,
    init_confidence,
    physical_bounds,
)
from fieldspark.operators.units import RANGE_RULES, convert_units, match_suffix
from fieldspark.plans.config import CleanPlan
from fieldspark.session import cut_lineage

FLAGS = ("_oob", "_agro", "_out")
DIAGNOSTIC_METRICS = (
    "total_rows",
    "out_of_bounds_removed",
    "agronomic_outliers_removed",
    "outliers_removed",
    "values_imputed",
    "duplicates_removed",
)


@dataclass
class CleanResult:
    df: DataFrame
    diagnostics: DataFrame  # (metric STRING, value BIGINT), computed lazily from the data
    strategy_used: str
    numeric_columns: list[str]
    dropped_columns: list[str]
    unit_conversions: list[tuple[str, str, str, str]] = field(default_factory=list)
    outlier_stats: OutlierStats | None = None
    fill_values: dict[str, float | None] = field(default_factory=dict)
    pre_dedup: DataFrame | None = None
    observations: dict | None = None
    persisted: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Unpersist what the clean kept in memory for ``df`` and ``diagnostics``, once both are written."""
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()

    def observed(self) -> dict[str, int]:
        """Diagnostics gathered in flight (``clean(..., observe=True)``): no extra pass over the
        data, available once an action over ``df`` (e.g. its write) has completed."""
        if not self.observations:
            raise ValueError("clean() was not run with observe=True")
        pre = self.observations["pre"].get
        post = self.observations["post"].get
        final = self.observations["final"].get
        return {
            "total_rows": int(pre["total_rows"]),
            "out_of_bounds_removed": int(pre["oob"] or 0),
            "agronomic_outliers_removed": int(pre["agro"] or 0),
            "outliers_removed": int(pre["out"] or 0),
            "values_imputed": 0 if self.strategy_used == "drop" else int((pre["nulls"] or 0) - (post["nulls"] or 0)),
            "duplicates_removed": int(post["rows"] - final["rows"]),
        }


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def coerce(df: DataFrame, date_cols: list[str], numeric_cols: list[str]) -> DataFrame:
    """Dates: text parsed with coercion; numerics: decimal comma, unparsable -> NULL; NaN -> NULL."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    upd: dict[str, Column] = {}
    for c in date_cols:
        if c not in types:
            continue
        t = types[c]
        if isinstance(t, T.StringType):
            upd[c] = parse_timestamp(F.col(c))
        elif isinstance(t, T.DateType):
            upd[c] = F.col(c).cast("timestamp_ntz")
    for c in numeric_cols:
        if c not in types or c in upd:
            continue
        t = types[c]
        if isinstance(t, T.StringType):
            upd[c] = coerce_numeric(F.col(c))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            upd[c] = nan_to_null(F.col(c))
    for c, t in types.items():  # ingress rule: NaN is missing everywhere
        if c not in upd and isinstance(t, (T.DoubleType, T.FloatType)):
            upd[c] = nan_to_null(F.col(c))
    return df.withColumns(upd) if upd else df


def _sum(cols: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, cols) if cols else F.lit(0)


def _long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    row = df.agg(*[v.cast("bigint").alias(k) for k, v in metrics.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in metrics)
    return row.select(F.expr(f"stack({len(metrics)}, {stack}) as (metric, value)"))


def clean(df: DataFrame, plan: CleanPlan = CleanPlan(), observe: bool = False) -> CleanResult:
    rid = plan.row_id
    if rid not in df.columns:
        raise ValueError(f"row identity column {rid!r} is required (assign it at ingest)")
    date_col = plan.date_col

    kept: list[DataFrame] = []

    def keep(frame: DataFrame) -> DataFrame:
        if plan.checkpoint:
            return cut_lineage(frame)
        kept.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        return frame

    df = init_confidence(df, plan.soft_cleaning)
    unit_report: list = []
    # text cells of columns that units, bounds or the plan treat as numbers become numbers first
    measured = [c for c in df.columns if c in plan.numeric_columns or c in plan.physical_bounds or match_suffix(c) or c in {r[0] for r in RANGE_RULES}]
    df = coerce(df, [], measured)
    if plan.auto_unit_conversion:
        df, unit_report = convert_units(df, plan.unit_range_heuristic)

    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if plan.numeric_columns:
        numeric = [c for c in plan.numeric_columns if c in types]
    else:
        numeric = []
    df = coerce(df, list(plan.date_columns), numeric)
    if not plan.numeric_columns:
        numeric = [
            f.name for f in df.schema.fields if _is_numeric(f.dataType) and f.name not in (rid, "confidence")
        ]

    # barrier 1: null counts of every column -> categorical fills needed, sparse columns
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)]).first()
    n = row["_n"]
    nulls = {c: n - row[f"_c{i}"] for i, c in enumerate(cols)}
    cats = [c for c in plan.categorical_columns if c in cols]
    to_fill = [c for c in cats if 0 < nulls[c] < n] if date_col in cols else []
    if to_fill:
        df = impute_categorical(df, to_fill, date_col, rid, list(plan.categorical_by) or None)
        # the window-heavy fill feeds several statistics passes: keep it instead of recomputing
        df = keep(df)
        left = df.agg(*[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(to_fill)]).first()
        nulls.update({c: n - left[f"_c{i}"] for i, c in enumerate(to_fill)})
    ratio = {c: nulls[c] / n if n else 0.0 for c in cols}
    dropped = [
        c for c in cols if ratio[c] > plan.missing_drop_threshold and c not in plan.protect_columns and c != rid
    ]
    if dropped:
        df = df.drop(*dropped)
        numeric = [c for c in numeric if c not in dropped]

    df = physical_bounds(df, plan.physical_bounds, flag="_oob")
    df = agronomic_rules(
        df, plan.max_yield, list(plan.harvest_months), plan.soft_cleaning, date_col, "yield", flag="_agro"
    )
    ost = fit_outliers(df, numeric, plan.outlier_method, plan.outlier_iqr_multiplier, plan.quantile_accuracy)
    df = apply_outliers(df, ost, plan.soft_cleaning, flag="_out")
    null_expr = _sum([F.col(c).isNull().cast("bigint") for c in numeric])
    observations = None
    if observe:
        from pyspark.sql import Observation

        observations = {k: Observation(f"fieldspark_{k}") for k in ("pre", "post", "final")}
        df = df.observe(
            observations["pre"],
            F.count(F.lit(1)).alias("total_rows"),
            F.sum("_oob").alias("oob"),
            F.sum("_agro").alias("agro"),
            F.sum("_out").alias("out"),
            F.sum(null_expr).alias("nulls"),
        )
    pre_impute = df

    strategy = plan.missing_strategy
    if strategy == "time" and date_col not in df.columns:
        strategy = "median"
    fills: dict[str, float | None] = {}
    work = df.drop(*FLAGS)
    if strategy in ("mean", "median"):
        fills = fit_constants(work, numeric, strategy, plan.quantile_accuracy)
        work = apply_constants(work, fills)
    elif strategy == "ffill":
        work = impute_ffill(work, numeric, [rid])
    elif strategy == "drop":
        work = impute_drop(work, numeric)
    else:
        work = impute_time(work, numeric, date_col, plan.field_col, rid)
    if strategy in ("ffill", "time"):
        work = keep(work)
    if observe:
        work = work.observe(observations["post"], F.count(F.lit(1)).alias("rows"), F.sum(null_expr).alias("nulls"))
    imputed = work

    keys = [k for k in plan.dedup_keys if k in imputed.columns]
    out = dedup_keep_last(imputed, keys, rid)
    if plan.calculate_gdd:
        out = gdd(out, plan.t_base, "temp", date_col, plan.field_col, rid)
    if observe:
        out = out.observe(observations["final"], F.count(F.lit(1)).alias("rows"))

    pre = _long(
        pre_impute,
        {
            "total_rows": F.count(F.lit(1)),
            "out_of_bounds_removed": F.coalesce(F.sum("_oob"), F.lit(0)),
            "agronomic_outliers_removed": F.coalesce(F.sum("_agro"), F.lit(0)),
            "outliers_removed": F.coalesce(F.sum("_out"), F.lit(0)),
            "values_imputed": F.coalesce(F.sum(null_expr), F.lit(0)) if strategy != "drop" else F.lit(0),
            "duplicates_removed": F.lit(0),
        },
    )
    post = _long(
        imputed,
        {
            "values_imputed": -F.coalesce(F.sum(null_expr), F.lit(0)) if strategy != "drop" else F.lit(0),
            "duplicates_removed": F.count(F.lit(1)),
        },
    )
    final = _long(out, {"duplicates_removed": -F.count(F.lit(1))})
    diag = pre.unionByName(post).unionByName(final).groupBy("metric").agg(F.sum("value").cast("bigint").alias("value"))
    return CleanResult(out, diag, strategy, numeric, dropped, unit_report, ost, fills, imputed, observations, kept)
