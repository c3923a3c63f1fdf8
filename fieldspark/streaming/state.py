"""Fitted statistics that merge: a small state table a batch instead of a pass over all batches.

A state has a row for each column: count, mean and sum of squared differences from the mean (they merge
by the pairwise update formulas), least and greatest value, and a KLL quantile sketch. ``merge_states``
takes the states of any number of batches, in any order. Outlier limits come from the merged state of
the values after bounds and rules (``raw_state``); fill values from that of the values which these
limits leave (``kept_state``), so a batch is read twice and never together with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.rules import MIN_OUTLIER_VALUES, OutlierStats, agronomic_rules, apply_outliers, init_confidence, physical_bounds
from fieldspark.plans.clean import coerce
from fieldspark.plans.config import CleanPlan
from fieldspark.streaming.incremental import FrozenClean

SKETCH_K = 4096  # a quantile's rank is off by less than 0.001 of the values


def state(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, n, mean, m2, lo, hi, sketch over the non-null cells of ``cols``."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])
    rows = df.select(F.explode(each).alias("r")).select("r.*").where("v is not null")
    moments = [F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count(F.lit(1))).alias("m2"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    return rows.groupBy("column").agg(*moments, F.kll_sketch_agg_double("v", SKETCH_K).alias("sketch"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of all rows of the states."""
    every = reduce(DataFrame.unionByName, states)
    n = F.sum("n").alias("n")
    mean = every.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
    apart = F.col("mean") - F.col("all")
    merged = every.join(mean, "column").groupBy("column", "all").agg(
        n, F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch")
    )
    return merged.select("column", "n", F.col("all").alias("mean"), "m2", "lo", "hi", "sketch")


def quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))


def outliers_of(merged: DataFrame, plan: CleanPlan) -> OutlierStats:
    """Limits from a merged state; columns with few values or no spread have none."""
    if plan.outlier_method == "none":
        return OutlierStats("none", {}, {})
    rows = merged.where(F.col("n") >= MIN_OUTLIER_VALUES)
    if plan.outlier_method == "zscore":
        std = F.sqrt(F.col("m2") / (F.col("n") - 1))
        found = rows.select("column", "mean", std.alias("std")).where("std > 0").collect()  # a row a column
        return OutlierStats("zscore", {}, {r["column"]: (r["mean"], r["std"]) for r in found})
    found = rows.select("column", quantile(0.25).alias("q1"), quantile(0.75).alias("q3")).collect()
    k = plan.outlier_iqr_multiplier
    return OutlierStats("iqr", {r["column"]: (r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"])) for r in found}, {})


def _ruled(df: DataFrame, plan: CleanPlan, numeric: list[str]) -> DataFrame:
    out = coerce(init_confidence(df, plan.soft_cleaning), list(plan.date_columns), numeric)
    out = physical_bounds(out, plan.physical_bounds)
    return agronomic_rules(out, plan.max_yield, list(plan.harvest_months), plan.soft_cleaning, plan.date_col, "yield")


def raw_state(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """State of a batch after bounds and rules."""
    cols = list(plan.numeric_columns)
    return state(_ruled(df, plan, cols), cols)


def kept_state(df: DataFrame, plan: CleanPlan, outliers: OutlierStats) -> DataFrame:
    """State of a batch without the cells that the outlier limits empty."""
    cols = list(plan.numeric_columns)
    return state(apply_outliers(_ruled(df, plan, cols), outliers, plan.soft_cleaning), cols)


def freeze_merged(merged: DataFrame, plan: CleanPlan, outliers: OutlierStats) -> FrozenClean:
    """The frozen clean of all batches: ``merged`` is the merged state of their kept values."""
    if plan.missing_strategy not in ("mean", "median"):
        raise ValueError("only constant fills (mean/median) can be merged")
    value = F.col("mean") if plan.missing_strategy == "mean" else quantile(0.5)
    fills = {r["column"]: r["v"] for r in merged.select("column", value.alias("v")).collect()}
    return FrozenClean(plan, tuple(plan.numeric_columns), outliers, {c: fills.get(c) for c in plan.numeric_columns})
