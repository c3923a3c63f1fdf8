"""Incremental cleaning of a file stream with frozen statistics (Structured Streaming).

A batch ``clean`` fits its statistics (outlier thresholds, fill constants) on a reference table;
``freeze`` keeps them, and ``apply_frozen`` re-applies only the row-local steps (coercion, bounds,
agronomic rules, outliers with frozen thresholds, constant fills) - valid on a stream because no
step needs the whole table. De-duplication on a stream uses a watermark on the date so the state
per key is bounded (``dropDuplicatesWithinWatermark`` keeps the first arrival; a keep-last
rewrite needs the batch ``dedup_keep_last`` downstream).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldspark.operators.impute import apply_constants
from fieldspark.operators.rules import OutlierStats, agronomic_rules, apply_outliers, init_confidence, physical_bounds
from fieldspark.plans.clean import CleanResult, coerce
from fieldspark.plans.config import CleanPlan


@dataclass(frozen=True)
class FrozenClean:
    plan: CleanPlan
    numeric: tuple[str, ...]
    outliers: OutlierStats
    fills: dict[str, float | None]


def freeze(result: CleanResult, plan: CleanPlan) -> FrozenClean:
    if result.strategy_used not in ("mean", "median"):
        raise ValueError("only constant fills (mean/median) can be frozen for a stream")
    return FrozenClean(plan, tuple(result.numeric_columns), result.outlier_stats, dict(result.fill_values))


def apply_frozen(df: DataFrame, fz: FrozenClean) -> DataFrame:
    """Row-local part of the clean with the frozen statistics (works on batch and stream frames)."""
    p = fz.plan
    out = init_confidence(df, p.soft_cleaning)
    out = coerce(out, list(p.date_columns), list(fz.numeric))
    out = physical_bounds(out, p.physical_bounds)
    out = agronomic_rules(out, p.max_yield, list(p.harvest_months), p.soft_cleaning, p.date_col, "yield")
    out = apply_outliers(out, fz.outliers, p.soft_cleaning)
    return apply_constants(out, fz.fills)


def start_stream(
    spark: SparkSession,
    source_dir: str,
    schema,
    fz: FrozenClean,
    sink_dir: str,
    checkpoint_dir: str,
    source_format: str = "parquet",
    watermark: str | None = "1 day",
    available_now: bool = True,
):
    """readStream (files) -> apply_frozen -> [dedup within watermark] -> parquet sink."""
    stream = spark.readStream.format(source_format).schema(schema).load(source_dir)
    out = apply_frozen(stream, fz)
    keys = [k for k in fz.plan.dedup_keys if k in out.columns]
    if watermark and keys and fz.plan.date_col in out.columns:
        out = out.withWatermark(fz.plan.date_col, watermark).dropDuplicatesWithinWatermark(keys)
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
