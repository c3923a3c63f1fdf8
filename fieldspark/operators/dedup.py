"""De-duplication keeping the last row (by row id) per key, skew-proof."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_keep_last(df: DataFrame, keys: list[str], row_id: str = "rid") -> DataFrame:
    """Keep the row with the highest ``row_id`` per key; NULL keys compare equal.

    ``groupBy(keys).agg(max_by(row, row_id))`` has map-side partial aggregation (sorted, as a struct
    is no fixed-width buffer): a hot key shrinks to one row per map task before the shuffle, unlike
    a ``row_number`` window which sends the whole hot key to one task. With no usable key every
    column is the key (whole-row distinct).
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return dedup_all_columns(df, row_id)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.max_by(packed, F.col(row_id)).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_all_columns(df: DataFrame, row_id: str | None = "rid") -> DataFrame:
    """Whole-row duplicates (all columns but the row id) collapse to the last row."""
    if row_id and row_id in df.columns:
        keys = [c for c in df.columns if c != row_id]
        return df.groupBy(*keys).agg(F.max(row_id).alias(row_id)).select(*df.columns)
    return df.distinct()


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """``count(*) - count(distinct key)`` as a one-row table (NULL keys equal)."""
    keys = [k for k in keys if k in df.columns] or df.columns
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("duplicates"))
