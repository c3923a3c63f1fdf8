"""Growing degree days: daily ``max(0, temp - t_base)`` and its running sum per field by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.ordered import ordered_scan


def gdd(
    df: DataFrame,
    t_base: float | None,
    temp_col: str = "temp",
    date_col: str = "date",
    field_col: str | None = "field_id",
    row_id: str = "rid",
) -> DataFrame:
    """A missing temperature contributes 0; a NULL field is its own group. No-op without t_base."""
    if t_base is None or temp_col not in df.columns or date_col not in df.columns:
        return df
    daily = F.greatest(F.lit(0.0), F.coalesce(F.col(temp_col) - F.lit(float(t_base)), F.lit(0.0)))
    out = df.withColumn("gdd_daily", daily)
    part = [field_col] if field_col and field_col in df.columns else []
    return ordered_scan(out, part, [date_col, row_id], [("gdd_accumulated", "sum", F.col("gdd_daily"))])
