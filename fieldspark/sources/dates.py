"""Order of day and month, found for each file and column by elimination.

A cell such as ``13/02/2024`` can't have the month first, ``02/13/2024`` can't have the day first; one
cell is enough to vote an order out for its whole column. Votes are counts, aggregated within tasks
before anything moves. Columns in which no cell decides stay ambiguous: they are read with the day
first and reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.columns import normalise_date, once

TWO_NUMBERS = r"^\s*(\d{1,2})([/.-])(\d{1,2})([/.-]\d{4}.*)$"


def _numbers(cell: Column) -> tuple[Column, Column]:
    """The first two numbers of a cell that begins as a date of day and month; null for other cells."""
    return tuple(F.regexp_extract(cell, TWO_NUMBERS, k).try_cast("int") for k in (1, 3))


def date_orders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cells (of two numbers and a year), not_day_first, not_month_first (cells that contradict an
    order), date_order: ``day``, ``month``, ``ambiguous`` (no cell decides) or ``mixed`` (cells decide
    both ways) of ``cells`` (keys, cell). Cells that contradict both orders are no dates and don't
    vote; a group without such cells has no row."""
    a, b = _numbers(F.col("cell"))
    rows = cells.select(*keys, a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    real = (F.least("a", "b") >= 1) & (F.least("a", "b") <= 12) & (F.greatest("a", "b") <= 31)
    found = rows.where(real).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("b") > 12).alias("not_day_first"), F.count_if(F.col("a") > 12).alias("not_month_first"))
    day, month = F.col("not_day_first") == 0, F.col("not_month_first") == 0
    return found.withColumn("date_order", F.when(day & month, "ambiguous").when(day, "day").when(month, "month").otherwise("mixed"))


def parse_ordered(cell: Column, order: Column) -> Column:
    """``normalise_date`` of a cell in a column of the given order: ``month`` swaps the first two numbers, all
    others (null too) keep the day first."""
    swapped = F.regexp_replace(cell, TWO_NUMBERS, "$3$2$1$4")
    return once(F.when(order == "month", swapped).otherwise(cell), normalise_date)
