"""Left join with a table of one row a key, for rows of which a few keys may hold most.

A join by shuffle sends all rows of one key to one task. Tables up to LOOKUP_ROWS and LOOKUP_BYTES are
broadcast, so no row moves. Of a larger one only the rows of the most frequent keys are broadcast; rows
with another key, at most a small share of all for each, move to the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage

LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 16 << 20  # a table up to both is broadcast
FREQUENT = 256  # keys that are looked up by broadcast at most
TRACKED = 8192  # keys that the summary of frequent keys counts at a time


def frequent_values(df: DataFrame, value: Column, most: int = FREQUENT) -> DataFrame:
    """(value): at most ``most`` of the most frequent values of ``df``, from one pass with Spark's mergeable
    summary. Any value on more than 2 / TRACKED of all rows is among the first it keeps."""
    top = df.select(value.alias("value")).agg(F.expr(f"approx_top_k(value, {most}, {TRACKED})").alias("t"))
    return top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("value"))


def small(table: DataFrame, rows: int = LOOKUP_ROWS, size: int = LOOKUP_BYTES) -> bool:
    n, b = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*table.columns))).cast("long"))).first()
    return n <= rows and (b or 0) <= size


def few(table: DataFrame) -> DataFrame:
    """``table``, which should be a checkpointed one, marked for broadcast if it is small."""
    return F.broadcast(table) if small(table) else table


def lookup(df: DataFrame, value: Column, table: DataFrame, key: str, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` with the columns of ``table`` (``key``, others) of the row whose ``key`` is ``value``, nulls
    being equal; null where there is none. ``key`` must be unique; it is left out, and its columns must
    not be those of ``df``."""
    table = cut_lineage(table)
    same = value.eqNullSafe(F.col(key))
    if small(table, rows):
        return df.join(F.broadcast(table), same, "left").drop(key)
    often = cut_lineage(frequent_values(df, F.xxhash64(value)).toDF("_often"))
    marked = df.join(F.broadcast(often), F.xxhash64(value) == F.col("_often"), "left")
    first = F.broadcast(table.join(F.broadcast(often), F.xxhash64(key) == F.col("_often"), "left_semi"))
    held = marked.where("_often is not null").drop("_often").join(first, same, "left")
    rest = marked.where("_often is null").drop("_often").join(table, same, "left")
    return held.unionByName(rest).drop(key)
