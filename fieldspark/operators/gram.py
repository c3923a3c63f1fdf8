"""Correlations of wide tables: the cross-product matrix by blocks of columns.

A task adds up the products of its own rows for every pair of column blocks; the partial blocks are
summed in a tree, ``FAN`` of them at a time, and end as a table of cells. Neither an expression for each
pair of columns nor the matrix itself is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage

BLOCK = 128  # columns of a block
FAN = 32  # partial blocks that one call adds up
ROWS = 4096  # rows that a task multiplies at a time


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, without rows that hold a null or not finite value; the one column of the batch
    holds arrays of one length."""
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    m = flat.reshape(batch.num_rows, -1)
    return m[np.isfinite(m).all(axis=1)]


def column_means(rows: DataFrame) -> DataFrame:
    """i, n, mean of the places of ``rows`` (x: arrays of one length): sums a task, then a place."""

    def run(batches):
        n, total = 0, None
        for b in batches:
            if b.num_rows and len(m := _matrix(b)):
                n, total = n + len(m), m.sum(axis=0) if total is None else total + m.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)], names=["i", "n", "s"])

    sums = rows.select("x").mapInArrow(run, "i int, n long, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.select("i", "n", (F.col("s") / F.col("n")).alias("mean"))


def cross_products(rows: DataFrame, centre: list[float], block: int = BLOCK) -> DataFrame:
    """i, j (i <= j), s: sums of the products of centred places i and j."""
    mean = np.array(centre)
    starts = list(range(0, len(mean), block))
    pairs = [(a, b) for a in range(len(starts)) for b in range(a, len(starts))]

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            m = _matrix(b) - mean if b.num_rows else np.zeros((0, len(mean)))
            for at in range(0, len(m), ROWS):
                part = [m[at : at + ROWS, s : s + block] for s in starts]
                for p in pairs:
                    product = part[p[0]].T @ part[p[1]]
                    total[p] = total[p] + product if p in total else product
        for (a, b), s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], names=["a", "b", "s"])

    def add(t: pa.Table) -> pa.Table:
        s = np.sum([x.values.to_numpy() for x in t.column("s")], axis=0)
        return pa.table({"a": t.column("a").slice(0, 1), "b": t.column("b").slice(0, 1), "s": pa.array([s], pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(run, "a int, b int, s array<double>").withColumn("k", F.spark_partition_id())
    parts = cut_lineage(parts)
    most = rows.rdd.getNumPartitions()
    while most > 1:  # a level of the tree; its number of parts is known from the partitions
        parts = parts.withColumn("k", F.floor(F.col("k") / FAN).cast("int"))
        parts = parts.groupBy("a", "b", "k").applyInArrow(lambda key, t: add(t).append_column("k", pa.array([key[2].as_py()], pa.int32())), "a int, b int, s array<double>, k int")
        most = -(-most // FAN)
    width = F.least(F.lit(block), F.lit(len(mean)) - F.col("b") * block)
    cells = parts.select("a", "b", width.alias("w"), F.posexplode("s").alias("at", "s"))
    cells = cells.select((F.col("a") * block + F.floor(F.col("at") / F.col("w"))).cast("int").alias("i"), (F.col("b") * block + F.col("at") % F.col("w")).cast("int").alias("j"), "s")
    return cells.where("i <= j")


def correlation_table(df: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """feature_i, feature_j, corr of every two of ``cols``, both ways, as a table. Rows with a null or not
    finite value in any of them are left out; a constant column has null correlations."""
    each = [F.col(f"`{c}`").cast("double") for c in cols]
    rows = df.select(F.array(*each).alias("x"))
    means = {r["i"]: r["mean"] for r in column_means(rows).collect()}  # a number a column
    if not means:
        return df.sparkSession.createDataFrame([(a, b, None) for a in cols for b in cols], "feature_i string, feature_j string, corr double")
    cells = cut_lineage(cross_products(rows, [means[i] for i in range(len(cols))], block))
    own = cells.where("i = j")
    full = cells.join(own.select("i", F.col("s").alias("si")), "i").join(own.select("j", F.col("s").alias("sj")), "j")
    corr = F.try_divide(F.col("s"), F.sqrt(F.col("si") * F.col("sj")))
    full = full.select("i", "j", F.when((F.col("si") > 0) & (F.col("sj") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))).alias("corr"))
    names = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, name string"))  # a row a column
    both = full.unionByName(full.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    both = both.join(names.withColumnRenamed("name", "feature_i"), "i").join(names.select(F.col("i").alias("j"), F.col("name").alias("feature_j")), "j")
    return both.select("feature_i", "feature_j", "corr")
