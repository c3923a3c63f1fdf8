"""Ridge regression on sparse rows, by conjugate gradients.

Rows are lists of slots and values (a one-hot encoded row has a 1 in one slot a column), and stay that
way: the centred matrix is never built. A pass over all rows multiplies it by a vector: each task
adds up its own rows, sums by slot meet in one aggregate. The driver holds vectors of a number a slot,
up to MOST_SLOTS; more slots raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.model import MIN_TRAIN_ROWS, RIDGE_ALPHA
from fieldspark.session import cut_lineage

MOST_SLOTS = 1 << 22  # 32 MB a vector
TOLERANCE = 1e-12
MOST_STEPS = 500


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the entries of a batch, and y."""
    slots = b.column(0)
    size = slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(b.num_rows), size), slots.flatten().to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).to_numpy(zero_copy_only=False)


def _sums(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    """slot and sums of a task, for the slots that it has met."""
    some = np.flatnonzero(np.any([v != 0 for v in total.values()], axis=0))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(v[some]) for v in total.values()]], names=["slot", *total])


def _collected(df: DataFrame, names: list[str], size: int) -> list[np.ndarray]:
    """The sums by slot as vectors."""
    out = [np.zeros(size) for _ in names]
    for r in df.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toLocalIterator():
        for v, n in zip(out, names):
            v[r["slot"]] = r[n]
    return out


def ridge_sparse(df: DataFrame, size: int, slots: str = "slots", values: str | None = None, y: str = "y", alpha: float = RIDGE_ALPHA):
    """(n, weights, intercept, steps) of the ridge fit with an unpenalised intercept, None for fewer than
    five rows. ``slots`` are positions below ``size`` (each at most once a row), ``values`` their values
    (1 if not given). Rows with a null ``y`` are left out; null lists have no entries."""
    if size > MOST_SLOTS:
        raise ValueError(f"{size} slots; at most {MOST_SLOTS} are fitted")
    lists = F.coalesce(F.col(slots).cast("array<int>"), F.array().cast("array<int>"))
    numbers = F.transform(lists, lambda _: F.lit(1.0)) if values is None else F.coalesce(F.col(values).cast("array<double>"), F.array().cast("array<double>"))
    rows = cut_lineage(df.where(F.col(y).isNotNull()).select(lists.alias("slots"), numbers.alias("values"), F.col(y).cast("double").alias("y")))
    n, mean_y = rows.agg(F.count(F.lit(1)), F.avg("y")).first()
    if n < MIN_TRAIN_ROWS:
        return None

    def first(batches):
        total = {k: np.zeros(size) for k in ("s", "sy", "ss")}
        for b in batches:
            row, slot, value, target = _entries(b)
            for k, x in (("s", value), ("sy", value * (target - mean_y)[row]), ("ss", value * value)):
                total[k] += np.bincount(slot, x, size)
        yield _sums(total)

    s, rhs, squares = _collected(rows.mapInArrow(first, "slot int, s double, sy double, ss double"), ["s", "sy", "ss"], size)
    mean = s / n
    diagonal = np.maximum(squares - n * mean * mean, 0) + alpha

    def times(v: np.ndarray) -> np.ndarray:
        """(centred X' X + alpha) v: the centring is taken off each row's product, and off the result."""
        sent = rows.sparkSession.sparkContext.broadcast(v)
        shift = float(mean @ v)

        def run(batches):
            total, rest = np.zeros(size), 0.0
            for b in batches:
                row, slot, value, target = _entries(b)
                u = np.bincount(row, value * sent.value[slot], len(target)) - shift
                total += np.bincount(slot, value * u[row], size)
                rest += u.sum()
            yield _sums({"p": np.append(total, rest)})

        (p,) = _collected(rows.mapInArrow(run, "slot int, p double"), ["p"], size + 1)
        sent.destroy()
        return p[:-1] - mean * p[-1] + alpha * v

    w, steps = np.zeros(size), 0
    r = rhs.copy()
    z = r / diagonal
    d, rz = z.copy(), float(r @ z)
    limit = TOLERANCE * max(float(np.sqrt(rhs @ rhs)), 1e-300)
    while np.sqrt(r @ r) > limit and steps < MOST_STEPS:
        q = times(d)
        a = rz / float(d @ q)
        w, r = w + a * d, r - a * q
        z = r / diagonal
        rz, before = float(r @ z), rz
        d, steps = z + rz / before * d, steps + 1
    return n, w, mean_y - float(mean @ w), steps


def ridge_weights(df: DataFrame, categories: DataFrame, slots: str = "slots", y: str = "y", alpha: float = RIDGE_ALPHA) -> DataFrame:
    """column, value, weight of every row of ``categories`` (column, value, slot), and a row without
    column for the intercept."""
    spark = df.sparkSession
    size = (categories.agg(F.max("slot")).first()[0] or 0) + 1
    fit = ridge_sparse(df, size, slots, None, y, alpha)
    if fit is None:
        return spark.createDataFrame([], "column string, value string, weight double")
    _, w, b, _ = fit
    table = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(size), pa.int32()), "weight": pa.array(w)}))
    rows = categories.join(table, "slot").select("column", "value", "weight")
    return rows.unionByName(spark.createDataFrame([(None, None, float(b))], "column string, value string, weight double"))
