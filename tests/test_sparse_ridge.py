"""Sparse ridge against the direct solve; boundaries of hashes against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import split as SP
from fieldspark.operators.model import ridge_fit
from fieldspark.operators.sparse import MOST_SLOTS, ridge_sparse


def test_equals_the_direct_solve(spark):
    g = np.random.default_rng(3)
    x = np.where(g.random((300, 6)) < 0.5, g.normal(2, 3, (300, 6)), 0)
    y = x @ g.normal(0, 1, 6) + 50 + g.normal(0, 1, 300)
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], float(t), *map(float, r)) for r, t in zip(x, y)]
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "slots array<int>, vals array<double>, y double, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    n, w, b, steps = ridge_sparse(df, 6, values="vals", alpha=2.0)
    _, want, b0 = ridge_fit(df, cols, "y", 2.0)
    assert n == 300 and np.abs(w - want).max() < 1e-8 and abs(b - b0) < 1e-8 and steps <= 12


def test_a_hundred_thousand_slots(spark):
    n = 100_000
    df = spark.range(200_000).select(F.array((F.col("id") % n).cast("int")).alias("slots"), (F.col("id") % n % 10).cast("double").alias("y"))
    rows, w, b, steps = ridge_sparse(df, n)
    assert rows == 200_000 and steps < 20 and b == pytest.approx(4.5, abs=1e-6)
    assert np.abs(w - 2 * (np.arange(n) % 10 - 4.5) / 3).max() < 1e-6


def test_edges(spark):
    df = spark.createDataFrame([([0], 1.0), (None, 2.0), ([], 3.0), ([1], 4.0), ([0], 5.0), ([0], None)], "slots array<int>, y double")
    n, w, b, _ = ridge_sparse(df, 3)
    assert n == 5 and w[2] == 0 and np.isfinite(w).all()
    assert ridge_sparse(df.limit(3), 3) is None
    with pytest.raises(ValueError):
        ridge_sparse(df, MOST_SLOTS + 1)


@pytest.mark.parametrize("few", [1, 50, 100_000])
def test_boundaries_by_counting(spark, monkeypatch, few):
    monkeypatch.setattr(SP, "FEW", few)
    df = spark.range(3000).select((F.col("id") % 2500).alias("id")).repartition(5)
    texts = sorted(r["h"] for r in df.select(SP.split_hash("id").alias("h")).collect())
    places = [0, 1, 2, 777, 2999, 3000]
    n, got = SP.hash_boundaries(df, SP.split_hash("id"), lambda n: places)
    assert n == 3000 and got == ["", *[texts[p - 1] for p in places[1:]]]
    assert SP.hash_boundaries(df.where("false"), SP.split_hash("id"), lambda n: [n]) == (0, [""])
    same = spark.range(500).select(F.lit(1).alias("id"))
    assert SP.hash_boundaries(same, SP.split_hash("id"), lambda n: [3])[1] == [same.select(SP.split_hash("id").alias("h")).first()["h"]]
