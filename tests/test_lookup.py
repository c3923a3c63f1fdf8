"""Lookups in a table of one row a key: rows of a hot key stay where they are."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import features as FE
from fieldspark.operators import units as U
from fieldspark.operators.lookup import lookup

HOT = 1000


def _rows(spark):
    rows = [(i, "hot" if i < HOT else None if i % 7 == 0 else f"k{i % 40}", 60.0 + i % 3) for i in range(HOT + 300)]
    return spark.createDataFrame(rows, "id long, tag string, temp double").repartition(6)


@pytest.mark.parametrize("rows", [100, 10])
def test_lookup_equals_a_plain_join(spark, rows):
    df = _rows(spark)
    keys = [r["tag"] for r in df.select("tag").distinct().collect() if r["tag"] != "k3"]
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "_v string, code int")
    code = {k: i for i, k in enumerate(keys)}
    got = lookup(df, F.col("tag"), table, "_v", rows=rows)
    assert got.columns == ["id", "tag", "temp", "code"]
    assert sorted((r["id"], r["code"]) for r in got.collect()) == sorted((r["id"], code.get(r["tag"])) for r in df.collect())


def _no_row_moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_encoded_rows_stay_in_place(spark):
    """Codes of a column of few values come by broadcast: no task gets all rows of the hot value."""
    df = _rows(spark)
    for out in (FE.label_encode(df, ["tag"]), FE.onehot_sparse(df, ["tag"]), FE.feature_matrix(df, FE.FeatureSpec(["temp"], ["tag"]), "id")[0]):
        assert _no_row_moves(out.select("id", out.columns[-1]))
    assert {r["tag"]: r["tag_code"] for r in FE.label_encode(df, ["tag"]).collect()}["hot"] == 0


def test_range_heuristic_keeps_rows_in_place(spark):
    df = spark.createDataFrame([(1, "a", 68.0), (2, "a", 86.0), (3, None, 50.0), (4, "b", 20.0), (5, None, 122.0)], "id long, src string, temp double")
    out = U.range_heuristic_by_source(df, "temp", "src")
    assert _no_row_moves(out)
    assert sorted((r["id"], r["temp"]) for r in out.collect()) == [(1, 20.0), (2, 30.0), (3, 50.0), (4, 20.0), (5, 122.0)]
