"""The export bundle reads no more often than it must: de-duplicated, hashed and counted once."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import model as MO
from fieldspark.operators import split as SP
from fieldspark.plans import catalog as C


def test_bundle_deduplicates_once(spark, tmp_path):
    cols = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    rows = spark.range(60).selectExpr(
        "id", "id", "id % 40", "1", "double(id % 40)", "(id % 40) / 1000D", "(id % 40) / 2000D", "if(id % 2 = 0, 'A', 'R')", "timestamp_ntz'2024-01-01'"
    )
    spark.createDataFrame(rows.collect(), cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark._jsparkSession.sharedState().cacheManager().numCachedEntries()
    res, diag, b = C._bundle(spark, str(tmp_path))
    assert diag["total_rows"] == 60 and diag["duplicates_removed"] == 20
    assert b.manifest["split_info"]["counts"] == {"train": 28, "val": 8, "test": 4, "total": 40}
    assert "InMemoryRelation" in res.diagnostics._jdf.queryExecution().withCachedData().toString()
    assert spark._jsparkSession.sharedState().cacheManager().numCachedEntries() == before


def test_split_hashes_a_row_once(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("rid"))
    out = SP.split_exact(df, "rid")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert out.columns == ["rid", "split"]
    ranked = sorted((r["h"], r["rid"]) for r in df.select("rid", SP.split_hash("rid").alias("h")).collect())
    want = {rid: "train" if i < 700 else "val" if i < 900 else "test" for i, (_, rid) in enumerate(ranked)}
    assert {r["rid"]: r["split"] for r in out.collect()} == want


def test_split_counts_are_of_one_pass(spark):
    df = spark.createDataFrame([("train",), ("train",), ("val",), (None,)], "split string")
    out = SP.split_counts(df)
    assert {r["split"]: r["n"] for r in out.collect()} == {"train": 2, "val": 1, None: 1, "total": 4}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in SP.split_counts(df.where("false")).collect()] == [("total", 0)]


def test_correlations_with_given_means(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (4.0, 7.0), (None, 3.0)], "a double, b double")
    want = {(r[0], r[1]): r[2] for r in MO.correlation_matrix(df, ["a", "b"]).collect()}
    got = {(r[0], r[1]): r[2] for r in MO.correlation_matrix(df, ["a", "b"], {"a": 7 / 3, "b": 13 / 4}).collect()}
    assert got == pytest.approx(want)
