"""What comes to the driver or grows with repeated jobs is bounded."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import features as FE
from fieldspark.operators.profile import describe
from fieldspark.plans import export as EX


def test_wide_one_hot_has_a_limit(spark):
    df = spark.range(3 * FE.WIDE_CATEGORIES).select("id", F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="onehot_sparse"):
        FE.onehot_categories(df, "c")
    assert FE.onehot_categories(df.where("id < 12"), "c") == sorted(str(i) for i in range(12))


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run in ("a", "a", "b", "a"):
        EX.log_run(spark, path, {"x": 1}, {"rows": 2}, (0.7, 0.2, 0.1), {"mse": 0.5}, run_id=run)
    rows = spark.read.parquet(path)
    assert {r["run_id"]: r["count"] for r in rows.groupBy("run_id").count().collect()} == {"a": 6, "b": 6}


def test_many_correlations_are_a_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(EX, "MANIFEST_FEATURES", 2)
    df = spark.range(60).select(F.col("id").cast("string").alias("rid"), *[((F.col("id") * k) % 7).cast("double").alias(f"x{k}") for k in (1, 2, 3)], (F.col("id") % 5).cast("double").alias("y"))
    spec = FE.FeatureSpec(["x1", "x2", "x3"], [], "y")
    b = EX.export_bundle(df, spec, str(tmp_path))
    table = spark.read.parquet(b.manifest["correlations"]["table"])
    assert table.count() == 9 and table.where("feature_i = feature_j").agg(F.min("corr")).first()[0] == pytest.approx(1)


def test_describe_of_text_columns(spark):
    rows = [("b", None, 1), ("a", None, 2), ("b", None, 3), ("a", None, 4), (None, None, 5)]
    got = {r["column"]: r for r in describe(spark.createDataFrame(rows, "t string, e string, n int")).collect()}
    assert (got["t"]["count"], got["t"]["unique"], got["t"]["top"], got["t"]["freq"]) == (4, 2, "a", 2)
    assert (got["e"]["count"], got["e"]["unique"], got["e"]["top"], got["e"]["freq"]) == (0, 0, None, None)
    assert (got["n"]["count"], got["n"]["p50"]) == (5, 3.0)


def test_a_clean_releases_what_it_kept(spark):
    import datetime as dt

    from fieldspark.plans.clean import clean
    from fieldspark.plans.config import CleanPlan

    rows = [(i, dt.datetime(2024, 1, 1 + i % 28), f"F{i % 3}", "wheat" if i % 4 else None, float(i % 17) if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "rid long, date timestamp_ntz, field_id string, crop string, temp double")
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    res = clean(df, CleanPlan(numeric_columns=("temp",), categorical_columns=("crop",), date_columns=("date",), dedup_keys=("rid",), missing_strategy="time"))
    assert res.df.count() == 80 and res.df.where("temp is null or crop is null").isEmpty()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    res.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before and res.df.count() == 80
