"""Properties from the test plan: idempotence, observed cells untouched, partition independence."""

import random

from pyspark.sql import functions as F

from fieldspark.operators import dedup as D
from fieldspark.operators import impute as I
from fieldspark.operators import rules as R
from fieldspark.operators import split as SP
from fieldspark.plans.catalog import OBS_PLAN
from fieldspark.plans.clean import clean
from fieldspark.plans.views import obs


def _rows(seed=7, n=300):
    rnd = random.Random(seed)
    import datetime as dt

    return [
        (i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(500)), f"F{rnd.randrange(4)}", None if rnd.random() < 0.25 else rnd.uniform(-50, 90))
        for i in range(n)
    ]


SCHEMA = "rid long, date timestamp_ntz, field_id string, temp double"


def test_bounds_and_dedup_idempotent(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    once = R.physical_bounds(df, {"temp": (-30.0, 60.0)})
    twice = R.physical_bounds(once, {"temp": (-30.0, 60.0)})
    assert sorted(once.collect()) == sorted(twice.collect())
    d1 = D.dedup_keep_last(df, ["field_id"])
    assert sorted(d1.collect()) == sorted(D.dedup_keep_last(d1, ["field_id"]).collect())


def test_imputation_keeps_observed_cells(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    observed = {r["rid"]: r["temp"] for r in df.collect() if r["temp"] is not None}
    for out in (
        I.impute_time(df, ["temp"]),
        I.impute_constant(df, ["temp"], "median"),
        I.impute_ffill(df, ["temp"], ["rid"]),
    ):
        got = {r["rid"]: r["temp"] for r in out.collect()}
        assert all(got[k] == v for k, v in observed.items())
        assert all(v is not None for v in got.values())


def test_results_independent_of_partitioning(spark):
    rows = _rows(11)
    a = spark.createDataFrame(rows, SCHEMA).repartition(1)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    b = spark.createDataFrame(shuffled, SCHEMA).repartition(7)
    for f in (
        lambda d: I.impute_time(d, ["temp"]),
        lambda d: I.impute_ffill(d, ["temp"], ["rid"]),
        lambda d: SP.split_exact(d, "rid", (0.6, 0.3, 0.1)),
    ):
        assert sorted(f(a).collect()) == sorted(f(b).collect())


def test_split_is_an_exact_partition(spark):
    df = spark.range(1234).withColumnRenamed("id", "rid")
    s = SP.split_exact(df, "rid", (0.8, 0.1, 0.1))
    assert s.count() == 1234 and s.select("rid").distinct().count() == 1234
    counts = {r["split"]: r["n"] for r in SP.split_counts(s).collect()}
    assert (counts["train"], counts["val"], counts["test"]) == SP.split_sizes(1234, (0.8, 0.1, 0.1))


def test_clean_on_driver_table_invariants(spark, sf001):
    res = clean(obs(spark, sf001), OBS_PLAN)
    out = res.df
    assert out.where(F.col("temp").isNull() | F.col("humidity").isNull()).count() == 0
    assert out.where((F.col("temp") < -30) | (F.col("temp") > 60)).count() == 0
    assert out.groupBy("field_id", "day").count().where("count > 1").count() == 0
    diag = {r["metric"]: r["value"] for r in res.diagnostics.collect()}
    assert diag["total_rows"] - diag["duplicates_removed"] == out.count()


def test_observed_diagnostics_equal_lazy_ones(spark, sf001):
    res = clean(obs(spark, sf001), OBS_PLAN, observe=True)
    res.df.write.format("noop").mode("overwrite").save()
    lazy = {r["metric"]: r["value"] for r in res.diagnostics.collect()}
    assert res.observed() == lazy
