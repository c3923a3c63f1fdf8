import random
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.operators.ordered import bucketize, ordered_scan
from fieldspark.operators.quantiles import quantiles


@contextmanager
def conf(spark, values):
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k in values:
            spark.conf.unset(k)


def _frame(spark, n=400, groups=3, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.6 else f"g{rnd.randrange(groups)}"  # one key holds most rows
        v = None if rnd.random() < 0.3 else float(rnd.randrange(100))
        rows.append((i, g, rnd.randrange(50), v))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "rid long, g string, t long, v double").repartition(5)


def test_scan_matches_pandas(spark):
    rows, df = _frame(spark)
    out = ordered_scan(
        df,
        ["g"],
        ["t", "rid"],
        [("last", "last", F.col("v")), ("first", "first", F.col("v")), ("run", "sum", F.col("v")), ("pos", "pos", None)],
        n_buckets=7,
    ).toPandas()
    pdf = pd.DataFrame(rows, columns=["rid", "g", "t", "v"]).sort_values(["g", "t", "rid"])
    pdf["last_e"] = pdf.groupby("g")["v"].ffill()
    pdf["first_e"] = pdf.groupby("g")["v"].bfill()
    pdf["run_e"] = pdf.groupby("g")["v"].transform(lambda s: s.fillna(0).cumsum())
    pdf["pos_e"] = pdf.groupby("g").cumcount() + 1
    m = pdf.merge(out, on="rid")
    for a, b in [("last", "last_e"), ("first", "first_e"), ("pos", "pos_e")]:
        assert ((m[a] == m[b]) | (m[a].isna() & m[b].isna())).all(), a
    ok = m["run"].isna() | np.isclose(m["run"].astype(float), m["run_e"].astype(float))
    assert ok.all()


def test_global_scan_without_groups(spark):
    rows, df = _frame(spark, seed=2)
    out = ordered_scan(df, [], ["rid"], [("pos", "pos", None)], n_buckets=6).toPandas()
    assert sorted(out["pos"].tolist()) == list(range(1, len(rows) + 1))
    assert (out.sort_values("rid")["pos"].diff().dropna() == 1).all()


@pytest.mark.parametrize("fan, rows, parts", [(2, 1, 3), (3, 7, 5), (2, 0, 40), (1024, 1, 4)])
def test_tree_of_carries(spark, fan, rows, parts):
    """Many levels of carries give what one window a group gives, with null keys and order values too."""
    rnd = random.Random(fan + rows)
    data = [(i, rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *range(30)]), rnd.choice([None, None, rnd.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(data, "rid long, g string, t long, v long").repartition(4)
    specs = [("last", "last", F.col("v")), ("first", "first", F.col("v")), ("run", "sum", F.col("v")), ("pos", "pos", None), ("lp", "last_pos", F.col("v").isNotNull())]
    for part in (["g"], []):
        with conf(spark, {"fieldspark.scan.fan": fan, "fieldspark.scan.bucketRows": rows}):
            got = ordered_scan(df, part, ["t", "rid"], specs, n_buckets=parts)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            got = sorted(map(tuple, got.select("rid", "last", "first", "run", "pos", "lp").collect()))
        w = Window.partitionBy(*part).orderBy(F.col("t").asc_nulls_last(), "rid")
        up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        n = F.row_number().over(w)
        want = df.withColumn("n", n).select("rid", F.last("v", True).over(up), F.first("v", True).over(down), F.sum("v").over(up), "n", F.last(F.when(F.col("v").isNotNull(), F.col("n")), True).over(up))
        assert got == sorted(map(tuple, want.collect()))
        assert all("], [" in line for line in plan.splitlines() if "Window [" in line)  # partitioned and ordered


def test_fills_with_a_bucket_a_row(spark):
    from fieldspark.plans.catalog import ORACLE, QUERIES
    from fieldspark.plans.compare import compare, duckdb_connect

    con = duckdb_connect("/root/testdata/sf0.001")
    with conf(spark, {"fieldspark.scan.fan": 16, "fieldspark.scan.bucketRows": 1}):
        for name in ("impute_time", "impute_ffill", "gdd", "impute_categorical"):
            assert compare(QUERIES[name](spark, "/root/testdata/sf0.001"), con, ORACLE[name])["match"], name


def test_partitions_follow_bytes(spark):
    df = spark.range(20_000).select("id", F.repeat(F.lit("x"), 100).alias("s"))
    with conf(spark, {"fieldspark.scan.partitionBytes": 1 << 18}):
        assert 7 <= bucketize(df, [], ["id"]).rdd.getNumPartitions() <= 9
    assert bucketize(df, [], ["id"]).rdd.getNumPartitions() == 1


def _np_quant(vals, p):
    return float(np.quantile(np.array(vals, dtype=float), p))


def test_exact_quantiles_with_iterations(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.0]) * 10 ** rnd.randrange(-3, 9) for _ in range(3000)] + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = quantiles(df, {"x": F.col("x")}, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], buckets=8)["x"]
    exp = [_np_quant(vals, p) for p in [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]]
    assert np.allclose(got, exp, rtol=1e-12, atol=0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], buckets=4)["x"]
    present = [v for v in values if v is not None]
    if not present:
        assert got == [None, None, None]
    else:
        exp = [_np_quant(present, p) for p in [0.25, 0.5, 0.75]]
        assert np.allclose(got, exp, rtol=1e-9, atol=1e-9)


def test_approx_switch_close_to_exact(spark):
    df = spark.range(0, 20001).selectExpr("cast(id as double) as x")
    exact = quantiles(df, {"x": F.col("x")}, [0.25, 0.5])["x"]
    approx = quantiles(df, {"x": F.col("x")}, [0.25, 0.5], accuracy=1000)["x"]
    assert exact == [5000.0, 10000.0]
    assert all(abs(a - e) <= 20001 / 1000 for a, e in zip(approx, exact))
