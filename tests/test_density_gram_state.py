"""Density curves, blocked correlations and merging statistics against numpy and the plain clean."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators.density import density, density_before_after
from fieldspark.operators.gram import column_means, correlation_table, cross_products
from fieldspark.plans.clean import clean
from fieldspark.plans.config import CleanPlan
from fieldspark.streaming.incremental import apply_frozen
from fieldspark.streaming.state import freeze_merged, kept_state, merge_states, outliers_of, raw_state, state


def test_density_is_the_kernel_estimate(spark):
    g = np.random.default_rng(1)
    v = np.concatenate([g.normal(0, 1, 400), g.normal(6, 0.5, 200)])
    rows = [("a", "x", float(x)) for x in v] + [("a", "x", None), ("a", "same", 3.0), ("a", "same", 3.0), ("b", "x", 1.0), ("a", "empty", None)]
    out = density(spark.createDataFrame(rows, "state string, column string, v double").repartition(4)).orderBy("point").collect()
    assert {(r["state"], r["column"]) for r in out} == {("a", "x")} and [r["point"] for r in out] == list(range(200))
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
    exact = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    got = np.array([r["density"] for r in out])
    assert np.allclose([r["x"] for r in out], x) and np.abs(got - exact).max() < 0.002 * exact.max()
    assert abs(got.sum() * (x[1] - x[0]) - 1) < 0.01
    frame = spark.createDataFrame([(float(x), 1.0) for x in v], "p double, q double")
    assert density_before_after(frame, frame.where("p > 3"), ["p", "q"], 50).groupBy("state").count().count() == 2


@pytest.mark.parametrize("d, block, parts", [(1, 4, 2), (7, 3, 40), (8, 4, 3), (30, 128, 5)])
def test_blocks_are_numpy_correlations(spark, d, block, parts):
    g = np.random.default_rng(d)
    x = g.normal(1e6, 1, (200, d)) @ g.normal(0, 1, (d, d))
    x[:, 0] = 5.0  # constant
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(parts)
    bad = spark.createDataFrame([(float("nan"),) * d, (None,) * d, (float("inf"),) * d], df.schema)
    got = {(r["feature_i"], r["feature_j"]): r["corr"] for r in correlation_table(df.unionByName(bad), cols, block).collect()}
    assert len(got) == d * d
    with np.errstate(all="ignore"):
        want = np.atleast_2d(np.corrcoef(x, rowvar=False))
    for (a, b), v in got.items():
        if "c0" in (a, b):
            assert v is None
        else:
            assert v == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1e-9)


def test_a_thousand_features(spark):
    n = 1000
    df = spark.range(300).select(*[(F.rand(i) + F.rand(i // 2) * 0.5).alias(f"f{i}") for i in range(n)])
    rows = df.select(F.array(*df.columns).alias("x"))
    means = {r["i"]: r["mean"] for r in column_means(rows).collect()}
    cells = cross_products(rows, [means[i] for i in range(n)])
    assert cells.count() == n * (n + 1) // 2
    x = np.array([r["x"] for r in rows.collect()])
    c = np.cov(x, rowvar=False, ddof=0) * len(x)
    some = cells.where("i in (0, 500, 999) and j >= 990").collect()
    assert some and all(r["s"] == pytest.approx(c[r["i"], r["j"]]) for r in some)


def test_no_rows_and_no_usable_row(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert {r["corr"] for r in correlation_table(df, ["a", "b"]).collect()} == {None}


@pytest.fixture(scope="module")
def batches(spark):
    g = np.random.default_rng(7)
    rows = [(i, float(g.normal(20, 3)) if i % 9 else None, float(g.gamma(2, 10)) if i % 4 else None) for i in range(900)]
    rows[5] = (5, 59.0, 99.0)
    df = spark.createDataFrame(rows, "rid long, temp double, humidity double")
    return df, [df.where("rid < 100"), df.where("rid >= 100 and rid < 101"), df.where("rid >= 101")]


def test_states_merge_to_the_state_of_all_rows(batches):
    df, parts = batches
    cols = ["temp", "humidity"]
    a, b, c = (state(p, cols) for p in parts)
    whole = {r["column"]: r for r in state(df, cols).collect()}
    for merged in (merge_states(a, b, c), merge_states(c, merge_states(b, a))):
        for r in merged.collect():
            w = whole[r["column"]]
            assert (r["n"], r["lo"], r["hi"]) == (w["n"], w["lo"], w["hi"])
            assert r["mean"] == pytest.approx(w["mean"], rel=1e-12) and r["m2"] == pytest.approx(w["m2"], rel=1e-10)


@pytest.mark.parametrize("method, fill", [("zscore", "mean"), ("iqr", "median"), ("none", "mean"), ("iqr", "mean")])
def test_merged_clean_is_the_clean_of_all(spark, batches, method, fill):
    df, parts = batches
    plan = CleanPlan(numeric_columns=("temp", "humidity"), outlier_method=method, missing_strategy=fill, physical_bounds={"temp": (0.0, 60.0)}, dedup_keys=("rid",))
    limits = outliers_of(merge_states(*[raw_state(p, plan) for p in parts]), plan)
    frozen = freeze_merged(merge_states(*[kept_state(p, plan, limits) for p in parts]), plan, limits)
    got = {r["rid"]: (r["temp"], r["humidity"]) for r in apply_frozen(df, frozen).collect()}
    want = {r["rid"]: (r["temp"], r["humidity"]) for r in clean(df, plan).df.collect()}
    if method == "iqr":  # a sketched quantile is a value within the stated rank error
        assert np.mean([abs(g - w) < 1e-9 for i in got for g, w in zip(got[i], want[i])]) > 0.7
        assert max(abs(g - w) for i in got for g, w in zip(got[i], want[i]) if abs(w) < 40) < 25
    else:
        assert got.keys() == want.keys() and all(g == pytest.approx(w, rel=1e-9) for i in got for g, w in zip(got[i], want[i]))


def test_only_constant_fills_merge(batches):
    plan = CleanPlan(numeric_columns=("temp",), missing_strategy="time")
    with pytest.raises(ValueError):
        freeze_merged(None, plan, None)
