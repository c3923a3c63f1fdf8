import datetime as dt

from pyspark.sql import functions as F

from fieldspark.operators import rules as R
from fieldspark.plans.clean import clean
from fieldspark.plans.config import CleanPlan
from fieldspark.sources import presets as PR


def _sabotaged(spark):
    # four rows, each breaking one regional rule (dates as text)
    rows = [
        (1, "2025-01-15", 5.0, 7.5, 5.0, "F1"),
        (2, "2025-08-20", 20.0, 7.0, 25.0, "F2"),
        (3, "2025-09-10", 7.0, 9.0, 20.0, "F3"),
        (4, "2025-07-05", 15.0, 6.5, 55.0, "F4"),
    ]
    return spark.createDataFrame(rows, "rid long, date string, yield double, ph double, temp double, field_id string")


def _diag(res):
    return {r["metric"]: r["value"] for r in res.diagnostics.collect()}


def test_physical_bounds_nulls_cells_and_counts(spark):
    df = spark.createDataFrame([(1, 99.0, 20.0), (2, 7.0, 500.0), (3, None, 10.0)], "rid long, ph double, temp double")
    out = R.physical_bounds(df, {"ph": (0.0, 14.0), "temp": (-30.0, 60.0)}, flag="n").orderBy("rid").collect()
    assert out[0]["ph"] is None and out[0]["n"] == 1
    assert out[1]["temp"] is None and out[1]["n"] == 1
    assert out[2]["ph"] is None and out[2]["n"] == 0  # missing is not out of bounds


def test_bounds_lo_above_hi_rejected():
    import pytest

    with pytest.raises(ValueError):
        CleanPlan(physical_bounds={"ph": (14.0, 0.0)})


def test_presets_on_sabotaged_rows(spark):
    presets = PR.presets_table(spark)
    df = _sabotaged(spark)
    barolo = clean(df, PR.plan_from_preset(presets, "vite_nebbiolo_barolo").with_(numeric_columns=("yield", "ph", "temp")))
    assert _diag(barolo)["agronomic_outliers_removed"] >= 1
    nocciola = clean(df, PR.plan_from_preset(presets, "nocciola_piemonte_alta_langa"))
    y = {r["rid"]: r["yield"] for r in nocciola.df.collect()}
    assert y[2] != 20.0 and _diag(nocciola)["agronomic_outliers_removed"] >= 1
    riso = clean(df, PR.plan_from_preset(presets, "riso_novarese"))
    ph = {r["rid"]: r["ph"] for r in riso.df.collect()}
    assert ph[3] != 9.0 and _diag(riso)["out_of_bounds_removed"] >= 1
    mais = clean(df, PR.plan_from_preset(presets, "mais_cuneese_irriguo"))
    t = {r["rid"]: r["temp"] for r in mais.df.collect()}
    assert t[4] != 55.0 and _diag(mais)["out_of_bounds_removed"] >= 1


def test_soft_mode_keeps_value_and_multiplies_confidence(spark):
    # max_yield 20 and harvest months 9-10 both fire on a yield of 50 in January: 0.3 * 0.1
    df = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, i + 1), float(t), y, "F1") for i, (t, y) in enumerate([(15, 5.0), (20, 5.0), (10, 5.0), (25, 50.0), (5, 5.0)])],
        "rid long, date timestamp_ntz, temp double, yield double, field_id string",
    )
    plan = CleanPlan(numeric_columns=("temp", "yield"), soft_cleaning=True, max_yield=20.0, harvest_months=(9, 10), outlier_method="none")
    rows = {r["rid"]: r for r in clean(df, plan).df.collect()}
    assert rows[3]["yield"] == 50.0
    assert abs(rows[3]["confidence"] - 0.03) < 1e-12
    assert rows[0]["confidence"] == 0.1  # yield > 0 outside the harvest months


def test_missing_date_counts_as_out_of_season(spark):
    df = spark.createDataFrame([(1, None, 3.0)], "rid long, date timestamp_ntz, yield double")
    out = R.agronomic_rules(df, None, [9], soft=False, flag="n").first()
    assert out["yield"] is None and out["n"] == 1


def test_iqr_needs_ten_values(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 1000])], "rid long, x double")
    st = R.fit_outliers(df, ["x"], "iqr")
    assert st.limits == {}
    df2 = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 1000])], "rid long, x double")
    st2 = R.fit_outliers(df2, ["x"], "iqr")
    out = R.apply_outliers(df2, st2).where(F.col("x").isNull()).count()
    assert out == 1


def test_zscore_skips_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(20)], "rid long, x double")
    assert R.fit_outliers(df, ["x"], "zscore").zstats == {}


def test_zscore_flags_far_values(spark):
    vals = [10.0] * 30 + [11.0] * 30 + [1000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "rid long, x double")
    st = R.fit_outliers(df, ["x"], "zscore")
    assert R.apply_outliers(df, st).where(F.col("x").isNull()).count() == 1


def test_sparse_column_drop_is_strict(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 2.0, None), (3, None, None), (4, 4.0, None)], "rid long, a double, b double")
    out = R.drop_sparse(df, 0.5)
    assert out.columns == ["rid", "a"]  # a is exactly 0.5 null: kept; b is 0.75: dropped
