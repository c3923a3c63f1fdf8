import datetime as dt

from fieldspark.operators import impute as I


def _series(spark, vals, field="F1", start=1):
    rows = [(i, dt.datetime(2024, 1, start + i), field, v) for i, v in enumerate(vals)]
    return rows


def test_time_interpolation_single_gap(spark):
    df = spark.createDataFrame(_series(spark, [10.0, None, 20.0, 22.0, 24.0]), "rid long, date timestamp_ntz, field_id string, temp double")
    out = {r["rid"]: r["temp"] for r in I.impute_time(df, ["temp"]).collect()}
    assert out[1] == 15.0


def test_time_interpolation_gap_limit_and_edges(spark):
    vals = [None, 1.0, None, None, None, None, None, 13.0, None]
    df = spark.createDataFrame(_series(spark, vals), "rid long, date timestamp_ntz, field_id string, temp double")
    out = [r["temp"] for r in I.impute_time(df, ["temp"]).orderBy("rid").collect()]
    assert out == [1.0, 1.0, 3.0, 5.0, 7.0, 7.0, 7.0, 13.0, 13.0]


def test_time_interpolation_respects_field_boundaries(spark):
    rows = _series(spark, [10.0, None, 20.0], "F1") + [(10 + i, dt.datetime(2024, 1, 1 + i), "F2", v) for i, v in enumerate([100.0, 105.0, 110.0])]
    df = spark.createDataFrame(rows, "rid long, date timestamp_ntz, field_id string, temp double")
    out = {r["rid"]: r["temp"] for r in I.impute_time(df, ["temp"]).collect()}
    assert out[1] == 15.0 and out[11] == 105.0


def test_time_fallback_to_median_without_date(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 10.0)], "rid long, temp double")
    out = {r["rid"]: r["temp"] for r in I.impute_time(df, ["temp"], date_col="date").collect()}
    assert out[2] == 3.0


def test_median_and_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 10.0)], "rid long, x double")
    assert {r["rid"]: r["x"] for r in I.impute_constant(df, ["x"], "median").collect()}[2] == 2.0
    assert abs({r["rid"]: r["x"] for r in I.impute_constant(df, ["x"], "mean").collect()}[2] - 13.0 / 3) < 1e-12


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "rid long, x double")
    assert I.impute_constant(df, ["x"], "median").where("x is null").count() == 2


def test_ffill_then_bfill_in_row_order(spark):
    df = spark.createDataFrame([(5, None), (1, None), (2, 3.0), (3, None), (4, 7.0)], "rid long, x double")
    out = {r["rid"]: r["x"] for r in I.impute_ffill(df, ["x"], ["rid"]).collect()}
    assert out == {1: 3.0, 2: 3.0, 3: 3.0, 4: 7.0, 5: 7.0}


def test_categorical_fill_by_date_is_global(spark):
    rows = [(1, dt.datetime(2024, 1, 3), "F1", None), (2, dt.datetime(2024, 1, 1), "F2", "wheat"), (3, dt.datetime(2024, 1, 2), "F1", None), (4, dt.datetime(2024, 1, 4), "F3", "corn")]
    df = spark.createDataFrame(rows, "rid long, date timestamp_ntz, field_id string, crop string")
    out = {r["rid"]: r["crop"] for r in I.impute_categorical(df, ["crop"]).collect()}
    assert out == {1: "wheat", 2: "wheat", 3: "wheat", 4: "corn"}


def test_drop_strategy(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "rid long, a double, b double")
    assert I.impute_drop(df, ["a", "b"]).count() == 1
