import datetime as dt

from fieldspark.operators import dedup as D
from fieldspark.operators.gdd import gdd
from fieldspark.operators.units import convert_units, match_suffix


def test_suffix_conversions(spark):
    df = spark.createDataFrame([(1, 32.0, 1.0, 10.0), (2, 212.0, 2.0, 0.0), (3, 68.0, 0.0, 1.0)], "rid long, temp_f double, rainfall_in double, yield_lb_acre double")
    out, report = convert_units(df)
    rows = {r["rid"]: r for r in out.collect()}
    assert abs(rows[1]["temp"]) < 1e-12 and abs(rows[2]["temp"] - 100) < 1e-12 and abs(rows[3]["temp"] - 20) < 1e-12
    assert rows[1]["rainfall"] == 25.4 and abs(rows[1]["yield"] - 11.2085) < 1e-12
    assert {r[0] for r in report} == {"temp_f", "rainfall_in", "yield_lb_acre"}
    assert "temp_f" not in out.columns


def test_suffix_needs_separator_and_never_overwrites(spark):
    assert match_suffix("terrain_in") is None
    assert match_suffix("soil_temp_f") == ("fahrenheit", "celsius", "temp")
    df = spark.createDataFrame([(1, 20.0, 70.0)], "rid long, temp double, soil_temp_f double")
    out, report = convert_units(df)
    assert out.first()["temp"] == 20.0 and report == []


def test_range_heuristic(spark):
    df = spark.createDataFrame([(1, 70.0), (2, 80.0), (3, 90.0)], "rid long, temp double")
    out, report = convert_units(df, use_range_heuristic=True)
    assert all(r["temp"] < 40 for r in out.collect()) and report
    df2 = spark.createDataFrame([(1, 15.0), (2, 20.0), (3, 25.0)], "rid long, temp double")
    out2, report2 = convert_units(df2, use_range_heuristic=True)
    assert [r["temp"] for r in out2.orderBy("rid").collect()] == [15.0, 20.0, 25.0] and report2 == []


def test_dedup_keeps_last_and_null_keys_equal(spark):
    df = spark.createDataFrame([(1, "F1", 1.0), (2, "F1", 2.0), (3, None, 3.0), (4, None, 4.0), (5, "F2", 5.0)], "rid long, k string, v double")
    out = {r["rid"]: r["v"] for r in D.dedup_keep_last(df, ["k"]).collect()}
    assert out == {2: 2.0, 4: 4.0, 5: 5.0}


def test_dedup_all_columns(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0)], "rid long, k string, v double")
    assert sorted(r["rid"] for r in D.dedup_all_columns(df).collect()) == [2, 3]


def test_gdd_daily_and_cumulative(spark):
    rows = [(i, dt.datetime(2024, 1, i + 1), float(t), "F1") for i, t in enumerate([15, 20, 10, 25, 5])] + [(9, dt.datetime(2024, 1, 9), None, "F1")]
    df = spark.createDataFrame(rows, "rid long, date timestamp_ntz, temp double, field_id string")
    out = gdd(df, 10.0).orderBy("date").collect()
    assert [r["gdd_daily"] for r in out] == [5.0, 10.0, 0.0, 15.0, 0.0, 0.0]
    assert out[-1]["gdd_accumulated"] == 30.0


def test_gdd_without_t_base_is_noop(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5.0)], "rid long, date timestamp_ntz, temp double")
    assert gdd(df, None).columns == df.columns
