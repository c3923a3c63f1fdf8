"""Infinite values, text cells, dates, missing markers and rejected lines."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions.columns import parse_timestamp
from fieldspark.operators.ordered import ordered_scan
from fieldspark.operators.quantiles import quantiles
from fieldspark.plans.clean import clean
from fieldspark.plans.config import CleanPlan
from fieldspark.sources.ingest import ingest


@pytest.mark.parametrize("rows", [50, 30_000])
def test_quantiles_with_infinite_values(spark, rows):
    x = np.random.default_rng(1).normal(0, 100, rows)
    x[::10], x[5::30] = math.inf, -math.inf
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = quantiles(df, {"x": F.col("x")}, [0.0, 0.01, 0.25, 0.5, 0.75, 1.0])["x"]
    s = np.sort(x)
    for p, g in zip([0.0, 0.01, 0.25, 0.5, 0.75, 1.0], got):
        h = (rows - 1) * p
        lo, hi = s[math.floor(h)], s[math.ceil(h)]
        assert g == pytest.approx(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))


def test_quantiles_of_extreme_spreads(spark):
    values = [-1.7e308, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.7e308] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(df, {"x": F.col("x")}, [0.0, 0.5, 1.0], buckets=4)["x"]
    assert got == [-1.7e308, sorted(values)[10], 1.7e308]


def test_carry_over_many_buckets(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 997 == 3, F.col("id")).alias("v"))
    out = ordered_scan(df, [], ["id"], [("prev", "last", F.col("v")), ("next", "first", F.col("v"))], 200)
    seen = [i for i in range(4000) if i % 997 == 3]
    for r in out.collect():
        assert r["prev"] == max((s for s in seen if s <= r["id"]), default=None)
        assert r["next"] == min((s for s in seen if s >= r["id"]), default=None)


def test_dates_of_many_shapes_in_any_time_zone(spark):
    texts = {
        "2024-01-05": "2024-01-05 00:00:00", "2024-01-05 10:30": "2024-01-05 10:30:00", "2024-1-6": "2024-01-06 00:00:00", "2024-01-07T10:00:00.5": "2024-01-07 10:00:00.500000",
        "2024-03-31 02:30:00": "2024-03-31 02:30:00", "31/03/2024 02:30:00": "2024-03-31 02:30:00", "5-1-2024": "2024-01-05 00:00:00", "2024/01/05": "2024-01-05 00:00:00",
        "2024-01-05T10:00:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00:00+02:00": "2024-01-05 10:00:00", "2024-02-31": None, "soon": None, "": None,
    }
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r["t"]: r["d"] for r in df.select("t", parse_timestamp("t").alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {t: str(d) if d is not None else None for t, d in got.items()} == texts


def test_ingest_markers_extra_cells_and_rejected_lines(spark):
    folder = tempfile.mkdtemp(prefix="ingest-")
    lines = ["date,field_id,temp,humidity,ph,yield", "2024-01-05,F1,NA,,7,1", "2024-1-6 10:30,F2,20,null,7,2,more,cells", "later,F3,20,1,7,2", "2024-01-07,F4,21"]
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write("\n".join(lines))
    res = ingest(spark, folder)
    rows = {r["field_id"]: r for r in res.df.collect()}
    assert set(rows) == {"F1", "F2", "F4"} and rows["F1"]["temp"] is None and rows["F1"]["humidity"] is None and rows["F2"]["humidity"] is None
    got = {(r["line_no"], r["reason"], r["raw_line"]) for r in res.rejected.collect()}
    assert {(n, why) for n, why, _ in got} == {(2, "more cells than the header"), (3, "no readable date"), (4, "fewer cells than the header")}
    assert lines[2] in {raw for *_, raw in got}


def test_failed_files_are_all_listed(spark):
    folder = tempfile.mkdtemp(prefix="ingest-")
    for i in range(25):
        with open(os.path.join(folder, f"{i}.csv"), "w") as f:
            f.write("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="25 files failed validation"):
        ingest(spark, folder)


def test_text_cells_are_coerced_before_units_and_bounds(spark):
    df = spark.createDataFrame([(1, "12,5", "300,0"), (2, "x", "7")], "rid long, rainfall_in string, ph string")
    out = {r["rid"]: r for r in clean(df, CleanPlan(physical_bounds={"ph": (0, 14)}, missing_strategy="drop", missing_drop_threshold=1.0)).df.collect()}
    assert 1 not in out and 2 not in out or all(r["ph"] is None or r["ph"] <= 14 for r in out.values())


def test_column_that_stays_empty_after_the_fill_is_dropped(spark):
    rows = [(i, f"2024-01-{i + 1:02d}", "a" if i < 10 else "b", "x" if i < 8 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "rid long, date string, field_id string, crop_type string")
    plan = CleanPlan(categorical_columns=("crop_type",), categorical_by=("field_id",), date_columns=("date",), missing_drop_threshold=0.45)
    assert "crop_type" not in clean(df, plan).df.columns
