import datetime as dt

from fieldspark.plans.clean import clean
from fieldspark.plans.config import CleanPlan
from fieldspark.streaming.incremental import apply_frozen, freeze, start_stream


def test_frozen_statistics_on_a_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20), f"F{i % 3}", float(i % 17) if i % 5 else None) for i in range(60)]
    schema = "rid long, date timestamp_ntz, field_id string, temp double"
    ref = spark.createDataFrame(rows, schema)
    plan = CleanPlan(numeric_columns=("temp",), date_columns=("date",), physical_bounds={"temp": (0.0, 15.0)})
    res = clean(ref, plan)
    fz = freeze(res, plan)
    src = tmp_path / "src"
    spark.createDataFrame(rows[:30], schema).write.parquet(str(src / "b1"))
    spark.createDataFrame(rows[30:], schema).write.parquet(str(src / "b2"))
    q = start_stream(spark, str(src) + "/*", ref.schema, fz, str(tmp_path / "out"), str(tmp_path / "ckpt"), watermark=None)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = apply_frozen(ref, fz)
    assert got.count() == 60
    assert got.where("temp is null").count() == 0
    assert sorted(r["temp"] for r in got.collect()) == sorted(r["temp"] for r in batch.collect())
