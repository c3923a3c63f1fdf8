import pytest
from pyspark.sql import functions as F

from fieldspark.operators import features as FE
from fieldspark.operators import split as SP


def test_onehot_names_and_width(spark):
    df = spark.createDataFrame([(1, "Mais", 20.0), (2, "Vite", 22.0), (3, "Mais", 21.0)], "rid long, crop string, temp double")
    out, names = FE.onehot_encode(df, ["crop"])
    assert names == ["crop_Mais", "crop_Vite"]
    fm, fnames, _ = FE.feature_matrix(df, FE.FeatureSpec(["temp"], ["crop"], encoding="onehot"))
    assert fnames == ["temp", "crop_Mais", "crop_Vite"] and len(fm.first()["features"]) == 3


def test_label_codes_sorted(spark):
    df = spark.createDataFrame([(1, "Vite"), (2, "Mais"), (3, None)], "rid long, crop string")
    out = {r["crop"]: r["crop_code"] for r in FE.label_encode(df, ["crop"]).collect()}
    assert out == {"Mais": 0, "Vite": 1, None: 2}  # missing is the text 'nan'


def test_split_sizes_70_20_10(spark):
    df = spark.range(100).withColumnRenamed("id", "rid")
    counts = {r["split"]: r["n"] for r in SP.split_counts(SP.split_exact(df, "rid", (0.7, 0.2, 0.1))).collect()}
    assert counts == {"train": 70, "val": 20, "test": 10, "total": 100}


def test_split_ratios_must_sum_to_one():
    with pytest.raises(ValueError):
        SP.split_sizes(10, (0.5, 0.2, 0.1))


def test_robust_vs_standard(spark):
    df = spark.createDataFrame([(float(v),) for v in [20.0, 21.0, 22.0, 20.5, 1000.0]], "temp double")
    p = FE.fit_scaler(df, ["temp"], "robust")
    assert p.center["temp"] == 21.0 and p.scale["temp"] == 1.5
    scaled = FE.apply_scaler(df, p).where(F.col("temp") > 0.6).where(F.col("temp") < 0.7).count()
    assert scaled == 1  # 22 -> 0.6667
    s = FE.fit_scaler(df, ["temp"], "standard")
    assert s.center["temp"] != p.center["temp"]


def test_zero_scale_becomes_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert FE.fit_scaler(df, ["x"], "standard").scale["x"] == 1.0


def test_schema_lock_order_insensitive():
    assert FE.schema_lock(["b", "a", "c"]) == FE.schema_lock(["c", "b", "a"])
    assert FE.schema_lock(["a"]) != FE.schema_lock(["b"])


def test_finite_guard(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert FE.nonfinite_counts(df, ["x"]).first()["n_nonfinite"] == 3
    with pytest.raises(ValueError, match="x"):
        FE.assert_finite(df, ["x"])


def test_hash_split_is_stable_and_close(spark):
    df = spark.range(20000).withColumnRenamed("id", "rid")
    a = {r["split"]: r["n"] for r in SP.split_counts(SP.split_by_hash(df, "rid")).collect()}
    assert abs(a["train"] - 14000) < 400 and a["total"] == 20000
    b = SP.split_by_hash(df.repartition(3), "rid").where("rid < 50").orderBy("rid").collect()
    c = SP.split_by_hash(df, "rid").where("rid < 50").orderBy("rid").collect()
    assert b == c


def test_presets_from_yaml_keeps_misplaced_entries(spark, tmp_path):
    from fieldspark.sources import presets as PR

    p = tmp_path / "k.yaml"
    p.write_text(
        "regional_presets:\n  a_preset:\n    region: R1\n    crop: maize\n    max_yield: 10\n    temp_range: [0, 30]\n"
        "    ideal_ph: [6, 7]\n    harvest_months: [9]\n"
        "b_preset:\n  region: R2\n  crop: olive\n  max_yield: 5\n  temp_range: [-5, 38]\n  ideal_ph: [6.5, 7.8]\n  harvest_months: [11, 12, 1]\n"
        "crops:\n  maize:\n    t_base: 10.0\n",
        encoding="utf-8",
    )
    t = {r["name"]: r for r in PR.presets_from_yaml(spark, str(p)).collect()}
    assert set(t) == {"a_preset", "b_preset"}
    assert t["a_preset"]["t_base"] == 10.0 and t["b_preset"]["t_base"] is None
    plan = PR.plan_from_preset(PR.presets_from_yaml(spark, str(p)), "b_preset")
    assert plan.physical_bounds["temp"] == (-5.0, 38.0) and plan.harvest_months == (11, 12, 1)
    assert [r["region"] for r in PR.list_presets(PR.presets_table(spark), "piem").collect()] == ["Piemonte"]


def test_schema_hash_by_group_matches_lock(spark):
    cat = spark.createDataFrame([("f1", "b"), ("f1", "a"), ("f2", "a"), ("f2", "b"), ("f3", "a")], "g string, column string")
    got = {r["g"]: r["schema_hash"] for r in FE.schema_hash_by_group(cat, "g").collect()}
    assert got["f1"] == got["f2"] == FE.schema_lock(["a", "b"]) and got["f3"] == FE.schema_lock(["a"])


def test_exact_split_moves_no_rows_and_matches_ranks(spark):
    df = spark.range(997).withColumnRenamed("id", "k")
    out = SP.split_exact(df, "k", (0.7, 0.2, 0.1), 7)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    import hashlib

    order = sorted(range(997), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
    got = {r["k"]: r["split"] for r in out.collect()}
    assert [got[k] for k in order] == ["train"] * 697 + ["val"] * 200 + ["test"] * 100


def test_exact_split_keeps_rows_of_one_key_together(spark):
    df = spark.createDataFrame([(i // 10,) for i in range(100)] + [(None,)] * 5, "k int")
    parts = SP.split_exact(df, "k").groupBy("k").agg({"split": "count"}).count()
    assert parts == 11
    assert SP.split_exact(df, "k").groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert SP.split_exact(df.limit(0), "k").count() == 0


def test_sparse_onehot_has_no_width_limit(spark):
    df = spark.range(3000).selectExpr("id", "lpad(id % 1200, 5, '0') AS a", "IF(id % 2 = 0, NULL, 'x') AS b")
    out = FE.onehot_sparse(df, ["a", "b"]).orderBy("id")
    first, second = out.take(2)
    assert first["onehot_size"] == 1202
    assert list(first["onehot_indices"]) == [0, 1200] and list(second["onehot_indices"]) == [1, 1201]
    wide, names = FE.onehot_encode(df, ["a"])
    assert len(names) == 1200 and wide.where("a_00007 = 1").count() == df.where("a = '00007'").count()


def test_feature_selection_takes_numeric_columns_but_the_target(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "a", 4)], "rid int, temp double, yield double, crop string, year int")
    spec = FE.select_features(df, "yield", ["crop", "missing"])
    assert spec.numeric == ["temp", "year"] and spec.categorical == ["crop"] and spec.target == "yield"
