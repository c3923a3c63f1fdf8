"""Regional presets and crop knowledge as small DataFrames (flat tables, broadcast on join).

The reference keeps presets in one nested YAML document where some entries fall outside the
``regional_presets`` mapping and cannot be looked up; a flat table cannot have that defect.
``presets_from_yaml`` reads such a document and keeps every mapping that looks like a preset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.plans.config import CleanPlan

# --- fixed values: crop base temperatures (°C) for growing degree days -------------------------
CROP_T_BASE = {
    "olive": 10.0,
    "durum_wheat": 0.0,
    "soft_wheat": 0.0,
    "wine_grape_docg": 10.0,
    "rice": 12.0,
    "apple": 4.0,
    "tomato": 10.0,
    "maize": 10.0,
}

# --- fixed values: built-in presets (name, region, crop, crop_display, zona, soil texture,
#     max_yield t/ha, temp range, ideal pH, harvest months, salinity tolerance) ----------------
BUILTIN_PRESETS = [
    ("vite_nebbiolo_barolo", "Piemonte", "wine_grape_docg", "Nebbiolo da Barolo (Langhe)",
     "Langhe (Barolo, La Morra, Serralunga)", "Argillo-limoso calcareo (Marne di Sant'Agata)",
     8.0, (-15.0, 38.0), (7.2, 8.2), [10], None),
    ("riso_novarese", "Piemonte", "rice", "Riso Novarese (Carnaroli/Arborio)",
     "Novarese (Bassa Novarese)", "Sabbioso-limoso (Terrazzi fluvioglaciali)",
     7.5, (5.0, 36.0), (5.0, 6.5), [9, 10], 1.5),
    ("nocciola_piemonte_alta_langa", "Piemonte", "hazelnut", "Nocciola Tonda Gentile (Alta Langa)",
     "Alta Langa (>500m slm)", "Sciolto / Scheletro prevalente",
     2.8, (-18.0, 34.0), (6.0, 7.5), [8, 9], None),
    ("mais_cuneese_irriguo", "Piemonte", "maize", "Mais da granella (Pianura Cuneese)",
     "Cuneo / Savigliano / Fossano", "Franco-limoso alluvionale (Profondo)",
     16.0, (5.0, 40.0), (6.0, 7.2), [9, 10, 11], None),
    ("vite_franciacorta_docg", "Lombardia", "wine_grape_docg", "Vite Metodo Classico (Franciacorta)",
     "Erbusco / Corte Franca / Iseo", "Morenico (Ghiaioso-sabbioso)",
     12.0, (-12.0, 38.0), (6.5, 7.8), [8, 9], None),
    ("vite_sangiovese_chianti_brunello", "Toscana", "wine_grape_docg", "Sangiovese (Chianti Classico / Brunello)",
     "Montalcino / Gaiole / Castellina / Radda", "Galestro (Scisti argillosi) / Alberese (Calcare)",
     8.5, (-10.0, 38.0), (7.5, 8.3), [9, 10], None),
    ("pomodoro_pachino_igp", "Sicilia", "tomato", "Pomodoro di Pachino IGP",
     "Pachino / Portopalo / Noto (SR)", "Sabbioso costiero",
     80.0, (10.0, 45.0), (6.5, 8.0), [4, 5, 6, 7, 8, 9, 10, 11], 5.0),
]

PRESET_SCHEMA = (
    "name string, region string, crop string, crop_display string, zona string, soil_texture string, "
    "max_yield double, temp_lo double, temp_hi double, ph_lo double, ph_hi double, "
    "harvest_months array<int>, salinity_tolerance double, t_base double"
)


def preset_records(presets=BUILTIN_PRESETS, t_base: dict[str, float] = CROP_T_BASE) -> list[tuple]:
    out = []
    for name, region, crop, disp, zona, soil, mx, (tlo, thi), (plo, phi), months, sal in presets:
        out.append((name, region, crop, disp, zona, soil, mx, tlo, thi, plo, phi, list(months), sal, t_base.get(crop)))
    return out


def presets_table(spark: SparkSession, records: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(records if records is not None else preset_records(), PRESET_SCHEMA)


def presets_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Flatten a knowledge document: every mapping with ``region`` and ``crop`` is a preset,
    wherever it sits (so misplaced entries are not lost); crops give ``t_base``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    crops = {k: (v or {}).get("t_base") for k, v in (doc.get("crops") or {}).items()}
    found: dict[str, dict] = {}

    def walk(node):
        if not isinstance(node, dict):
            return
        for k, v in node.items():
            if isinstance(v, dict) and "region" in v and "crop" in v:
                found.setdefault(k, v)
            if isinstance(v, dict):
                walk(v)

    walk(doc)
    recs = []
    for name, p in found.items():
        tr, ph = p.get("temp_range") or (None, None), p.get("ideal_ph") or (None, None)
        recs.append((
            name, p.get("region"), p.get("crop"), p.get("crop_display"), p.get("zona"), p.get("suolo_tessitura"),
            None if p.get("max_yield") is None else float(p["max_yield"]),
            None if tr[0] is None else float(tr[0]), None if tr[1] is None else float(tr[1]),
            None if ph[0] is None else float(ph[0]), None if ph[1] is None else float(ph[1]),
            [int(m) for m in p.get("harvest_months") or []],
            None if p.get("salinity_tolerance") is None else float(p["salinity_tolerance"]),
            None if crops.get(p.get("crop")) is None else float(crops[p.get("crop")]),
        ))
    return presets_table(spark, recs)


def plan_from_preset(presets: DataFrame, name: str) -> CleanPlan:
    """Preset row -> cleaning plan (temp/pH bounds, yield and season rules, t_base)."""
    rows = presets.where(F.col("name") == name).limit(1).collect()
    if not rows:
        raise ValueError(f"preset {name!r} not found")
    p = rows[0]
    bounds = {}
    if p["temp_lo"] is not None:
        bounds["temp"] = (p["temp_lo"], p["temp_hi"])
    if p["ph_lo"] is not None:
        bounds["ph"] = (p["ph_lo"], p["ph_hi"])
    return CleanPlan(
        date_columns=("date",),
        dedup_keys=("field_id", "date"),
        categorical_columns=("crop_type", "field_id"),
        physical_bounds=bounds,
        max_yield=p["max_yield"],
        harvest_months=tuple(p["harvest_months"] or ()),
        salinity_tolerance=p["salinity_tolerance"],
        soil_texture=p["soil_texture"],
        t_base=p["t_base"],
        preset_name=name,
    )


def apply_preset_rules(df: DataFrame, presets: DataFrame, key: str, preset_key: str = "name", flag: str | None = None) -> DataFrame:
    """Per-row preset rules: join each row to its preset (Spark broadcasts the preset table
    where its size allows) and null temp/pH outside the preset limits, yield above max_yield
    and positive yield outside the harvest months."""
    p = presets.select(
        F.col(preset_key).alias("_preset"), "temp_lo", "temp_hi", "ph_lo", "ph_hi", "max_yield", "harvest_months"
    )
    j = df.join(p, df[key] == p["_preset"], "left")
    out = {}
    bad_t = F.coalesce((F.col("temp") < F.col("temp_lo")) | (F.col("temp") > F.col("temp_hi")), F.lit(False))
    bad_p = F.coalesce((F.col("ph") < F.col("ph_lo")) | (F.col("ph") > F.col("ph_hi")), F.lit(False))
    out["temp"] = F.when(bad_t, F.lit(None)).otherwise(F.col("temp"))
    out["ph"] = F.when(bad_p, F.lit(None)).otherwise(F.col("ph"))
    j = j.withColumns(out)
    from fieldspark.operators.rules import agronomic_rules

    j = agronomic_rules(j, F.col("max_yield"), F.col("harvest_months"), soft=False, flag=flag)
    return j.drop("_preset", "temp_lo", "temp_hi", "ph_lo", "ph_hi", "max_yield", "harvest_months")


def list_presets(presets: DataFrame, region: str | None = None) -> DataFrame:
    """Presets grouped by region (case-insensitive substring filter), names sorted."""
    p = presets if region is None else presets.where(F.lower("region").contains(region.lower()))
    return p.groupBy("region").agg(F.sort_array(F.collect_list("name")).alias("presets")).orderBy("region")
