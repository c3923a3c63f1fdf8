"""Sinks: feature bundle (Parquet, one folder per split), JSON manifest, runs table, report tables.

Everything heavy is written by executors; only small aggregates (per-feature statistics, correlations
of up to MANIFEST_FEATURES features, split counts, diagnostics) are assembled on the driver for the
manifest.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators import features as FE
from fieldspark.operators import gram as GR
from fieldspark.operators import model as MO
from fieldspark.operators import profile as P
from fieldspark.operators import split as SP

SCHEMA_VERSION = 1
MANIFEST_FEATURES = 64  # features whose correlations stand in the manifest itself


@dataclass
class Bundle:
    features_path: str
    categories_path: str
    manifest_path: str
    manifest: dict
    baseline: dict


def _unit(name: str | None) -> str:
    return P.COLUMN_DESCRIPTIONS.get((name or "").lower(), ("", ""))[0]


def build_manifest(
    stored: DataFrame,
    feature_names: list[str],
    params: FE.ScalerParams,
    categories: DataFrame | None,
    categories_path: str | None,
    input_columns: list[str],
    target: str | None,
    name: str,
    split_counts: dict[str, int] | None,
    ratios: tuple[float, float, float] | None,
    diagnostics: dict | None = None,
    preset: dict | None = None,
    files: list[tuple[str, str]] | None = None,
    encoding: str = "label",
    correlations_path: str | None = None,
) -> dict:
    """Statistics and correlations are those of the written features, encoded ones included; those of
    more than MANIFEST_FEATURES are written as a table, which the manifest names. The
    lock hash covers the input columns. Categories are named by the written table at any number."""
    num = [c for c in feature_names if c in params.columns]
    flat = stored.select(*[F.col("features")[i].cast("double").alias(c) for i, c in enumerate(feature_names)])
    st = {r["column"]: r for r in MO.feature_stats(flat, feature_names).collect()} if feature_names else {}
    columns = []
    for i, c in enumerate(feature_names):
        unit, desc = P.COLUMN_DESCRIPTIONS.get(c.lower(), ("", f"{P.DEFAULT_DESCRIPTION_PREFIX}{c}"))
        r = st.get(c)
        columns.append({
            "name": c, "index": i, "unit": unit, "description": desc, "normalized": True,
            "stats": None if r is None else {"mean": r["mean"], "std": r["std"], "min": r["min"], "max": r["max"]},
        })
    corr: dict = {}
    if len(feature_names) > MANIFEST_FEATURES and correlations_path:
        GR.correlation_table(flat, feature_names).write.mode("overwrite").parquet(correlations_path)
        corr = {"table": correlations_path}
    elif len(feature_names) > 1:
        for r in MO.correlation_matrix(flat, feature_names, {c: r["mean"] for c, r in st.items()}).collect():
            corr.setdefault(r["feature_i"], {})[r["feature_j"]] = r["corr"]
    mappings: dict = {}
    if categories is not None:
        counts = {r["column"]: r["n"] for r in categories.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        mappings = {c: {"type": encoding, "categories": n, "table": categories_path} for c, n in counts.items()}
        if encoding == "onehot":
            for c in mappings:
                mappings[c]["features"] = [f for f in feature_names if f.startswith(f"{c}_")]
    n_rows = sum(v for k, v in (split_counts or {}).items() if k != "total") if split_counts else stored.count()
    return {
        "schema_version": SCHEMA_VERSION,
        "generated_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "dataset_info": {
            "name": name,
            "rows": int(n_rows),
            "features": len(feature_names),
            "target": target,
            "target_unit": _unit(target),
            "task": "regression" if target else "unsupervised",
            "files": [{"source_file": f, "sha256": h} for f, h in (files or [])],
            "schema_lock_hash": FE.schema_lock(input_columns),
        },
        "columns": columns,
        "correlations": corr,
        "split_info": {
            "is_split": bool(ratios),
            "counts": {k: int((split_counts or {}).get(k, 0)) for k in ("train", "val", "test")} | {"total": int(n_rows)},
            "ratios": list(ratios) if ratios else "none",
        },
        "pipeline_context": {
            "preset_applied": (preset or {}).get("crop_display", "custom"),
            "region": (preset or {}).get("region", "unknown"),
            "scaler_params": {"type": params.kind, "mean" if params.kind == "standard" else "center": [params.center[c] for c in num], "scale": [params.scale[c] for c in num]},
            "categorical": encoding,
            "categorical_mappings": mappings,
        },
        "cleaning_stats": diagnostics or {},
    }


def write_json(spark: SparkSession, obj: dict, path: str) -> str:
    """One JSON document as a single text file written by Spark (UTF-8, indent 2)."""
    text = json.dumps(obj, indent=2, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def export_bundle(
    df: DataFrame,
    spec: FE.FeatureSpec,
    out_dir: str,
    name: str = "export",
    key: str = "rid",
    split_ratios: tuple[float, float, float] | None = (0.7, 0.2, 0.1),
    seed: int = 42,
    diagnostics: dict | None = None,
    preset: dict | None = None,
    files: list[tuple[str, str]] | None = None,
) -> Bundle:
    """Features (+ target) as Parquet partitioned by split, the category table, the manifest and
    the Ridge baseline (fit on train, MSE on val)."""
    spark = df.sparkSession
    columns = df.columns
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # read by the split and the fits below
    work = SP.split_exact(df, key, split_ratios, seed) if split_ratios else df
    split_col = "split" if split_ratios else None
    cats = FE.category_table(work, [c for c in spec.categorical if c in work.columns]) if spec.categorical else None
    cat_path = f"{out_dir}/{name}_categories"
    if cats is not None:  # fitted once: written, then reused for the codes of the feature rows
        cats.write.mode("overwrite").parquet(cat_path)
        cats = spark.read.parquet(cat_path)
    fm, names, params = FE.feature_matrix(work, spec, key, split_col, categories=cats if spec.encoding == "label" else None)
    feat_path = f"{out_dir}/{name}_features"
    writer = fm.write.mode("overwrite")
    (writer.partitionBy("split") if split_col else writer).parquet(feat_path)
    stored = spark.read.parquet(feat_path)
    counts = None
    if split_col:
        counts = {r["split"]: r["n"] for r in SP.split_counts(stored).collect()}
    manifest = build_manifest(stored, names, params, cats, cat_path if cats is not None else None, columns, spec.target, name, counts, split_ratios, diagnostics, preset, files, spec.encoding, f"{out_dir}/{name}_correlations")
    man_path = write_json(spark, manifest, f"{out_dir}/{name}_manifest")
    baseline: dict = {}
    if spec.target:
        xs = [F.col("features")[i].alias(f"x{i}") for i in range(len(names))]
        flat = stored.select(*xs, F.col("target"), *([F.col("split")] if split_col else []))
        res = MO.ridge_baseline(flat, [f"x{i}" for i in range(len(names))], "target", split_col).collect()
        if res:
            baseline = {"baseline_mse": res[0]["baseline_mse"]}
    df.unpersist()
    return Bundle(feat_path, cat_path, man_path, manifest, baseline)


def log_run(
    spark: SparkSession,
    runs_path: str,
    config: dict,
    diagnostics: dict,
    split_ratios: tuple[float, float, float] | None,
    metrics: dict,
    tags: dict | None = None,
    run_id: str | None = None,
) -> str:
    """Append one run to the runs table ``(run_id, logged_at, kind, key, value)``:
    scalar config as ``cfg_*``, numeric diagnostics as ``obs_*``, split ratios, ``model_*``."""
    run_id = run_id or uuid.uuid4().hex
    rows = []
    for k, v in config.items():
        if isinstance(v, (int, float, str, bool)) and v is not None:
            rows.append(("param", f"cfg_{k}", str(v)))
    for k, v in diagnostics.items():
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            rows.append(("metric", f"obs_{k}", str(float(v))))
    if split_ratios:
        for n, v in zip(("split_train", "split_val", "split_test"), split_ratios):
            rows.append(("param", n, str(v)))
    for k, v in metrics.items():
        rows.append(("metric", f"model_{k}", str(v)))
    for k, v in (tags or {}).items():
        rows.append(("tag", k, str(v)))
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    df = spark.createDataFrame([(run_id, now, *r) for r in rows], "run_id string, logged_at timestamp_ntz, kind string, key string, value string")
    try:  # a run that is there already (a repeated job) is not appended again
        df = df.join(spark.read.parquet(runs_path).select("run_id").distinct(), "run_id", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(runs_path)
    return run_id


def write_report_tables(before: DataFrame, after: DataFrame, numeric: list[str], out_dir: str) -> dict[str, str]:
    """Quality report as tables: summary, null tables before/after, describe, box plots, histograms."""
    after = after.persist(StorageLevel.MEMORY_AND_DISK)  # every table reads the cleaned frame
    tables = {
        "summary": P.before_after_summary(before, after),
        "nulls_before": P.null_table(before),
        "nulls_after": P.null_table(after),
        "describe_after": P.describe(after),
        "boxplot": P.boxplot_stats(before, after, numeric),
        "histogram": P.histogram_before_after(before, after, numeric),
    }
    paths = {}
    for k, t in tables.items():
        paths[k] = f"{out_dir}/{k}"
        t.write.mode("overwrite").parquet(paths[k])
    after.unpersist()
    return paths
