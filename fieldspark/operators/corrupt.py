"""Error injection over any table, to measure a cleaning plan at scale.

Every random draw is ``u = md5(seed:name:key)`` read as a number in [0, 1): deterministic,
independent of partitioning and retries, and computable in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.columns import uniform
from fieldspark.operators.split import hash_boundaries

# --- fixed values (must equal the reference's generator) --------------------------------------
MISSING_RATE = 0.08
SPIKE_RATE = 0.03
VIOLATION_RATE = 0.02
WRONG_TYPE_RATE = 0.02
DUPLICATE_RATE = 0.05
SPIKES = {"temp": 200.0, "yield": 50.0, "rainfall": 5000.0}  # spike x U(0.5, 1.5)
PH_VIOLATIONS = (-2.0, 17.5, 99.0)
HUMIDITY_VIOLATION = (101.0, 150.0)


def inject_missing(df: DataFrame, cols: list[str], key: str, rate: float = MISSING_RATE, seed: int = 42) -> DataFrame:
    return df.withColumns({c: F.when(uniform(seed, f"nan:{c}", key) >= F.lit(rate), F.col(c)) for c in cols if c in df.columns})


def inject_spikes(df: DataFrame, spikes: dict[str, float], key: str, rate: float = SPIKE_RATE, seed: int = 42) -> DataFrame:
    upd: dict[str, Column] = {}
    for c, spike in spikes.items():
        if c not in df.columns:
            continue
        amp = F.round(F.lit(spike) * (F.lit(0.5) + uniform(seed, f"amp:{c}", key)), 2)
        upd[c] = F.when(uniform(seed, f"spike:{c}", key) < F.lit(rate), amp).otherwise(F.col(c))
    return df.withColumns(upd) if upd else df


def inject_violations(df: DataFrame, key: str, rate: float = VIOLATION_RATE, seed: int = 42) -> DataFrame:
    upd: dict[str, Column] = {}
    if "ph" in df.columns:
        idx = (F.floor(uniform(seed, "phv", key) * F.lit(len(PH_VIOLATIONS))) + 1).cast("int")
        bad = F.element_at(F.array(*[F.lit(v) for v in PH_VIOLATIONS]), idx)
        upd["ph"] = F.when(uniform(seed, "viol:ph", key) < F.lit(rate), bad).otherwise(F.col("ph"))
    if "humidity" in df.columns:
        lo, hi = HUMIDITY_VIOLATION
        bad = F.round(F.lit(lo) + F.lit(hi - lo) * uniform(seed, "humv", key), 2)
        upd["humidity"] = F.when(uniform(seed, "viol:humidity", key) < F.lit(rate), bad).otherwise(F.col("humidity"))
    return df.withColumns(upd) if upd else df


def inject_wrong_types(df: DataFrame, col: str, key: str, rate: float = WRONG_TYPE_RATE, seed: int = 42) -> DataFrame:
    """The column becomes text; a share of cells is written with a decimal comma ('12,5')."""
    text = F.col(col).cast("string")
    hit = uniform(seed, f"type:{col}", key) < F.lit(rate)
    return df.withColumn(col, F.when(hit & F.col(col).isNotNull(), F.regexp_replace(text, r"\.", ",")).otherwise(text))


def inject_errors(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Generator order: missing -> spikes -> physical violations -> wrong types."""
    nums = [c for c in ("temp", "humidity", "ph", "rainfall", "yield") if c in df.columns]
    out = inject_missing(df, nums, key, seed=seed)
    out = inject_spikes(out, SPIKES, key, seed=seed)
    out = inject_violations(out, key, seed=seed)
    if "temp" in out.columns:
        out = inject_wrong_types(out, "temp", key, seed=seed)
    return out


def inject_duplicates(df: DataFrame, key: str, rate: float = DUPLICATE_RATE, seed: int = 42, copy_col: str = "copy") -> DataFrame:
    """Append ``int(n * rate)`` copies of distinct rows (least hashes, no replacement); ``copy_col``
    is 0 for originals and 1 for the appended copies. Rows of one key are copied together."""
    base = df.withColumn(copy_col, F.lit(0))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("dup"), F.col(key).cast("string")))
    _, (last,) = hash_boundaries(df, h, lambda n: [int(n * rate)])
    if not last:
        return base
    return base.unionByName(df.where(h <= F.lit(last)).withColumn(copy_col, F.lit(1)))
