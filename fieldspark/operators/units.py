"""Unit conversion: non-SI columns detected by name suffix or by value range, converted to SI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.columns import coerce_numeric
from fieldspark.operators.lookup import lookup

# --- fixed values (must equal the reference's behaviour) --------------------------------------
LB_PER_ACRE_TO_KG_PER_HA = 1.12085
INCH_TO_MM = 25.4
# name suffix -> (from unit, to unit, canonical column), tried in this order
SUFFIX_RULES = (
    ("temp_f", "fahrenheit", "celsius", "temp"),
    ("temperature_f", "fahrenheit", "celsius", "temp"),
    ("rainfall_in", "inch", "mm", "rainfall"),
    ("rain_in", "inch", "mm", "rainfall"),
    ("yield_lb_acre", "lb_per_acre", "kg_per_ha", "yield"),
    ("yield_lb_per_acre", "lb_per_acre", "kg_per_ha", "yield"),
)
# column -> ((low, high), (from unit, to unit)): every non-null value inside -> treated as that unit
RANGE_RULES = (("temp", 50.0, 120.0, "fahrenheit", "celsius"),)


def fahrenheit_to_celsius(x: Column) -> Column:
    return (x - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def inch_to_mm(x: Column) -> Column:
    return x * F.lit(INCH_TO_MM)


def lb_per_acre_to_kg_per_ha(x: Column) -> Column:
    return x * F.lit(LB_PER_ACRE_TO_KG_PER_HA)


CONVERSIONS = {
    ("fahrenheit", "celsius"): fahrenheit_to_celsius,
    ("inch", "mm"): inch_to_mm,
    ("lb_per_acre", "kg_per_ha"): lb_per_acre_to_kg_per_ha,
}


def match_suffix(name: str) -> tuple[str, str, str] | None:
    """Rule for a column name: exact pattern or ``_pattern`` suffix (``terrain_in`` does not match)."""
    low = name.strip().lower()
    for pattern, src, dst, canonical in SUFFIX_RULES:
        if low == pattern or low.endswith("_" + pattern):
            return src, dst, canonical
    return None


def convert_units(df: DataFrame, use_range_heuristic: bool = False) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """Returns the converted frame and a report ``[(column, from, to, canonical)]``.

    Suffix columns are converted, dropped and re-added under the canonical name; an existing
    canonical column is never overwritten (the suffix column is then left untouched). The range
    heuristic needs one ``min/max`` aggregate and skips columns converted by suffix.
    """
    report: list[tuple[str, str, str, str]] = []
    exprs: list[Column] = []
    taken = set(df.columns)
    converted: set[str] = set()
    drop: set[str] = set()
    for c in df.columns:
        rule = match_suffix(c)
        if rule is None:
            continue
        src, dst, canonical = rule
        if canonical in taken and canonical != c:
            continue
        conv = CONVERSIONS[(src, dst)]
        exprs.append(conv(coerce_numeric(c)).alias(canonical))
        taken.add(canonical)
        drop.add(c)
        converted.add(canonical)
        report.append((c, src, dst, canonical))
    out = df.select(*[F.col(c) for c in df.columns if c not in drop], *exprs) if exprs else df
    if use_range_heuristic:
        rules = [(c, lo, hi, s, d) for c, lo, hi, s, d in RANGE_RULES if c in out.columns and c not in converted]
        if rules:
            aggs = []
            for i, (c, *_rest) in enumerate(rules):
                v = coerce_numeric(c)
                aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
            row = out.agg(*aggs).first()
            upd = {}
            for i, (c, lo, hi, s, d) in enumerate(rules):
                mn, mx = row[f"mn{i}"], row[f"mx{i}"]
                if mn is not None and mn >= lo and mx <= hi:
                    upd[c] = CONVERSIONS[(s, d)](coerce_numeric(c))
                    report.append((c, s, d, c))
            if upd:
                out = out.withColumns(upd)
    return out, report


def range_heuristic_by_source(df: DataFrame, col: str = "temp", source_col: str = "source_file") -> DataFrame:
    """Per-source variant: a source whose ``col`` values all lie in the °F range is converted.

    The per-source min/max is a partial aggregate (one row per source), looked up by the source key
    without moving the rows of a hot source to a single task.
    """
    lo, hi = RANGE_RULES[0][1], RANGE_RULES[0][2]
    ranges = df.groupBy(source_col).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    ranges = ranges.select(
        F.col(source_col).alias("_src"),
        (F.col("_mn").isNotNull() & (F.col("_mn") >= F.lit(lo)) & (F.col("_mx") <= F.lit(hi))).alias("_is_f"),
    )
    out = lookup(df, F.col(source_col), ranges, "_src")
    conv = F.when(F.col("_is_f"), fahrenheit_to_celsius(F.col(col))).otherwise(F.col(col))
    return out.withColumn(col, conv).drop("_is_f")
