"""Missing-value imputation: constants (mean/median), drop, ordered fills, time interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.ordered import bucketize, fill_forward_backward, ordered_scan
from fieldspark.operators.quantiles import quantiles_with_stats
from fieldspark.session import cut_lineage

# --- fixed values (must equal the reference's behaviour) --------------------------------------
TIME_GAP_LIMIT = 3  # at most this many consecutive missing cells are interpolated


def fit_constants(df: DataFrame, cols: list[str], strategy: str = "median", accuracy: int | None = None) -> dict[str, float | None]:
    """Fill constant per column: ``mean`` or exact ``median``.

    One aggregate gives row count, non-null count, min, max (and mean) of every column; the
    median's selection passes run only for columns that actually have a missing cell.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"c{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.avg(v).alias(f"m{i}")]
    row = df.agg(*aggs).first()
    if strategy == "mean":
        return {c: row[f"m{i}"] for i, c in enumerate(cols)}
    stats = {c: (row[f"c{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}
    need = [c for c in cols if 0 < stats[c][0] < row["_n"]]
    q = quantiles_with_stats(df, {c: F.col(c) for c in need}, [0.5], {c: stats[c] for c in need}, accuracy=accuracy)
    # columns without a missing cell need no constant; all-null columns have none
    return {c: (q[c][0] if c in q else None) for c in cols}


def apply_constants(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    cols = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None and c in df.columns}
    return df.withColumns(cols) if cols else df


def impute_constant(df: DataFrame, cols: list[str], strategy: str = "median") -> DataFrame:
    return apply_constants(df, fit_constants(df, cols, strategy))


def impute_drop(df: DataFrame, cols: list[str]) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return df.na.drop(subset=cols) if cols else df


def impute_ffill(df: DataFrame, cols: list[str], order_cols: list[str]) -> DataFrame:
    """Forward fill then back fill over the whole table in row order (global, bucketed scan)."""
    cols = [c for c in cols if c in df.columns]
    return fill_forward_backward(df, cols, [], order_cols)


def impute_categorical(
    df: DataFrame, cols: list[str], date_col: str = "date", row_id: str = "rid", by: list[str] | None = None
) -> DataFrame:
    """Categorical fill: stable date order, forward then backward fill; global unless ``by``."""
    cols = [c for c in cols if c in df.columns]
    if not cols or date_col not in df.columns:
        return df
    return fill_forward_backward(df, cols, by or [], [date_col, row_id])


def impute_time(
    df: DataFrame,
    cols: list[str],
    date_col: str = "date",
    field_col: str | None = "field_id",
    row_id: str = "rid",
    limit: int = TIME_GAP_LIMIT,
    residual: str = "median",
) -> DataFrame:
    """Linear interpolation in time per field, at most ``limit`` cells per gap, then ffill/bfill.

    For a missing cell ``k`` rows after the last observed value ``pv`` (time ``pt``) and before
    the next observed ``nv`` (time ``nt``): ``k <= limit`` -> ``pv + (nv-pv)(t-pt)/(nt-pt)``;
    ``k > limit`` repeats the value of the ``limit``-th cell; a leading gap takes ``nv``, a trailing
    gap ``pv``. Cells of a field with no observed value get the column median afterwards.
    A null ``field_id`` is its own group. Without a date column this is the median strategy.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if date_col not in df.columns:
        return impute_constant(df, cols, "median")
    part = [field_col] if field_col and field_col in df.columns else []
    order = [date_col, row_id]
    # wall time: a zoned timestamp would shift at daylight saving changes
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(date_col).cast("timestamp_ntz"))
    b = bucketize(df, part, order)
    specs = [("_pos", "pos", None)]
    for c in cols:
        x = F.col(c)
        specs += [
            (f"_pv_{c}", "last", F.when(x.isNotNull(), F.struct(x.alias("v"), t.alias("t")))),
            (f"_nv_{c}", "first", F.when(x.isNotNull(), F.struct(x.alias("v"), t.alias("t")))),
            (f"_pp_{c}", "last_pos", x.isNotNull()),
        ]
    s1 = ordered_scan(b, part, order, specs, bucketed=True)
    interp: dict[str, Column] = {}
    kcols: dict[str, Column] = {}
    for c in cols:
        pv, nv = F.col(f"_pv_{c}"), F.col(f"_nv_{c}")
        k = F.col("_pos") - F.col(f"_pp_{c}")
        kcols[f"_gk_{c}"] = k
        line = pv["v"] + (nv["v"] - pv["v"]) * F.try_divide(t - pv["t"], nv["t"] - pv["t"])
        line = F.coalesce(line, pv["v"])
        interp[f"_i_{c}"] = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(pv.isNull(), nv["v"])
            .when(nv.isNull(), pv["v"])
            .otherwise(line)
        )
    s1 = s1.withColumns(kcols).withColumns(interp)
    specs2 = [(f"_v3_{c}", "last", F.when(F.col(f"_gk_{c}") == limit, F.col(f"_i_{c}"))) for c in cols]
    s2 = ordered_scan(s1, part, order, specs2, bucketed=True)
    final = {}
    for c in cols:
        gap_tail = F.col(f"_gk_{c}") > limit
        final[c] = F.when(F.col(c).isNull() & gap_tail & F.col(f"_nv_{c}").isNotNull() & F.col(f"_pv_{c}").isNotNull(), F.col(f"_v3_{c}")).otherwise(
            F.col(f"_i_{c}")
        )
    helper = [x for x in s2.columns if x.startswith(("_pv_", "_nv_", "_pp_", "_gk_", "_i_", "_v3_"))] + ["_pos", "_b"]
    out = s2.withColumns(final).drop(*helper)
    if residual == "median":
        out = cut_lineage(out)  # the residual statistics re-read it
        out = impute_constant(out, cols, "median")
    return out
