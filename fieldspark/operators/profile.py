"""Quality profile tables: null tables, describe, before/after summary, box plots, histograms.

Each is an aggregate over the whole table; wide inputs are handled in one pass by building one
aggregate expression per column and unpivoting the single result row with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators.quantiles import quantiles_with_stats
from fieldspark.session import cut_lineage

BOX_WHISKER = 1.5


def _lit_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unpivot(row_df: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """One-row frame with columns ``{field}{i}`` -> one row per name with columns ``fields``."""
    parts = []
    for i, n in enumerate(names):
        parts.append(_lit_str(n))
        parts += [f"`{f}{i}`" for f in fields]
    cols = ", ".join(["column"] + fields)
    return row_df.select(F.expr(f"stack({len(names)}, {', '.join(parts)}) as ({cols})"))


def null_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, null_count, null_pct) with the percentage rounded to 2 decimals."""
    cols = cols or df.columns
    aggs = []
    for i, c in enumerate(cols):
        isnull = F.col(c).isNull()
        aggs.append(F.count_if(isnull).cast("bigint").alias(f"null_count{i}"))
        aggs.append(F.round(F.avg(isnull.cast("double")) * 100.0, 2).alias(f"null_pct{i}"))
    return _unpivot(df.agg(*aggs), cols, ["null_count", "null_pct"])


def null_ratio_table(df: DataFrame, threshold: float = 0.5, cols: list[str] | None = None) -> DataFrame:
    """(column, null_ratio, dropped): the sparse-column decision (strictly above the threshold)."""
    cols = cols or df.columns
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(f"null_ratio{i}") for i, c in enumerate(cols)]
    out = _unpivot(df.agg(*aggs), cols, ["null_ratio"])
    return out.withColumn("dropped", F.col("null_ratio") > F.lit(float(threshold)))


def _text_tops(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """unique, top (ties: the least value) and freq of every text column: one aggregation of (column,
    value) pairs for all of them, which a task's partial counts shrink before the shuffle."""
    out: dict[str, dict] = {c: {"unique": 0, "top": None, "freq": None} for c in cols}
    if not cols:
        return out
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(each).alias("r")).where("r.value is not null").groupBy("r.column", "r.value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), best.alias("b")).collect():  # a row a column
        out[r["column"]] = {"unique": r["unique"], "top": r["b"]["value"], "freq": -r["b"]["neg"]}
    return out


def describe(df: DataFrame, cols: list[str] | None = None, digits: int = 3) -> DataFrame:
    """describe(include='all'): numeric columns get count/mean/std/min/quartiles/max, text
    columns count/unique/top/freq (most frequent value, ties to the smallest value)."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if isinstance(types[c], T.NumericType)]
    txt = [c for c in cols if c not in num]
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"n{i}"))
        if c in num:
            v = F.col(c).cast("double")
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    stats = {c: (row[f"n{cols.index(c)}"], row[f"mn{cols.index(c)}"], row[f"mx{cols.index(c)}"]) for c in num}
    q = quantiles_with_stats(df, {c: F.col(c) for c in num}, [0.25, 0.5, 0.75], stats)
    spark = df.sparkSession
    recs = []
    for i, c in enumerate(cols):
        rec = {"column": c, "count": row[f"n{i}"]}
        if c in num:
            vals = [row[f"m{i}"], row[f"s{i}"], row[f"mn{i}"]] + q[c] + [row[f"mx{i}"]]
            rec.update(zip(["mean", "std", "min", "p25", "p50", "p75", "max"], vals))
        recs.append(rec)
    for c, tops in _text_tops(df, txt).items():
        recs[cols.index(c)].update(tops)
    stat_names = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    schema = T.StructType(
        [T.StructField("column", T.StringType()), T.StructField("count", T.LongType()), T.StructField("unique", T.LongType())]
        + [T.StructField(k, T.DoubleType()) for k in stat_names]
        + [T.StructField("top", T.StringType()), T.StructField("freq", T.LongType())]
    )
    base = spark.createDataFrame([{k: r.get(k) for k in schema.names} for r in recs], schema)
    return base.select("column", "count", "unique", *[F.round(k, digits).alias(k) for k in stat_names], "top", "freq")


def before_after_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row/column counts before and after cleaning, rows removed and % removed (2 decimals)."""
    counts = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    agg = counts.agg(F.sum("b").cast("bigint").alias("rows_before"), F.sum("a").cast("bigint").alias("rows_after"))
    return agg.select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.lit(len(before.columns)).alias("cols_before"),
        F.lit(len(after.columns)).alias("cols_after"),
        F.round(F.coalesce(F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0, F.col("rows_before")), F.lit(0.0)), 2).alias(
            "pct_removed"
        ),
    )


def labelled_union(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    b = before.select(F.lit("before").alias("state"), *[F.col(c).cast("double").alias(c) for c in cols])
    a = after.select(F.lit("after").alias("state"), *[F.col(c).cast("double").alias(c) for c in cols])
    return b.unionByName(a)


def boxplot_stats(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Five-number box per (state, column): quartiles, whiskers at the furthest points within
    1.5 IQR of the box, and the number of fliers outside the whiskers."""
    u = cut_lineage(labelled_union(before, after, cols))  # 4 passes read it
    targets: dict[str, Column] = {}
    for st in ("before", "after"):
        for c in cols:
            targets[f"{st}|{c}"] = F.when(F.col("state") == st, F.col(c))
    aggs = []
    keys = list(targets)
    for i, k in enumerate(keys):
        aggs += [F.count(targets[k]).alias(f"n{i}"), F.min(targets[k]).alias(f"mn{i}"), F.max(targets[k]).alias(f"mx{i}")]
    row = u.agg(*aggs).first()
    stats = {k: (row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, k in enumerate(keys)}
    q = quantiles_with_stats(u, targets, [0.25, 0.5, 0.75], stats)
    aggs2 = []
    for i, k in enumerate(keys):
        q1, med, q3 = q[k]
        x = targets[k]
        if q1 is None:
            aggs2 += [F.lit(None).cast("double").alias(f"wl{i}"), F.lit(None).cast("double").alias(f"wh{i}"), F.lit(0).cast("bigint").alias(f"nf{i}")]
            continue
        lo, hi = q1 - BOX_WHISKER * (q3 - q1), q3 + BOX_WHISKER * (q3 - q1)
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggs2 += [
            F.min(F.when(inside, x)).alias(f"wl{i}"),
            F.max(F.when(inside, x)).alias(f"wh{i}"),
            F.count_if(x.isNotNull() & ~inside).cast("bigint").alias(f"nf{i}"),
        ]
    row2 = u.agg(*aggs2).first()
    recs = []
    for i, k in enumerate(keys):
        st, c = k.split("|", 1)
        q1, med, q3 = q[k]
        recs.append((st, c, q1, med, q3, row2[f"wl{i}"], row2[f"wh{i}"], int(row2[f"nf{i}"] or 0)))
    schema = "state string, column string, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, n_fliers bigint"
    return u.sparkSession.createDataFrame(recs, schema)


def histogram_before_after(before: DataFrame, after: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Fixed-width histogram per (column, state) over the column's combined [min, max]."""
    u = cut_lineage(labelled_union(before, after, cols))  # range pass + counts
    row = u.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    items = []
    for i, c in enumerate(cols):
        lo, hi = row[f"mn{i}"], row[f"mx{i}"]
        if lo is None:
            continue
        width = (hi - lo) if hi > lo else 1.0
        b = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width) * F.lit(float(bins))).cast("int") + 1, F.lit(bins))
        items.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), b.alias("bin"))))
    exploded = u.select("state", F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
    return exploded.groupBy(F.col("s.column").alias("column"), "state", F.col("s.bin").alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )


def raw_anomaly_counts(df: DataFrame, keys: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Duplicate keys and out-of-range cells on the raw table (one row)."""
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).cast("bigint").alias("duplicate_keys"),
    ]
    for c, (lo, hi) in bounds.items():
        aggs.append(F.count_if((F.col(c) < F.lit(float(lo))) | (F.col(c) > F.lit(float(hi)))).cast("bigint").alias(f"{c}_out_of_range"))
    return df.agg(*aggs)


# --- fixed values: column descriptions (name -> unit, description) ------------------------------
COLUMN_DESCRIPTIONS = {
    "temp": ("°C", "Temperatura media giornaliera"),
    "temperatura": ("°C", "Temperatura media giornaliera"),
    "humidity": ("%", "Umidità relativa aria"),
    "umidità": ("%", "Umidità relativa aria"),
    "rainfall": ("mm", "Precipitazione giornaliera"),
    "pioggia": ("mm", "Precipitazione giornaliera"),
    "ph": ("pH", "Acidità del suolo"),
    "yield": ("t/ha", "Resa colturale"),
    "resa": ("t/ha", "Resa colturale"),
    "n": ("kg/ha", "Concimazione azotata"),
    "azoto": ("kg/ha", "Concimazione azotata"),
    "soil_moisture": ("%", "Umidità del suolo"),
    "irrigation": ("mm", "Irrigazione applicata"),
    "organic_matter": ("%", "Sostanza organica del suolo"),
}
DEFAULT_DESCRIPTION_PREFIX = "Colonna "


def description_table(spark) -> DataFrame:
    rows = [(k, u, d) for k, (u, d) in COLUMN_DESCRIPTIONS.items()]
    return spark.createDataFrame(rows, "name string, unit string, description string")


def column_catalog(stats: DataFrame, name_col: str = "column") -> DataFrame:
    """Adds unit and description to a per-column table (left join on lower(name); the lookup is a
    fixed 14-row table, broadcast); unknown columns get an empty unit and 'Colonna <name>'."""
    desc = F.broadcast(description_table(stats.sparkSession))
    j = stats.join(desc, F.lower(stats[name_col]) == desc["name"], "left")
    return j.select(
        *[stats[c] for c in stats.columns],
        F.coalesce(desc["unit"], F.lit("")).alias("unit"),
        F.coalesce(desc["description"], F.concat(F.lit(DEFAULT_DESCRIPTION_PREFIX), stats[name_col])).alias("description"),
    )
