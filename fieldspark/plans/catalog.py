"""Query catalogue: one Spark callable and (where SQL can express it) one oracle SQL per key.

Every query reads the driver tables (through the ``obs`` / ``harvest`` views or directly), runs
over whole tables, and aliases every computed column identically on both sides.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators import dedup as D
from fieldspark.operators import impute as I
from fieldspark.operators import rules as R
from fieldspark.operators.gdd import gdd
from fieldspark.operators.lookup import few
from fieldspark.plans.clean import clean
from fieldspark.plans.config import CleanPlan
from fieldspark.plans.views import HARVEST_SQL, OBS_SQL, harvest, obs, with_ctes
from fieldspark.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --------------------------------------------------------------------------------------------
# full clean (flagship)

OBS_PLAN = CleanPlan(
    numeric_columns=("temp", "humidity"),
    categorical_columns=("crop",),
    date_columns=("date",),
    dedup_keys=("field_id", "day"),
    missing_strategy="median",
    outlier_method="iqr",
    physical_bounds={"temp": (-30.0, 60.0), "humidity": (0.0, 100.0)},
)

_CLEAN_CHAIN = (
    with_ctes(
        OBS_SQL,
        """c AS (
  SELECT rid, date, field_id, day, temp, humidity,
         COALESCE(crop,
           last_value(crop IGNORE NULLS) OVER (ORDER BY date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(crop IGNORE NULLS) OVER (ORDER BY date, rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS crop
  FROM obs)""",
        """b AS (
  SELECT rid, date, field_id, day, crop,
         CASE WHEN temp < -30.0 OR temp > 60.0 THEN NULL ELSE temp END AS temp,
         CASE WHEN humidity < 0.0 OR humidity > 100.0 THEN NULL ELSE humidity END AS humidity,
         CAST((temp < -30.0 OR temp > 60.0) IS TRUE AS INTEGER) + CAST((humidity < 0.0 OR humidity > 100.0) IS TRUE AS INTEGER) AS oob
  FROM c)""",
        """s AS (
  SELECT count(temp) AS nt, quantile_cont(temp, 0.25) AS t1, quantile_cont(temp, 0.75) AS t3,
         count(humidity) AS nh, quantile_cont(humidity, 0.25) AS h1, quantile_cont(humidity, 0.75) AS h3
  FROM b)""",
        """o AS (
  SELECT b.rid, b.date, b.field_id, b.day, b.crop, b.oob,
         CASE WHEN s.nt >= 10 AND (b.temp < s.t1 - 1.5 * (s.t3 - s.t1) OR b.temp > s.t3 + 1.5 * (s.t3 - s.t1)) THEN NULL ELSE b.temp END AS temp,
         CASE WHEN s.nh >= 10 AND (b.humidity < s.h1 - 1.5 * (s.h3 - s.h1) OR b.humidity > s.h3 + 1.5 * (s.h3 - s.h1)) THEN NULL ELSE b.humidity END AS humidity,
         CAST(s.nt >= 10 AND (b.temp < s.t1 - 1.5 * (s.t3 - s.t1) OR b.temp > s.t3 + 1.5 * (s.t3 - s.t1)) IS TRUE AS INTEGER)
         + CAST(s.nh >= 10 AND (b.humidity < s.h1 - 1.5 * (s.h3 - s.h1) OR b.humidity > s.h3 + 1.5 * (s.h3 - s.h1)) IS TRUE AS INTEGER) AS nout
  FROM b, s)""",
        """m AS (SELECT median(temp) AS mt, median(humidity) AS mh FROM o)""",
        """i AS (
  SELECT o.rid, o.date, o.field_id, o.day, o.crop, COALESCE(o.temp, m.mt) AS temp, COALESCE(o.humidity, m.mh) AS humidity
  FROM o, m)""",
        """d AS (SELECT *, row_number() OVER (PARTITION BY field_id, day ORDER BY rid DESC) AS rn FROM i)""",
    )
)


from fieldspark.streaming import incremental as INC  # noqa: E402
from fieldspark.streaming import state as ST  # noqa: E402

MERGED_PLAN = OBS_PLAN.with_(categorical_columns=(), missing_strategy="mean", outlier_method="zscore")


@register(
    "clean_merged_state",
    with_ctes(
        OBS_SQL,
        """b AS (SELECT rid, CASE WHEN temp < -30.0 OR temp > 60.0 THEN NULL ELSE temp END AS temp, CASE WHEN humidity < 0.0 OR humidity > 100.0 THEN NULL ELSE humidity END AS humidity FROM obs)""",
        """s AS (SELECT avg(temp) AS mt, stddev_samp(temp) AS st, avg(humidity) AS mh, stddev_samp(humidity) AS sh FROM b)""",
        """o AS (SELECT rid, CASE WHEN abs(temp - mt) / st > 3.0 THEN NULL ELSE temp END AS temp, CASE WHEN abs(humidity - mh) / sh > 3.0 THEN NULL ELSE humidity END AS humidity FROM b, s)""",
        """m AS (SELECT avg(temp) AS ft, avg(humidity) AS fh FROM o)""",
    )
    + "SELECT rid, ROUND(COALESCE(temp, ft), 6) AS temp, ROUND(COALESCE(humidity, fh), 6) AS humidity FROM o, m",
)
def q_clean_merged_state(spark, d):
    """Statistics of three batches, each read alone; their merged states clean all rows."""
    df = obs(spark, d)
    batches = [df.where(F.pmod("rid", F.lit(3)) == k) for k in range(3)]
    limits = ST.outliers_of(ST.merge_states(*[ST.raw_state(b, MERGED_PLAN) for b in batches]), MERGED_PLAN)
    frozen = ST.freeze_merged(ST.merge_states(*[ST.kept_state(b, MERGED_PLAN, limits) for b in batches]), MERGED_PLAN, limits)
    return INC.apply_frozen(df, frozen).select("rid", r6("temp").alias("temp"), r6("humidity").alias("humidity"))


@register("clean_full", _CLEAN_CHAIN + "SELECT rid, date, field_id, crop, temp, humidity, day FROM d WHERE rn = 1")
def q_clean_full(spark, d):
    return clean(obs(spark, d), OBS_PLAN).df


@register(
    "clean_diagnostics",
    _CLEAN_CHAIN
    + """
SELECT 'total_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM obs
UNION ALL SELECT 'out_of_bounds_removed', CAST(sum(oob) AS BIGINT) FROM b
UNION ALL SELECT 'agronomic_outliers_removed', CAST(0 AS BIGINT)
UNION ALL SELECT 'outliers_removed', CAST(sum(nout) AS BIGINT) FROM o
UNION ALL SELECT 'values_imputed', CAST(count(*) - count(temp) + count(*) - count(humidity) AS BIGINT) FROM o
UNION ALL SELECT 'duplicates_removed', CAST((SELECT count(*) FROM i) - (SELECT count(*) FROM d WHERE rn = 1) AS BIGINT)
""",
)
def q_clean_diagnostics(spark, d):
    return clean(obs(spark, d), OBS_PLAN).diagnostics


# --------------------------------------------------------------------------------------------
# predicates and rules (harvest view)


@register(
    "physical_bounds",
    with_ctes(HARVEST_SQL)
    + """
SELECT rid, field_id, date,
       CASE WHEN temp < 5.0 OR temp > 36.0 THEN NULL ELSE temp END AS temp,
       CASE WHEN ph < 5.0 OR ph > 6.5 THEN NULL ELSE ph END AS ph,
       yield,
       CAST((temp < 5.0 OR temp > 36.0) IS TRUE AS INTEGER) + CAST((ph < 5.0 OR ph > 6.5) IS TRUE AS INTEGER) AS n_out_of_bounds
FROM harvest""",
)
def q_physical_bounds(spark, d):
    out = R.physical_bounds(harvest(spark, d), {"temp": (5.0, 36.0), "ph": (5.0, 6.5)}, flag="n_out_of_bounds")
    return out.select("rid", "field_id", "date", "temp", "ph", "yield", "n_out_of_bounds")


@register(
    "agronomic_rules",
    with_ctes(HARVEST_SQL)
    + """
SELECT rid, field_id, date,
       CASE WHEN yield > 30.0 THEN NULL WHEN yield > 0 AND month(date) NOT IN (9, 10) THEN NULL ELSE yield END AS yield,
       CAST(yield > 30.0 AS INTEGER) + CAST(yield <= 30.0 AND yield > 0 AND month(date) NOT IN (9, 10) AS INTEGER) AS n_agronomic
FROM harvest""",
)
def q_agronomic_rules(spark, d):
    out = R.agronomic_rules(harvest(spark, d), 30.0, [9, 10], soft=False, flag="n_agronomic")
    return out.select("rid", "field_id", "date", "yield", "n_agronomic")


@register(
    "soft_confidence",
    with_ctes(
        HARVEST_SQL,
        """s AS (SELECT quantile_cont(yield, 0.25) AS y1, quantile_cont(yield, 0.75) AS y3,
                 quantile_cont(ph, 0.25) AS p1, quantile_cont(ph, 0.75) AS p3,
                 quantile_cont(temp, 0.25) AS t1, quantile_cont(temp, 0.75) AS t3 FROM harvest)""",
    )
    + """
SELECT rid, yield, ph, temp,
       ROUND(CAST(1.0
         * CASE WHEN yield > 30.0 THEN 0.3 ELSE 1.0 END
         * CASE WHEN yield > 0 AND month(date) NOT IN (9, 10) THEN 0.1 ELSE 1.0 END
         * CASE WHEN yield < y1 - 1.5 * (y3 - y1) OR yield > y3 + 1.5 * (y3 - y1) THEN 0.5 ELSE 1.0 END
         * CASE WHEN ph < p1 - 1.5 * (p3 - p1) OR ph > p3 + 1.5 * (p3 - p1) THEN 0.5 ELSE 1.0 END
         * CASE WHEN temp < t1 - 1.5 * (t3 - t1) OR temp > t3 + 1.5 * (t3 - t1) THEN 0.5 ELSE 1.0 END AS DOUBLE), 6) AS confidence
FROM harvest, s""",
)
def q_soft_confidence(spark, d):
    h = R.init_confidence(harvest(spark, d), True)
    h = R.agronomic_rules(h, 30.0, [9, 10], soft=True)
    st = R.fit_outliers(h, ["yield", "ph", "temp"], "iqr", 1.5)
    h = R.apply_outliers(h, st, soft=True)
    return h.select("rid", "yield", "ph", "temp", r6("confidence").alias("confidence"))


@register(
    "outlier_iqr",
    with_ctes(
        OBS_SQL,
        """s AS (SELECT quantile_cont(temp, 0.25) AS t1, quantile_cont(temp, 0.75) AS t3,
                 quantile_cont(humidity, 0.25) AS h1, quantile_cont(humidity, 0.75) AS h3 FROM obs)""",
    )
    + """
SELECT rid,
       CASE WHEN temp < t1 - 1.5 * (t3 - t1) OR temp > t3 + 1.5 * (t3 - t1) THEN NULL ELSE temp END AS temp,
       CASE WHEN humidity < h1 - 1.5 * (h3 - h1) OR humidity > h3 + 1.5 * (h3 - h1) THEN NULL ELSE humidity END AS humidity
FROM obs, s""",
)
def q_outlier_iqr(spark, d):
    o = obs(spark, d)
    st = R.fit_outliers(o, ["temp", "humidity"], "iqr", 1.5)
    return R.apply_outliers(o, st).select("rid", "temp", "humidity")


# temp is Inf on some rows and -Inf on fewer: both are outermost ranks and outside the limits
NONFINITE_SQL = """inf_obs AS (
  SELECT rid, CASE WHEN rid % 50 = 7 THEN 'infinity'::DOUBLE WHEN rid % 90 = 8 THEN '-infinity'::DOUBLE ELSE temp END AS temp
  FROM obs)"""


@register(
    "outlier_iqr_nonfinite",
    with_ctes(OBS_SQL, NONFINITE_SQL, "s AS (SELECT quantile_cont(temp, 0.25) AS t1, quantile_cont(temp, 0.75) AS t3 FROM inf_obs)")
    + """
SELECT rid, CASE WHEN temp < t1 - 1.5 * (t3 - t1) OR temp > t3 + 1.5 * (t3 - t1) THEN NULL ELSE temp END AS temp
FROM inf_obs, s""",
)
def q_outlier_iqr_nonfinite(spark, d):
    inf = float("inf")
    temp = F.when(F.col("rid") % 50 == 7, F.lit(inf)).when(F.col("rid") % 90 == 8, F.lit(-inf)).otherwise(F.col("temp"))
    o = obs(spark, d).select("rid", temp.alias("temp"))
    return R.apply_outliers(o, R.fit_outliers(o, ["temp"], "iqr", 1.5)).select("rid", "temp")


@register(
    "outlier_zscore",
    with_ctes(
        HARVEST_SQL,
        """s AS (SELECT avg(yield) AS my, stddev_samp(yield) AS sy, avg(ph) AS mp, stddev_samp(ph) AS sp,
                 avg(temp) AS mt, stddev_samp(temp) AS st FROM harvest)""",
    )
    + """
SELECT rid,
       CASE WHEN abs(yield - my) / sy > 3.0 THEN NULL ELSE yield END AS yield,
       CASE WHEN abs(ph - mp) / sp > 3.0 THEN NULL ELSE ph END AS ph,
       CASE WHEN abs(temp - mt) / st > 3.0 THEN NULL ELSE temp END AS temp
FROM harvest, s""",
)
def q_outlier_zscore(spark, d):
    h = harvest(spark, d)
    st = R.fit_outliers(h, ["yield", "ph", "temp"], "zscore")
    return R.apply_outliers(h, st).select("rid", "yield", "ph", "temp")


# --------------------------------------------------------------------------------------------
# imputation (obs view)


@register(
    "impute_mean",
    with_ctes(OBS_SQL, "m AS (SELECT avg(temp) AS mt, avg(humidity) AS mh FROM obs)")
    + "SELECT rid, ROUND(COALESCE(temp, mt), 6) AS temp, ROUND(COALESCE(humidity, mh), 6) AS humidity FROM obs, m",
)
def q_impute_mean(spark, d):
    o = I.impute_constant(obs(spark, d), ["temp", "humidity"], "mean")
    return o.select("rid", r6("temp").alias("temp"), r6("humidity").alias("humidity"))


@register(
    "impute_median",
    with_ctes(OBS_SQL, "m AS (SELECT median(temp) AS mt, median(humidity) AS mh FROM obs)")
    + "SELECT rid, COALESCE(temp, mt) AS temp, COALESCE(humidity, mh) AS humidity FROM obs, m",
)
def q_impute_median(spark, d):
    return I.impute_constant(obs(spark, d), ["temp", "humidity"], "median").select("rid", "temp", "humidity")


@register(
    "impute_drop",
    with_ctes(OBS_SQL) + "SELECT rid, temp, humidity FROM obs WHERE temp IS NOT NULL AND humidity IS NOT NULL",
)
def q_impute_drop(spark, d):
    return I.impute_drop(obs(spark, d), ["temp", "humidity"]).select("rid", "temp", "humidity")


@register(
    "impute_ffill",
    with_ctes(OBS_SQL)
    + """
SELECT rid,
  COALESCE(temp,
    last_value(temp IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(temp IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temp,
  COALESCE(humidity,
    last_value(humidity IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(humidity IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS humidity
FROM obs""",
)
def q_impute_ffill(spark, d):
    return I.impute_ffill(obs(spark, d), ["temp", "humidity"], ["rid"]).select("rid", "temp", "humidity")


@register(
    "impute_categorical",
    with_ctes(OBS_SQL)
    + """
SELECT rid, date,
  COALESCE(crop,
    last_value(crop IGNORE NULLS) OVER (ORDER BY date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(crop IGNORE NULLS) OVER (ORDER BY date, rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS crop
FROM obs""",
)
def q_impute_categorical(spark, d):
    return I.impute_categorical(obs(spark, d), ["crop"], "date", "rid").select("rid", "date", "crop")


def _time_sql(col: str) -> str:
    w = "PARTITION BY field_id ORDER BY date, rid"
    return f"""
  t_{col}_1 AS (
    SELECT *,
      last_value(CASE WHEN {col} IS NOT NULL THEN {col} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv_{col},
      last_value(CASE WHEN {col} IS NOT NULL THEN epoch_us(date) END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt_{col},
      first_value(CASE WHEN {col} IS NOT NULL THEN {col} END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv_{col},
      first_value(CASE WHEN {col} IS NOT NULL THEN epoch_us(date) END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt_{col},
      row_number() OVER ({w}) AS pos_{col},
      count({col}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g_{col}
    FROM {{src}}),
  t_{col}_2 AS (
    SELECT *,
      row_number() OVER (PARTITION BY field_id, g_{col} ORDER BY date, rid) - 1 AS k_{col},
      CASE WHEN {col} IS NOT NULL THEN {col}
           WHEN pv_{col} IS NULL THEN nv_{col}
           WHEN nv_{col} IS NULL THEN pv_{col}
           WHEN nt_{col} = pt_{col} THEN pv_{col}
           ELSE pv_{col} + (nv_{col} - pv_{col}) * (CAST(epoch_us(date) - pt_{col} AS DOUBLE) / CAST(nt_{col} - pt_{col} AS DOUBLE)) END AS i_{col}
    FROM t_{col}_1),
  t_{col}_3 AS (
    SELECT *,
      CASE WHEN {col} IS NULL AND g_{col} > 0 AND k_{col} > 3 AND nv_{col} IS NOT NULL
           THEN max(CASE WHEN k_{col} = 3 THEN i_{col} END) OVER (PARTITION BY field_id, g_{col})
           ELSE i_{col} END AS f_{col}
    FROM t_{col}_2)"""


_IMPUTE_TIME_SQL = (
    "WITH "
    + OBS_SQL
    + ","
    + _time_sql("temp").replace("{src}", "obs")
    + ","
    + _time_sql("humidity").replace("{src}", "t_temp_3")
    + """,
  med AS (SELECT median(f_temp) AS mt, median(f_humidity) AS mh FROM t_humidity_3)
SELECT rid, field_id, date, COALESCE(f_temp, mt) AS temp, COALESCE(f_humidity, mh) AS humidity
FROM t_humidity_3, med"""
)


@register("impute_time", _IMPUTE_TIME_SQL)
def q_impute_time(spark, d):
    return I.impute_time(obs(spark, d), ["temp", "humidity"], "date", "field_id", "rid").select(
        "rid", "field_id", "date", "temp", "humidity"
    )


# --------------------------------------------------------------------------------------------
# de-duplication, GDD


@register(
    "dedup_keep_last",
    with_ctes(OBS_SQL)
    + """
SELECT rid, date, field_id, crop, temp, humidity, day FROM (
  SELECT *, row_number() OVER (PARTITION BY field_id, day ORDER BY rid DESC) AS rn FROM obs) WHERE rn = 1""",
)
def q_dedup_keep_last(spark, d):
    return D.dedup_keep_last(obs(spark, d), ["field_id", "day"], "rid")


@register(
    "dedup_all_columns",
    with_ctes(HARVEST_SQL) + "SELECT field_id, crop, yield, max(rid) AS rid FROM harvest GROUP BY field_id, crop, yield",
)
def q_dedup_all_columns(spark, d):
    return D.dedup_all_columns(harvest(spark, d).select("rid", "field_id", "crop", "yield"), "rid")


@register(
    "gdd",
    with_ctes(OBS_SQL)
    + """
SELECT rid, field_id, date, ROUND(gdd_daily, 6) AS gdd_daily,
       ROUND(sum(gdd_daily) OVER (PARTITION BY field_id ORDER BY date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS gdd_accumulated
FROM (SELECT *, greatest(0.0, COALESCE(temp - 10.0, 0.0)) AS gdd_daily FROM obs)""",
)
def q_gdd(spark, d):
    out = gdd(obs(spark, d), 10.0, "temp", "date", "field_id", "rid")
    return out.select("rid", "field_id", "date", r6("gdd_daily").alias("gdd_daily"), r6("gdd_accumulated").alias("gdd_accumulated"))


# --------------------------------------------------------------------------------------------
# quality profile

from fieldspark.operators import profile as P  # noqa: E402

_OBS_COLS = ["rid", "date", "field_id", "crop", "temp", "humidity", "day"]


def _null_sql(cols: list[str], src: str) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"ROUND(avg(CAST({c} IS NULL AS DOUBLE)) * 100.0, 2) AS null_pct FROM {src}"
        for c in cols
    ]
    return "\nUNION ALL ".join(parts)


@register("null_table", with_ctes(OBS_SQL) + _null_sql(_OBS_COLS, "obs"))
def q_null_table(spark, d):
    return P.null_table(obs(spark, d))


@register(
    "null_ratio",
    with_ctes(OBS_SQL)
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(CAST({c} IS NULL AS DOUBLE)) AS null_ratio, avg(CAST({c} IS NULL AS DOUBLE)) > 0.5 AS dropped FROM obs"
        for c in _OBS_COLS
    ),
)
def q_null_ratio(spark, d):
    return P.null_ratio_table(obs(spark, d), 0.5)


_DESCRIBE_NUM = ["yield", "ph", "temp"]


def _describe_sql() -> str:
    parts = []
    for c in _DESCRIBE_NUM:
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, CAST(NULL AS BIGINT) AS "unique",
  ROUND(avg({c}), 3) AS mean, ROUND(stddev_samp({c}), 3) AS std, ROUND(min({c}), 3) AS min,
  ROUND(quantile_cont({c}, 0.25), 3) AS p25, ROUND(quantile_cont({c}, 0.5), 3) AS p50, ROUND(quantile_cont({c}, 0.75), 3) AS p75,
  ROUND(max({c}), 3) AS max, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM harvest"""
        )
    parts.append(
        """SELECT 'crop', count(crop), count(DISTINCT crop), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  (SELECT crop FROM harvest WHERE crop IS NOT NULL GROUP BY crop ORDER BY count(*) DESC, crop LIMIT 1),
  (SELECT count(*) FROM harvest WHERE crop IS NOT NULL GROUP BY crop ORDER BY count(*) DESC, crop LIMIT 1) FROM harvest"""
    )
    return with_ctes(HARVEST_SQL) + "\nUNION ALL ".join(parts)


@register("describe_table", _describe_sql())
def q_describe_table(spark, d):
    return P.describe(harvest(spark, d).select(*_DESCRIBE_NUM, "crop"), digits=3)


_BEFORE_AFTER_SQL = (
    _CLEAN_CHAIN.rstrip()
    + """,
u AS (SELECT 'before' AS state, temp, humidity FROM obs UNION ALL SELECT 'after', temp, humidity FROM d WHERE rn = 1),
l AS (UNPIVOT u ON temp, humidity INTO NAME "column" VALUE v)
"""
)


@register(
    "before_after_summary",
    _CLEAN_CHAIN
    + """
SELECT rb AS rows_before, ra AS rows_after, rb - ra AS rows_removed, 7 AS cols_before, 7 AS cols_after,
       ROUND(CAST(rb - ra AS DOUBLE) * 100.0 / rb, 2) AS pct_removed
FROM (SELECT (SELECT count(*) FROM obs) AS rb, (SELECT count(*) FROM d WHERE rn = 1) AS ra)""",
)
def q_before_after_summary(spark, d):
    before = obs(spark, d)
    return P.before_after_summary(before, clean(before, OBS_PLAN).df)


@register(
    "boxplot_stats",
    _BEFORE_AFTER_SQL
    + """, q AS (SELECT state, "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM l GROUP BY state, "column")
SELECT q.state, q."column", q1, median, q3,
       min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_lo,
       max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       CAST(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_fliers
FROM q JOIN l ON q.state = l.state AND q."column" = l."column"
GROUP BY q.state, q."column", q1, median, q3""",
)
def q_boxplot_stats(spark, d):
    before = obs(spark, d)
    return P.boxplot_stats(before, clean(before, OBS_PLAN).df, ["temp", "humidity"])


@register(
    "histogram_before_after",
    _BEFORE_AFTER_SQL
    + """, mm AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM l GROUP BY "column")
SELECT l."column", state,
       least(CAST(floor((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) * 20.0) AS INTEGER) + 1, 20) AS bin,
       CAST(count(*) AS BIGINT) AS n
FROM l JOIN mm ON l."column" = mm."column"
GROUP BY ALL""",
)
def q_histogram_before_after(spark, d):
    before = obs(spark, d)
    return P.histogram_before_after(before, clean(before, OBS_PLAN).df, ["temp", "humidity"], 20)


from fieldspark.operators import density as DE  # noqa: E402


@register(
    "density_before_after",
    _BEFORE_AFTER_SQL
    + f""", fit AS (SELECT state, "column", count(*) AS n, stddev_samp(v) * power(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM l GROUP BY state, "column"),
g AS (SELECT *, lo - {DE.CUT} * h AS x0, (hi - lo + {2 * DE.CUT} * h) / {DE.GRID - 1} AS step FROM fit),
pl AS (SELECT l.state, l."column", (v - x0) / step AS u, least(CAST(floor((v - x0) / step) AS INTEGER), {DE.GRID - 2}) AS i FROM l JOIN g ON l.state = g.state AND l."column" = g."column"),
w AS (SELECT state, "column", i, sum(w) AS w FROM (SELECT state, "column", i, 1 - (u - i) AS w FROM pl UNION ALL SELECT state, "column", i + 1, u - i FROM pl) GROUP BY ALL)
SELECT g.state, g."column", CAST(p AS INTEGER) AS point, ROUND(x0 + p * step, 6) AS x,
       ROUND(sum(w * exp(-power((p - i) * step / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density
FROM g JOIN w ON g.state = w.state AND g."column" = w."column", range({DE.GRID}) r(p) GROUP BY g.state, g."column", p, x0, step, n, h""",
)
def q_density_before_after(spark, d):
    before = obs(spark, d)
    out = DE.density_before_after(before, clean(before, OBS_PLAN).df, ["temp", "humidity"])
    return out.select("state", "column", "point", r6("x").alias("x"), F.round("density", 8).alias("density"))


@register(
    "raw_anomaly_counts",
    with_ctes(HARVEST_SQL)
    + """
SELECT CAST(count(*) AS BIGINT) AS "rows",
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT field_id, date FROM harvest)) AS BIGINT) AS duplicate_keys,
       CAST(count(*) FILTER (WHERE temp < 5.0 OR temp > 36.0) AS BIGINT) AS temp_out_of_range,
       CAST(count(*) FILTER (WHERE ph < 5.0 OR ph > 6.5) AS BIGINT) AS ph_out_of_range
FROM harvest""",
)
def q_raw_anomaly_counts(spark, d):
    return P.raw_anomaly_counts(harvest(spark, d), ["field_id", "date"], {"temp": (5.0, 36.0), "ph": (5.0, 6.5)})


# --------------------------------------------------------------------------------------------
# features, split, model statistics

from fieldspark.operators import features as FE  # noqa: E402
from fieldspark.operators import model as MO  # noqa: E402
from fieldspark.operators import split as SP  # noqa: E402

_FEAT = ["yield", "ph", "temp"]
_EPS = "2.220446049250313e-15"  # 10 * float epsilon: a smaller scale is treated as 0 -> 1


def _std_sql(cols: list[str]) -> str:
    return "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols) + " FROM harvest)"


def _scaled(c: str) -> str:
    return f"(({c} - m_{c}) / (CASE WHEN s_{c} < {_EPS} THEN 1.0 ELSE s_{c} END))"


@register(
    "scale_standard",
    with_ctes(HARVEST_SQL, _std_sql(_FEAT)) + "SELECT rid, " + ", ".join(f"ROUND({_scaled(c)}, 6) AS {c}" for c in _FEAT) + " FROM harvest, s",
)
def q_scale_standard(spark, d):
    h = harvest(spark, d)
    out = FE.apply_scaler(h, FE.fit_scaler(h, _FEAT, "standard"))
    return out.select("rid", *[r6(c).alias(c) for c in _FEAT])


def _robust_sql(cols: list[str]) -> str:
    return (
        "s AS (SELECT "
        + ", ".join(
            f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in cols
        )
        + " FROM harvest)"
    )


@register(
    "scale_robust",
    with_ctes(HARVEST_SQL, _robust_sql(_FEAT)) + "SELECT rid, " + ", ".join(f"ROUND({_scaled(c)}, 6) AS {c}" for c in _FEAT) + " FROM harvest, s",
)
def q_scale_robust(spark, d):
    h = harvest(spark, d)
    out = FE.apply_scaler(h, FE.fit_scaler(h, _FEAT, "robust"))
    return out.select("rid", *[r6(c).alias(c) for c in _FEAT])


@register(
    "scaler_params",
    with_ctes(HARVEST_SQL, _std_sql(_FEAT))
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'standard' AS type, ROUND(m_{c}, 6) AS center, "
        f"ROUND(CASE WHEN s_{c} < {_EPS} THEN 1.0 ELSE s_{c} END, 6) AS scale FROM s"
        for c in _FEAT
    ),
)
def q_scaler_params(spark, d):
    h = harvest(spark, d)
    t = FE.scaler_table(spark, FE.fit_scaler(h, _FEAT, "standard"))
    return t.select("column", "type", r6("center").alias("center"), r6("scale").alias("scale"))


@register(
    "label_encode",
    with_ctes(HARVEST_SQL)
    + """
SELECT rid, crop, field_id,
       CAST(dense_rank() OVER (ORDER BY COALESCE(crop, 'nan')) - 1 AS INTEGER) AS crop_code,
       CAST(dense_rank() OVER (ORDER BY COALESCE(field_id, 'nan')) - 1 AS INTEGER) AS field_id_code
FROM harvest""",
)
def q_label_encode(spark, d):
    return FE.label_encode(harvest(spark, d), ["crop", "field_id"]).select("rid", "crop", "field_id", "crop_code", "field_id_code")


@register(
    "label_encode_skewed",
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'hot' WHEN event_id % 101 = 0 THEN NULL ELSE event_type || ':' || event_id END AS tag FROM events)
SELECT event_id, tag, CAST(dense_rank() OVER (ORDER BY COALESCE(tag, 'nan')) - 1 AS INTEGER) AS tag_code FROM v""",
)
def q_label_encode_skewed(spark, d):
    """One value on half of all rows, and about as many others as there are rows."""
    e = F.col("event_id")
    tag = F.when(e % 2 == 0, "hot").when(e % 101 == 0, None).otherwise(F.concat_ws(":", "event_type", "event_id"))
    return FE.label_encode_skewed(spark.read.parquet(f"{d}/events.parquet").select("event_id", tag.alias("tag")), ["tag"])


@register(
    "onehot_encode",
    with_ctes(HARVEST_SQL)
    + "SELECT rid, "
    + ", ".join(f"CAST(COALESCE(crop, 'nan') = '{v}' AS DOUBLE) AS crop_{v}" for v in ("A", "N", "R"))
    + " FROM harvest",
)
def q_onehot_encode(spark, d):
    out, names = FE.onehot_encode(harvest(spark, d), ["crop"])
    return out.select("rid", *names)


@register(
    "feature_matrix",
    with_ctes(HARVEST_SQL, _std_sql(["ph", "temp"]))
    + f"""
SELECT rid,
       [CAST({_scaled('ph')} AS FLOAT), CAST({_scaled('temp')} AS FLOAT),
        CAST(dense_rank() OVER (ORDER BY COALESCE(crop, 'nan')) - 1 AS FLOAT)] AS features,
       CAST(yield AS FLOAT) AS target
FROM harvest, s""",
)
def q_feature_matrix(spark, d):
    spec = FE.FeatureSpec(numeric=["ph", "temp"], categorical=["crop"], target="yield")
    return FE.feature_matrix(harvest(spark, d), spec, "rid")[0]


@register(
    "finite_check",
    with_ctes(OBS_SQL)
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c}) OR isinf({c})) AS BIGINT) AS n_nonfinite FROM obs"
        for c in ("temp", "humidity")
    ),
)
def q_finite_check(spark, d):
    return FE.nonfinite_counts(obs(spark, d), ["temp", "humidity"])


def _tokens_spark(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


@register(
    "schema_hash",
    """
SELECT doc_id, substr(sha256(array_to_string(list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')), ',')), 1, 16) AS schema_hash
FROM documents""",
)
def q_schema_hash(spark, d):
    # each document's token list is its "column catalogue": the order-insensitive lock hash is a
    # per-row expression over the whole text (no shuffle); ``schema_hash_by_group`` is the form
    # for catalogues that arrive as (group, column) rows
    docs = spark.read.parquet(f"{d}/documents.parquet")
    from fieldspark.functions.columns import schema_hash

    return docs.select("doc_id", schema_hash(_tokens_spark(F.col("text"))).alias("schema_hash"))


_SPLIT_CTE = """ranked AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS p,
         count(*) OVER () AS n FROM orders),
thr AS (SELECT DISTINCT n, floor(CAST(0.7 AS DOUBLE) * n) AS nt FROM ranked),
thr2 AS (SELECT n, nt, floor((CAST(0.2 AS DOUBLE) / (CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE))) * (n - nt)) AS nv FROM thr),
labelled AS (
  SELECT o_orderkey, CASE WHEN p <= nt THEN 'train' WHEN p <= nt + nv THEN 'val' ELSE 'test' END AS split
  FROM ranked, thr2)"""


def _orders_split(spark, d):
    return SP.split_exact(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey", (0.7, 0.2, 0.1), 42)


@register("split_exact", "WITH " + _SPLIT_CTE + "\nSELECT o_orderkey, split FROM labelled")
def q_split_exact(spark, d):
    return _orders_split(spark, d)


@register(
    "split_counts",
    "WITH " + _SPLIT_CTE + "\nSELECT split, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY split "
    "UNION ALL SELECT 'total', CAST(count(*) AS BIGINT) FROM labelled",
)
def q_split_counts(spark, d):
    return SP.split_counts(_orders_split(spark, d))


@register(
    "feature_stats",
    with_ctes(HARVEST_SQL, _std_sql(_FEAT), "z AS (SELECT " + ", ".join(f"{_scaled(c)} AS {c}" for c in _FEAT) + " FROM harvest, s)")
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", ROUND(avg({c}), 6) + 0.0 AS mean, ROUND(stddev_pop({c}), 6) + 0.0 AS std, "
        f"ROUND(min({c}), 6) + 0.0 AS min, ROUND(max({c}), 6) + 0.0 AS max FROM z"
        for c in _FEAT
    ),
)
def q_feature_stats(spark, d):
    h = harvest(spark, d)
    z = FE.apply_scaler(h, FE.fit_scaler(h, _FEAT, "standard"))
    st = MO.feature_stats(z, _FEAT)
    return st.select("column", *[(r6(c) + F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max")])


@register(
    "correlation_matrix",
    with_ctes(HARVEST_SQL)
    + "\nUNION ALL ".join(
        f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, ROUND(corr({a}, {b}), 6) + 0.0 AS corr FROM harvest" for a in _FEAT for b in _FEAT
    ),
)
def q_correlation_matrix(spark, d):
    c = MO.correlation_matrix(harvest(spark, d), _FEAT)
    return c.select("feature_i", "feature_j", (r6("corr") + F.lit(0.0)).alias("corr"))


from fieldspark.operators import sparse as SR  # noqa: E402


@register(
    "ridge_sparse",
    with_ctes(
        HARVEST_SQL,
        "c AS (SELECT COALESCE(field_id, 'nan') AS value, count(*) AS n, avg(yield) AS y FROM harvest WHERE yield IS NOT NULL GROUP BY 1)",
        "b AS (SELECT sum(n / (n + 1.0) * y) / sum(n / (n + 1.0)) AS b FROM c)",
    )
    + """SELECT 'field_id' AS "column", value, ROUND(n * (y - b) / (n + 1.0), 6) + 0.0 AS weight FROM c, b
UNION ALL SELECT NULL, NULL, ROUND(b, 6) FROM b""",
)
def q_ridge_sparse(spark, d):
    """Yield by plot: for one encoded column the ridge weights are known in closed form."""
    h = harvest(spark, d)
    cats = FE.category_table(h, ["field_id"])
    rows = FE.onehot_sparse(h, ["field_id"], cats)
    out = SR.ridge_weights(rows.where("yield is not null"), cats.select("column", "value", F.col("code").alias("slot")), "onehot_indices", "yield")
    return out.select("column", "value", (r6("weight") + F.lit(0.0)).alias("weight"))


from fieldspark.operators import gram as GR  # noqa: E402

_WIDE = [f"f{k}" for k in range(40)]
_WIDE_SQL = ", ".join(f"CAST((l_partkey * {7 * k + 3} + l_linenumber * {k}) % {11 + k} AS DOUBLE) + l_quantity * {k % 5} AS f{k}" for k in range(40))


@register(
    "correlation_blocks",
    f"WITH w AS (SELECT {_WIDE_SQL} FROM lineitem), c AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a in _WIDE for b in _WIDE if a <= b)
    + " FROM w), l AS (UNPIVOT c ON COLUMNS(*) INTO NAME k VALUE corr), s AS (SELECT string_split(k, '_') AS k, ROUND(corr, 6) + 0.0 AS corr FROM l)\n"
    "SELECT k[1] AS feature_i, k[2] AS feature_j, corr FROM s UNION ALL SELECT k[2], k[1], corr FROM s WHERE k[1] <> k[2]",
)
def q_correlation_blocks(spark, d):
    """40 features of the line items, in blocks of 16 columns."""
    wide = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*_WIDE_SQL.split(", "))
    c = GR.correlation_table(wide, _WIDE, block=16)
    return c.select("feature_i", "feature_j", (r6("corr") + F.lit(0.0)).alias("corr"))


_RIDGE_SQL = with_ctes(
    HARVEST_SQL,
    _std_sql(["ph", "temp"]),
    """ranked AS (SELECT rid, yield AS y, """ + _scaled("ph") + """ AS x1, """ + _scaled("temp") + """ AS x2,
        row_number() OVER (ORDER BY md5('42:' || CAST(rid AS VARCHAR)), rid) AS p, count(*) OVER () AS n FROM harvest, s)""",
    """thr AS (SELECT DISTINCT n, floor(CAST(0.7 AS DOUBLE) * n) AS nt FROM ranked)""",
    """thr2 AS (SELECT n, nt, floor((CAST(0.2 AS DOUBLE) / (CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE))) * (n - nt)) AS nv FROM thr)""",
    """z AS (SELECT y, x1, x2, CASE WHEN p <= nt THEN 'train' WHEN p <= nt + nv THEN 'val' ELSE 'test' END AS split FROM ranked, thr2)""",
    """t AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
               sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y
        FROM z WHERE split = 'train')""",
    """a AS (SELECT n, m1, m2, my, s11 - n * m1 * m1 + 1.0 AS a11, s12 - n * m1 * m2 AS a12, s22 - n * m2 * m2 + 1.0 AS a22,
               s1y - n * m1 * my AS b1, s2y - n * m2 * my AS b2 FROM t)""",
    """w AS (SELECT n, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2,
               m1, m2, my FROM a)""",
) + """SELECT ROUND(avg(power(y - (my - m1 * w1 - m2 * w2 + w1 * x1 + w2 * x2), 2)), 6) AS baseline_mse,
       CAST(max(w.n) AS BIGINT) AS n_train, CAST(count(*) AS BIGINT) AS n_val
FROM z, w WHERE split = 'val'"""


@register("ridge_baseline", _RIDGE_SQL)
def q_ridge_baseline(spark, d):
    h = harvest(spark, d)
    z = FE.apply_scaler(h, FE.fit_scaler(h, ["ph", "temp"], "standard"))
    z = cut_lineage(SP.split_exact(z.select("rid", "ph", "temp", "yield"), "rid", (0.7, 0.2, 0.1), 42))
    out = MO.ridge_baseline(z, ["ph", "temp"], "yield", "split")
    return out.select(r6("baseline_mse").alias("baseline_mse"), "n_train", "n_val")


# --------------------------------------------------------------------------------------------
# presets, column catalogue

from fieldspark.operators import units as U  # noqa: E402
from fieldspark.operators import corrupt as CO  # noqa: E402
from fieldspark.plans.views import table  # noqa: E402
from fieldspark.sources import presets as PR  # noqa: E402
from fieldspark.plans.clean import coerce  # noqa: E402
from fieldspark.functions.columns import normalise_date  # noqa: E402

_FLAG_PRESET = [("A", "riso_novarese"), ("N", "mais_cuneese_irriguo"), ("R", "vite_nebbiolo_barolo")]


def _presets_values_sql() -> str:
    rows = []
    for r in PR.preset_records():
        name, region, crop, _disp, _z, _s, mx, tlo, thi, plo, phi, months, _sal, _tb = r
        rows.append(
            f"('{name}', '{region}', CAST({mx} AS DOUBLE), CAST({tlo} AS DOUBLE), CAST({thi} AS DOUBLE), "
            f"CAST({plo} AS DOUBLE), CAST({phi} AS DOUBLE), {list(months)})"
        )
    return "p(name, region, max_yield, temp_lo, temp_hi, ph_lo, ph_hi, months) AS (VALUES " + ", ".join(rows) + ")"


_MAP_SQL = "m(flag, preset) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _FLAG_PRESET) + ")"


def _harvest_with_preset(spark, d):
    m = spark.createDataFrame(_FLAG_PRESET, "flag string, preset string")
    h = harvest(spark, d)
    return h.join(F.broadcast(m), h["crop"] == m["flag"], "left").drop("flag")


@register(
    "preset_rules_join",
    with_ctes(HARVEST_SQL, _presets_values_sql(), _MAP_SQL)
    + """
SELECT rid, m.preset,
       CASE WHEN temp < temp_lo OR temp > temp_hi THEN NULL ELSE temp END AS temp,
       CASE WHEN ph < ph_lo OR ph > ph_hi THEN NULL ELSE ph END AS ph,
       CASE WHEN yield > max_yield THEN NULL
            WHEN yield > 0 AND len(months) > 0 AND NOT list_contains(months, CAST(month(date) AS INTEGER)) THEN NULL
            ELSE yield END AS yield
FROM harvest LEFT JOIN m ON harvest.crop = m.flag LEFT JOIN p ON m.preset = p.name""",
)
def q_preset_rules_join(spark, d):
    out = PR.apply_preset_rules(_harvest_with_preset(spark, d), PR.presets_table(spark), "preset")
    return out.select("rid", "preset", "temp", "ph", "yield")


@register(
    "list_presets",
    with_ctes(HARVEST_SQL, _presets_values_sql(), _MAP_SQL)
    + """
SELECT region, list_sort(list(DISTINCT p.name)) AS presets, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest JOIN m ON harvest.crop = m.flag JOIN p ON m.preset = p.name
GROUP BY region""",
)
def q_list_presets(spark, d):
    p = PR.presets_table(spark)
    j = _harvest_with_preset(spark, d).join(F.broadcast(p), F.col("preset") == p["name"], "inner")
    return j.groupBy("region").agg(F.sort_array(F.collect_set("name")).alias("presets"), F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register(
    "presets_of_region",
    with_ctes(HARVEST_SQL, _presets_values_sql(), _MAP_SQL)
    + """
SELECT region, list_sort(list(name)) AS presets FROM (SELECT DISTINCT region, p.name FROM harvest JOIN m ON harvest.crop = m.flag JOIN p ON m.preset = p.name)
WHERE lower(region) LIKE '%piem%' GROUP BY region""",
)
def q_presets_of_region(spark, d):
    used = _harvest_with_preset(spark, d).select("preset").distinct()
    p = PR.presets_table(spark)
    return PR.list_presets(p.join(used, p["name"] == used["preset"], "left_semi"), "PIEM")


@register(
    "gdd_preset_base",
    with_ctes(OBS_SQL)
    + """
SELECT rid, ROUND(gdd_daily, 6) AS gdd_daily,
       ROUND(sum(gdd_daily) OVER (PARTITION BY field_id ORDER BY date, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS gdd_accumulated
FROM (SELECT *, greatest(0.0, COALESCE(temp - """
    + str(float(PR.CROP_T_BASE["rice"]))
    + """, 0.0)) AS gdd_daily FROM obs)""",
)
def q_gdd_preset_base(spark, d):
    plan = PR.plan_from_preset(PR.presets_table(spark), "riso_novarese")
    out = gdd(obs(spark, d), plan.t_base, "temp", "date", "field_id", "rid")
    return out.select("rid", r6("gdd_daily").alias("gdd_daily"), r6("gdd_accumulated").alias("gdd_accumulated"))


@register(
    "onehot_sparse",
    with_ctes(HARVEST_SQL, "c AS (SELECT crop, field_id, rid, dense_rank() OVER (ORDER BY COALESCE(crop, 'nan')) - 1 AS a, dense_rank() OVER (ORDER BY field_id) - 1 AS b FROM harvest)")
    + "SELECT rid, [CAST(a AS INTEGER), CAST(b + (SELECT max(a) + 1 FROM c) AS INTEGER)] AS onehot_indices, CAST((SELECT max(a) + max(b) + 2 FROM c) AS INTEGER) AS onehot_size FROM c",
)
def q_onehot_sparse(spark, d):
    return FE.onehot_sparse(harvest(spark, d), ["crop", "field_id"]).select("rid", "onehot_indices", "onehot_size")


@register(
    "features_selected",
    with_ctes(HARVEST_SQL, _std_sql(["ph", "temp"]))
    + f"SELECT rid, [CAST({_scaled('ph')} AS FLOAT), CAST({_scaled('temp')} AS FLOAT)] AS features, CAST(yield AS FLOAT) AS target FROM harvest, s",
)
def q_features_selected(spark, d):
    h = harvest(spark, d)
    return FE.feature_matrix(h, FE.select_features(h, "yield", []), "rid")[0]


_CAT_COLS = ["yield", "ph", "temp", "tax"]


@register(
    "column_catalog",
    with_ctes(
        HARVEST_SQL,
        "h AS (SELECT h0.*, l_tax AS tax FROM harvest h0 JOIN lineitem ON h0.rid = concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey))",
        "dsc(name, unit, description) AS (VALUES " + ", ".join(f"('{k}', '{u}', '{v}')" for k, (u, v) in P.COLUMN_DESCRIPTIONS.items()) + ")",
        "st AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", ROUND(avg({c}), 6) AS mean, ROUND(stddev_pop({c}), 6) AS std FROM h" for c in _CAT_COLS)
        + ")",
    )
    + """SELECT st."column", mean, std, COALESCE(unit, '') AS unit, COALESCE(description, 'Colonna ' || st."column") AS description
FROM st LEFT JOIN dsc ON lower(st."column") = dsc.name""",
)
def q_column_catalog(spark, d):
    li = table(spark, d, "lineitem")
    h = harvest(spark, d).join(
        li.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"), F.col("l_tax").alias("tax")), "rid"
    )
    st = MO.feature_stats(h, _CAT_COLS).select("column", r6("mean").alias("mean"), r6("std").alias("std"))
    return P.column_catalog(st)


# --------------------------------------------------------------------------------------------
# units, coercion, dates


@register(
    "unit_convert",
    with_ctes(OBS_SQL)
    + "SELECT rid, ROUND((temp - 32.0) * 5.0 / 9.0, 6) AS temp, ROUND(humidity / 10.0 * 25.4, 6) AS rainfall FROM obs",
)
def q_unit_convert(spark, d):
    o = obs(spark, d).select("rid", F.col("temp").alias("temp_f"), (F.col("humidity") / 10.0).alias("rain_in"))
    out, _report = U.convert_units(o)
    return out.select("rid", r6("temp").alias("temp"), r6("rainfall").alias("rainfall"))


@register(
    "unit_range_heuristic",
    with_ctes(
        HARVEST_SQL,
        "x AS (SELECT rid, crop, CASE WHEN crop = 'R' THEN temp * 3.0 ELSE ph * 7.0 + 50.0 END AS t FROM harvest)",
        "r AS (SELECT crop AS c, min(t) AS mn, max(t) AS mx FROM x GROUP BY crop)",
    )
    + """SELECT rid, crop, ROUND(CASE WHEN mn >= 50.0 AND mx <= 120.0 THEN (t - 32.0) * 5.0 / 9.0 ELSE t END, 6) AS temp
FROM x JOIN r ON x.crop = r.c""",
)
def q_unit_range_heuristic(spark, d):
    h = harvest(spark, d)
    x = h.select("rid", "crop", F.when(F.col("crop") == "R", F.col("temp") * 3.0).otherwise(F.col("ph") * 7.0 + 50.0).alias("temp"))
    return U.range_heuristic_by_source(x, "temp", "crop").select("rid", "crop", r6("temp").alias("temp"))


def _text_lineitem(spark, d):
    li = table(spark, d, "lineitem")
    ln = F.col("l_linenumber")
    q = F.col("l_quantity").cast("string")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        F.when(ln == 3, F.regexp_replace(q, r"\.", ",")).when(ln == 5, F.lit("n/a")).otherwise(q).alias("yield"),
        F.when(ln == 2, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
    )


@register(
    "coerce_types",
    """
WITH t AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid,
         CASE WHEN l_linenumber = 3 THEN replace(CAST(l_quantity AS VARCHAR), '.', ',')
              WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS yield,
         CASE WHEN l_linenumber = 2 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date
  FROM lineitem)
SELECT rid, TRY_CAST(replace(trim(yield), ',', '.') AS DOUBLE) AS yield,
       COALESCE(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d/%m/%Y')) AS date
FROM t""",
)
def q_coerce_types(spark, d):
    return coerce(_text_lineitem(spark, d), ["date"], ["yield"]).select("rid", "yield", "date")


@register(
    "excel_serial_dates",
    """
WITH s AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice
                          ELSE epoch(o_orderdate) / 86400.0 + 25569 + CAST(o_orderkey % 4 AS DOUBLE) / 4.0 END AS serial
  FROM orders),
t AS (SELECT o_orderkey, CASE WHEN serial > 30000 AND serial < 60000
        THEN TIMESTAMP '1970-01-01 00:00:00' + to_microseconds(CAST(round((serial - 25569) * 86400000000.0) AS BIGINT)) END AS date
      FROM s)
SELECT o_orderkey, date FROM t WHERE date IS NOT NULL""",
)
def q_excel_serial_dates(spark, d):
    o = table(spark, d, "orders")
    serial = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice")).otherwise(
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400.0 + 25569 + (F.col("o_orderkey") % 4).cast("double") / 4.0
    )
    out = o.select("o_orderkey", normalise_date(serial).alias("date"))
    return out.where(F.col("date").isNotNull())


# --------------------------------------------------------------------------------------------
# error injection


def _u_sql(name: str, key: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:{name}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


@register(
    "inject_errors",
    with_ctes(
        OBS_SQL,
        f"""a AS (SELECT rid,
   CASE WHEN {_u_sql('nan:temp', 'rid')} >= 0.08 THEN temp END AS temp,
   CASE WHEN {_u_sql('nan:humidity', 'rid')} >= 0.08 THEN humidity END AS humidity FROM obs)""",
        f"""b AS (SELECT rid,
   CASE WHEN {_u_sql('spike:temp', 'rid')} < 0.03 THEN ROUND(200.0 * (0.5 + {_u_sql('amp:temp', 'rid')}), 2) ELSE temp END AS temp,
   CASE WHEN {_u_sql('viol:humidity', 'rid')} < 0.02 THEN ROUND(101.0 + 49.0 * {_u_sql('humv', 'rid')}, 2) ELSE humidity END AS humidity
   FROM a)""",
    )
    + f"""SELECT rid,
   CASE WHEN {_u_sql('type:temp', 'rid')} < 0.02 AND temp IS NOT NULL THEN replace(CAST(temp AS VARCHAR), '.', ',') ELSE CAST(temp AS VARCHAR) END AS temp,
   humidity FROM b""",
)
def q_inject_errors(spark, d):
    return CO.inject_errors(obs(spark, d).select("rid", "temp", "humidity"), "rid")


def _injected_sql(c: str, spike: float | None) -> str:
    kept = f"CASE WHEN {_u_sql('nan:' + c, 'rid')} >= 0.08 THEN {c} END"
    if spike is None:
        return kept
    return f"CASE WHEN {_u_sql('spike:' + c, 'rid')} < 0.03 THEN ROUND({spike} * (0.5 + {_u_sql('amp:' + c, 'rid')}), 2) ELSE {kept} END"


@register(
    "inject_errors_soil",
    with_ctes(HARVEST_SQL)
    + f"""SELECT rid, {_injected_sql('yield', 50.0)} AS yield, {_injected_sql('rainfall', 5000.0)} AS rainfall,
  CASE WHEN {_u_sql('viol:ph', 'rid')} < 0.02 THEN [-2.0, 17.5, 99.0][CAST(floor({_u_sql('phv', 'rid')} * 3) AS BIGINT) + 1] ELSE {_injected_sql('ph', None)} END AS ph
FROM (SELECT rid, yield, ph, temp * 2.0 AS rainfall FROM harvest)""",
)
def q_inject_errors_soil(spark, d):
    h = harvest(spark, d).select("rid", "yield", "ph", (F.col("temp") * 2.0).alias("rainfall"))
    return CO.inject_errors(h, "rid")


@register(
    "inject_duplicates",
    with_ctes(
        HARVEST_SQL,
        "r AS (SELECT rid, yield, row_number() OVER (ORDER BY md5('42:dup:' || rid), rid) AS p, count(*) OVER () AS n FROM harvest)",
    )
    + """SELECT rid, yield, 0 AS copy FROM r
UNION ALL SELECT rid, yield, 1 AS copy FROM r WHERE p <= CAST(floor(CAST(n AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS BIGINT)""",
)
def q_inject_duplicates(spark, d):
    return CO.inject_duplicates(harvest(spark, d).select("rid", "yield"), "rid", 0.05, 42)


# --------------------------------------------------------------------------------------------
# ingest of delimited field files (written by Spark from ``orders``, read back by the ingest job)

from fieldspark.plans import files as FF  # noqa: E402
from fieldspark.sources import headers as HD  # noqa: E402
from fieldspark.sources import ingest as IN  # noqa: E402
from fieldspark.sources.ranges import file_records  # noqa: E402

_REQ_ALL = ("date", "field_id", "temp", "yield")
_REQ_MIN = ("date", "field_id", "yield")


def _lst(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FILES_SQL = f"""fl AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, CAST(floor(o_orderkey / 1000) AS BIGINT) AS f FROM orders),
ff AS (SELECT DISTINCT f FROM fl),
cells AS (
  SELECT f, o_orderkey,
    CASE WHEN f % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN f % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
         ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) END AS c_date,
    CAST(o_custkey AS VARCHAR) AS c_field,
    CASE WHEN f % 5 = 4 THEN NULL WHEN f % 3 = 1 THEN replace(CAST(round(o_totalprice / 10000.0, 2) AS VARCHAR), '.', ',')
         ELSE CAST(round(o_totalprice / 10000.0, 2) AS VARCHAR) END AS c_temp,
    CASE WHEN f % 3 = 1 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') ELSE CAST(o_totalprice AS VARCHAR) END AS c_yield,
    o_orderstatus AS c_status,
    [',', ';', chr(9)][f % 3 + 1] AS sep,
    CASE WHEN f % 2 = 1 THEN 3 ELSE 1 END + row_number() OVER (PARTITION BY f ORDER BY o_orderkey) - 1 AS line_no
  FROM fl),
hdr AS (
  SELECT f, [',', ';', chr(9)][f % 3 + 1] AS sep,
    {_lst(FF.H_DATE)}[f % 4 + 1] AS h_date, {_lst(FF.H_FIELD)}[CAST(floor(f / 2) AS BIGINT) % 4 + 1] AS h_field,
    CASE WHEN f % 5 = 4 THEN NULL ELSE {_lst(FF.H_TEMP)}[CAST(floor(f / 5) AS BIGINT) % 4 + 1] END AS h_temp,
    {_lst(FF.H_YIELD)}[CAST(floor(f / 3) AS BIGINT) % 4 + 1] AS h_yield, '{FF.H_STATUS}' AS h_status
  FROM ff),
lines AS (
  SELECT f, o_orderkey AS ord, c_date || sep || c_field || COALESCE(sep || c_temp, '') || sep || c_yield || sep || c_status AS line FROM cells
  UNION ALL SELECT f, -1, h_date || sep || h_field || COALESCE(sep || h_temp, '') || sep || h_yield || sep || h_status FROM hdr
  UNION ALL SELECT f, -3, '{FF.JUNK[0]}' || CAST(f AS VARCHAR) FROM ff WHERE f % 2 = 1
  UNION ALL SELECT f, -2, '{FF.JUNK[1]}' FROM ff WHERE f % 2 = 1)"""


def _field_files(spark, d):
    path = FF.write_field_files(spark, d)
    files = IN.file_digests(spark, path)
    lines = file_records(spark, path)
    layout = IN.sniff_layout(lines)
    return path, files, lines, layout


def _label(df):
    return df.withColumn("source_file", FF.file_label(F.col("source_file")))


@register(
    "csv_layout",
    "WITH " + _FILES_SQL + "\nSELECT 'file_id=' || f AS source_file, [',', ';', chr(9)][f % 3 + 1] AS sep, "
    "CASE WHEN f % 5 = 4 THEN 4 ELSE 5 END AS n_columns FROM ff",
)
def q_csv_layout(spark, d):
    _p, _f, _l, layout = _field_files(spark, d)
    return _label(layout).select("source_file", "sep", "n_columns")


@register("header_row", "WITH " + _FILES_SQL + "\nSELECT 'file_id=' || f AS source_file, CASE WHEN f % 2 = 1 THEN 2 ELSE 0 END AS header_line FROM ff")
def q_header_row(spark, d):
    _p, _f, lines, layout = _field_files(spark, d)
    return _label(IN.header_rows(lines, layout, _REQ_ALL)).select("source_file", "header_line")


@register(
    "schema_hash_files",
    "WITH " + _FILES_SQL + """
SELECT 'file_id=' || f AS source_file, substr(sha256(array_to_string(list_sort(list_filter(
  [lower(trim(h_date)), lower(trim(h_field)), lower(trim(h_temp)), lower(trim(h_yield)), lower(trim(h_status))], lambda x: x IS NOT NULL)), ',')), 1, 16) AS schema_hash
FROM hdr""",
)
def q_schema_hash_files(spark, d):
    _p, _f, lines, layout = _field_files(spark, d)
    cat = IN.header_catalog(IN.header_rows(lines, layout, _REQ_ALL))
    return _label(FE.schema_hash_by_group(cat, "source_file", "name"))


def _targets_sql() -> str:
    tg = HD.targets(list(_REQ_ALL), HD.SYNONYMS)
    canon = sorted({c for _, c in tg})
    prio = {c: len(canon) - i for i, c in enumerate(canon)}
    return "tg(t, canonical, prio) AS (VALUES " + ", ".join(f"('{t}', '{c}', {prio[c]})" for t, c in tg) + ")"


_HEADER_MATCH_SQL = (
    "WITH "
    + _FILES_SQL
    + """,
cat AS (
  SELECT f, pos - 1 AS pos, trim(h) AS header FROM (
    SELECT f, unnest(list_filter([h_date, h_field, h_temp, h_yield, h_status], lambda x: x IS NOT NULL)) AS h,
           generate_subscripts(list_filter([h_date, h_field, h_temp, h_yield, h_status], lambda x: x IS NOT NULL), 1) AS pos
    FROM hdr)),
"""
    + _targets_sql()
    + """,
sc AS (
  SELECT f, pos, header, canonical, prio,
    CASE WHEN n = t THEN 100.0 ELSE greatest(100.0 - 100.0 * CAST(levenshtein(n, t) AS DOUBLE) / greatest(length(n), length(t)),
      CASE WHEN (starts_with(n, t) OR starts_with(t, n)) AND least(length(n), length(t)) >= 3 THEN 90.0 ELSE 0.0 END) END AS score
  FROM (SELECT *, trim(regexp_replace(lower(header), '[^\\pL\\pN]', ' ', 'g')) AS n FROM cat), tg),
best AS (SELECT f, pos, header, arg_max(canonical, (score, prio)) AS cand, max(score) AS score FROM sc GROUP BY f, pos, header),
win AS (SELECT *, row_number() OVER (PARTITION BY f, cand ORDER BY score DESC, pos) AS r FROM best)"""
)


@register(
    "header_match",
    _HEADER_MATCH_SQL
    + """
SELECT 'file_id=' || f AS source_file, CAST(pos AS INTEGER) AS pos, header,
       CASE WHEN score >= 85.0 AND r = 1 THEN cand END AS canonical, ROUND(score, 4) AS score
FROM win""",
)
def q_header_match(spark, d):
    _p, _f, lines, layout = _field_files(spark, d)
    cat = IN.header_catalog(IN.header_rows(lines, layout, _REQ_ALL))
    m = HD.match_headers(cat, list(_REQ_ALL), HD.SYNONYMS, 85.0)
    return _label(m).select("source_file", "pos", "header", "canonical", F.round("score", 4).alias("score"))


# names derived from customers: synonyms as they are, with swapped words, an extra word, a letter less
# or a letter twice
_VARIANT_SYNONYMS = [s for c, syns in HD.SYNONYMS.items() for s in [c, *syns]]
_HEADER_VARIANTS_SQL = f"""WITH syn AS (SELECT unnest({_VARIANT_SYNONYMS}) AS s, unnest(range({len(_VARIANT_SYNONYMS)})) AS i),
cat AS (SELECT 'c' || (c_custkey % 40) AS source_file, CAST(c_custkey AS INTEGER) AS pos,
  CASE (c_custkey // {len(_VARIANT_SYNONYMS)}) % 6 WHEN 0 THEN s WHEN 1 THEN array_to_string(list_reverse(string_split_regex(s, '[_ ]')), ' ')
    WHEN 2 THEN s || ' media' WHEN 3 THEN 'Valore ' || s WHEN 4 THEN substr(s, 1, c_custkey % length(s)) || substr(s, c_custkey % length(s) + 2)
    ELSE substr(s, 1, c_custkey % length(s) + 1) || substr(s, c_custkey % length(s) + 1) END AS header
  FROM customer JOIN syn ON i = c_custkey % {len(_VARIANT_SYNONYMS)}),
nrm AS (SELECT *, trim(regexp_replace(lower(header), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')) AS h FROM cat)"""


def _composite_sql() -> str:
    tg = ", ".join(f"('{t}', '{c}')" for t, c in HD.targets(list(_REQ_ALL), HD.SYNONYMS))
    words = "list_sort(list_distinct(string_split_regex(trim({0}), ' +')))"
    mask = "((1::HUGEINT << length(a)) - 1)"
    return (
        _HEADER_VARIANTS_SQL
        + f""",
tg(t, cand) AS (VALUES {tg}),
p0 AS (SELECT h, t, cand, {words.format('h')} AS wa, {words.format('t')} AS wb FROM (SELECT DISTINCT h FROM nrm WHERE h <> ''), tg),
p AS (SELECT *, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, list_sort(list_intersect(wa, wb)) AS w2,
  array_to_string(list_filter(wa, lambda x: NOT list_contains(wb, x)), ' ') AS ra, array_to_string(list_filter(wb, lambda x: NOT list_contains(wa, x)), ' ') AS rb,
  greatest(length(h), length(t)) / least(length(h), length(t)) AS far FROM p0),
two AS (SELECT h AS a, t AS b FROM p UNION SELECT sa, sb FROM p),
so AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM two),
win AS (SELECT a, b, x, unnest(list_concat(list_transform(range(1, length(y) - length(x) + 2), lambda i: substr(y, i, length(x))),
  list_transform(range(1, length(x)), lambda k: substr(y, 1, k)), list_transform(range(1, length(x)), lambda k: right(y, k)))) AS w FROM so),
need AS (SELECT a, b FROM two UNION SELECT ra, rb FROM p UNION SELECT x, w FROM win),
l AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0 ELSE length(a) - bit_count(list_reduce(list_prepend({mask}, list_transform(string_split(b, ''),
  lambda c: list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, i + 1, 1) = c THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END)))),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & {mask})) END AS n FROM need),
wr AS (SELECT win.a, win.b, max(200 * l.n / (length(x) + length(w))) AS best FROM win JOIN l ON l.a = x AND l.b = w GROUP BY win.a, win.b),
parts AS (SELECT p.*, 200 * l1.n / (length(h) + length(t)) AS r, 200 * l2.n / (length(sa) + length(sb)) AS rs, w1.best AS u, w2_.best AS v,
  length(array_to_string(w2, ' ')) AS sh, length(ra) + length(rb) - 2 * l3.n AS apart
  FROM p JOIN l l1 ON l1.a = h AND l1.b = t JOIN l l2 ON l2.a = sa AND l2.b = sb JOIN l l3 ON l3.a = ra AND l3.b = rb
  JOIN wr w1 ON w1.a = h AND w1.b = t JOIN wr w2_ ON w2_.a = sa AND w2_.b = sb),
scored AS (SELECT h, cand, CASE WHEN h = t THEN 100.0
  WHEN far < 1.5 THEN greatest(r, 0.95 * CASE WHEN len(w2) = 0 THEN rs WHEN ra = '' OR rb = '' THEN 100.0 ELSE greatest(rs, 100 * (1 - apart / (2 * sh + 2 + length(ra) + length(rb))),
    200 * sh / (2 * sh + 1 + length(ra)), 200 * sh / (2 * sh + 1 + length(rb))) END)
  ELSE greatest(r, CASE WHEN far <= 8 THEN 0.9 ELSE 0.6 END * u, 0.95 * CASE WHEN far <= 8 THEN 0.9 ELSE 0.6 END * CASE WHEN len(w2) > 0 THEN 100.0 ELSE v END) END AS score FROM parts),
best AS (SELECT h, arg_min(cand, (-round(score, 6), cand)) AS cand, max(score) AS score FROM scored WHERE score >= 85 GROUP BY h),
win2 AS (SELECT source_file, pos, header, cand, score, row_number() OVER (PARTITION BY source_file, cand ORDER BY score DESC, pos) AS rn FROM nrm LEFT JOIN best USING (h))
SELECT source_file, pos, header, CASE WHEN rn = 1 THEN cand END AS canonical, round(score, 4) AS score FROM win2"""
    )


@register("header_match_composite", _composite_sql())
def q_header_match_composite(spark, d):
    n = len(_VARIANT_SYNONYMS)
    k = F.col("c_custkey")
    s = F.element_at(F.array(*[F.lit(x) for x in _VARIANT_SYNONYMS]), (k % n + 1).cast("int"))
    at = (k % F.length(s)).cast("int")
    header = (
        F.when(F.floor(k / n) % 6 == 0, s)
        .when(F.floor(k / n) % 6 == 1, F.array_join(F.reverse(F.split(s, "[_ ]")), " "))
        .when(F.floor(k / n) % 6 == 2, F.concat(s, F.lit(" media")))
        .when(F.floor(k / n) % 6 == 3, F.concat(F.lit("Valore "), s))
        .when(F.floor(k / n) % 6 == 4, F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + 2, F.length(s))))
        .otherwise(F.concat(F.substring(s, F.lit(1), at + 1), F.substring(s, at + 1, F.length(s))))
    )
    cat = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), k % 40).alias("source_file"), k.cast("int").alias("pos"), header.alias("header"))
    cat = cat.withColumn("name", F.lower(F.trim("header")))
    m = HD.match_headers_composite(cat, list(_REQ_ALL), HD.SYNONYMS, 85.0)
    return m.select("source_file", "pos", "header", "canonical", F.round("score", 4).alias("score"))


@register(
    "missing_columns",
    "WITH " + _FILES_SQL + "\nSELECT 'file_id=' || f AS source_file, CASE WHEN f % 5 = 4 THEN ['temp'] ELSE CAST([] AS VARCHAR[]) END AS missing FROM ff",
)
def q_missing_columns(spark, d):
    path = FF.write_field_files(spark, d)
    res = IN.ingest(spark, path, _REQ_ALL, HD.SYNONYMS, fuzzy=True, on_error="skip")
    return _label(res.files).select("source_file", "missing")


@register(
    "file_quarantine",
    "WITH " + _FILES_SQL + "\nSELECT 'file_id=' || f AS source_file, f % 5 <> 4 AS ok, "
    "CASE WHEN f % 5 = 4 THEN 'missing columns: temp' END AS reason FROM ff",
)
def q_file_quarantine(spark, d):
    path = FF.write_field_files(spark, d)
    res = IN.ingest(spark, path, _REQ_ALL, HD.SYNONYMS, fuzzy=True, on_error="skip")
    return _label(res.files).select("source_file", "ok", "reason")


@register(
    "batch_union",
    "WITH " + _FILES_SQL + """
SELECT 'file_id=' || f AS source_file, CAST(line_no AS INTEGER) AS line_no, c_date AS date, c_field AS field_id,
       c_temp AS temp, c_yield AS yield, c_status AS stato
FROM cells""",
)
def q_batch_union(spark, d):
    path = FF.write_field_files(spark, d)
    res = IN.ingest(spark, path, _REQ_MIN, HD.SYNONYMS, fuzzy=True, on_error="skip", normalise_dates=False)
    return _label(res.df).select("source_file", "line_no", "date", "field_id", "temp", "yield", "stato")


@register(
    "ingest_normalised",
    "WITH " + _FILES_SQL + """
SELECT 'file_id=' || c.f AS source_file, CAST(line_no AS INTEGER) AS line_no, CAST(fl.o_orderdate AS TIMESTAMP) AS date,
       c_field AS field_id, c_temp AS temp, c_yield AS yield
FROM cells c JOIN fl USING (o_orderkey) WHERE c.f % 5 <> 4""",
)
def q_ingest_normalised(spark, d):
    path = FF.write_field_files(spark, d)
    res = IN.ingest(spark, path, _REQ_ALL, HD.SYNONYMS, fuzzy=True, on_error="skip", normalise_dates=True)
    return _label(res.df).select("source_file", "line_no", "date", "field_id", "temp", "yield")


@register(
    "row_fingerprint",
    "WITH " + _FILES_SQL + "\nSELECT 'file_id=' || f AS source_file, sha256(string_agg(line || chr(10), '' ORDER BY ord)) AS file_hash FROM lines GROUP BY f",
)
def q_row_fingerprint(spark, d):
    _p, files, _l, _lay = _field_files(spark, d)
    return _label(files).select("source_file", "file_hash")


_MIXED_SQL = """WITH mx AS (
  SELECT o_orderkey AS k, 'file_id=' || CAST(floor(o_orderkey / 1000.0) AS BIGINT) AS source_file,
    CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00.5' WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T06:00:00+02:00' WHEN 5 THEN 'n.d.' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dt,
    CASE o_orderkey % 7 WHEN 0 THEN date_trunc('minute', CAST(o_orderdate AS TIMESTAMP)) WHEN 2 THEN date_trunc('day', o_orderdate) + INTERVAL 37800500 MILLISECOND
      WHEN 4 THEN date_trunc('day', o_orderdate) + INTERVAL 6 HOUR WHEN 5 THEN NULL ELSE CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) END AS date,
    CASE WHEN o_orderkey % 5 >= 3 THEN CAST(o_custkey AS VARCHAR) END AS temp,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'NaN' ELSE CAST(o_custkey AS VARCHAR) END AS raw_temp,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'due, righe' || chr(10) || 'qui' ELSE o_orderstatus END AS note,
    o_orderkey % 11 = 0 AS quoted, o_orderkey % 17 = 0 AS short, o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0 AS long
  FROM orders)
"""


def _mixed(spark, d):
    return IN.ingest(spark, FF.write_mixed_files(spark, d), ("date", "field_id", "temp"))


@register("ingest_dates_mixed", _MIXED_SQL + "SELECT source_file, CAST(k AS VARCHAR) AS field_id, date FROM mx WHERE date IS NOT NULL")
def q_ingest_dates_mixed(spark, d):
    return _label(_mixed(spark, d).df).select("source_file", "field_id", "date")


_ORDERED_SQL = """WITH r AS (SELECT CAST(floor(o_orderkey / 1000.0) AS BIGINT) AS f, o_orderkey AS k, o_orderdate AS d FROM orders),
o AS (SELECT 'file_id=' || f AS source_file, f, k, d, count(*) FILTER (WHERE day(d) > 12) OVER (PARTITION BY f) AS telling FROM r)
"""


@register(
    "ingest_date_order",
    _ORDERED_SQL
    + """SELECT source_file, CAST(k AS VARCHAR) AS field_id, CASE WHEN f % 3 = 2 OR telling = 0 THEN 'ambiguous' WHEN f % 3 = 0 THEN 'day' ELSE 'month' END AS date_order,
  CAST(CASE WHEN f % 3 = 2 THEN make_date(year(d), month(d), CAST(1 + k % 12 AS BIGINT)) WHEN f % 3 = 1 AND telling = 0 THEN make_date(year(d), day(d), month(d)) ELSE CAST(d AS DATE) END AS TIMESTAMP) AS date FROM o""",
)
def q_ingest_date_order(spark, d):
    """Files with the day first, the month first, or nothing that tells: each read in its own order."""
    res = IN.ingest(spark, FF.write_ordered_files(spark, d), ("date", "field_id", "temp"))
    rows = res.df.join(few(res.files.select("source_file", "date_order")), "source_file")
    return _label(rows).select("source_file", "field_id", "date_order", "date")


@register(
    "ingest_split_ranges",
    _MIXED_SQL
    + """, line AS (SELECT source_file, k, dt || ',' || k || ',' || raw_temp || CASE WHEN short THEN '' WHEN quoted THEN ',"' || note || '"' ELSE ',' || note END || CASE WHEN long THEN ',oltre' ELSE '' END AS line FROM mx
  UNION ALL SELECT DISTINCT source_file, -1, 'date,field_id,temp,note' FROM mx)
SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY k) - 1 AS BIGINT) AS line_no, line FROM line""",
)
def q_ingest_split_ranges(spark, d):
    """Records of files cut into ranges of 700 bytes, some of them inside quoted line breaks."""
    lines = file_records(spark, FF.write_mixed_files(spark, d), range_bytes=700)
    return _label(lines).select("source_file", F.col("line_no").cast("bigint").alias("line_no"), "line")


@register(
    "ingest_missing_cells",
    _MIXED_SQL + "SELECT CAST(k AS VARCHAR) AS field_id, temp, note, short OR long AS malformed FROM mx WHERE date IS NOT NULL",
)
def q_ingest_missing_cells(spark, d):
    return _mixed(spark, d).df.select("field_id", "temp", "note", "malformed")


@register(
    "ingest_rejected_rows",
    _MIXED_SQL
    + """SELECT source_file, CASE WHEN date IS NULL THEN 'no readable date' WHEN long THEN 'more cells than the header' ELSE 'fewer cells than the header' END AS reason,
  concat_ws(',', dt, CAST(k AS VARCHAR), raw_temp, CASE WHEN quoted THEN '"' || note || '"' ELSE note END, CASE WHEN long THEN 'oltre' END) AS raw_line
FROM mx WHERE date IS NULL OR long OR short""",
)
def q_ingest_rejected_rows(spark, d):
    return _label(_mixed(spark, d).rejected).select("source_file", "reason", "raw_line")


# --------------------------------------------------------------------------------------------
# sinks: what Spark wrote is read back and compared

from fieldspark.plans import export as EX  # noqa: E402

HARVEST_PLAN = CleanPlan(
    numeric_columns=("yield", "ph", "temp"),
    categorical_columns=("crop",),
    date_columns=("date",),
    dedup_keys=(),
    missing_strategy="median",
    outlier_method="iqr",
    physical_bounds={"ph": (0.0, 14.0), "temp": (-30.0, 60.0)},
)


def _bundle(spark, d):
    res = clean(harvest(spark, d), HARVEST_PLAN)
    res.df.persist(StorageLevel.MEMORY_AND_DISK)  # de-duplicated once, for the diagnostics and the export
    diag = {r["metric"]: r["value"] for r in res.diagnostics.collect()}
    spec = FE.FeatureSpec(numeric=["ph", "temp"], categorical=["crop"], target="yield")
    out = FF.scratch_path(spark, "bundle")
    return res, diag, EX.export_bundle(res.df, spec, out, "harvest", "rid", (0.7, 0.2, 0.1), 42, diag)


_BUNDLE_SQL = with_ctes(
    HARVEST_SQL,
    """c AS (SELECT rid, crop, CASE WHEN ph < 0.0 OR ph > 14.0 THEN NULL ELSE ph END AS ph, CASE WHEN temp < -30.0 OR temp > 60.0 THEN NULL ELSE temp END AS temp,
    yield, field_id, date FROM harvest)""",
    "s AS (SELECT "
    + ", ".join(f"count({c}) AS n_{c}, quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in ("yield", "ph", "temp"))
    + " FROM c)",
    "o AS (SELECT rid, crop, field_id, date, "
    + ", ".join(
        f"CASE WHEN n_{c} >= 10 AND ({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c})) THEN NULL ELSE {c} END AS {c}"
        for c in ("yield", "ph", "temp")
    )
    + " FROM c, s)",
    "md AS (SELECT median(yield) AS my, median(ph) AS mp, median(temp) AS mt FROM o)",
    "f AS (SELECT rid, crop, field_id, date, COALESCE(yield, my) AS yield, COALESCE(ph, mp) AS ph, COALESCE(temp, mt) AS temp FROM o, md)",
    "d AS (SELECT max(rid) AS rid, crop, field_id, date, yield, ph, temp FROM f GROUP BY ALL)",
    "z AS (SELECT avg(ph) AS mph, stddev_pop(ph) AS sph, avg(temp) AS mtemp, stddev_pop(temp) AS stemp FROM d)",
    """x AS (SELECT rid, CAST(CAST((ph - mph) / sph AS FLOAT) AS DOUBLE) AS ph, CAST(CAST((temp - mtemp) / stemp AS FLOAT) AS DOUBLE) AS temp,
    CAST(dense_rank() OVER (ORDER BY COALESCE(crop, 'nan')) - 1 AS DOUBLE) AS crop, CAST(CAST(yield AS FLOAT) AS DOUBLE) AS y,
    row_number() OVER (ORDER BY md5('42:' || rid), rid) AS p, count(*) OVER () AS n FROM d, z)""",
    "thr AS (SELECT DISTINCT n, floor(CAST(0.7 AS DOUBLE) * n) AS nt FROM x)",
    "thr2 AS (SELECT n, nt, floor((CAST(0.2 AS DOUBLE) / (CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE))) * (n - nt)) AS nv FROM thr)",
    "parts AS (SELECT x.*, CASE WHEN p <= nt THEN 'train' WHEN p <= nt + nv THEN 'val' ELSE 'test' END AS split FROM x, thr2)",
)


def _facts(spark, rows):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "fact string, value double").select("fact", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@register(
    "manifest",
    _BUNDLE_SQL
    + "SELECT fact, round(value, 4) + 0.0 AS value FROM ("
    + " UNION ALL ".join(
        [f"SELECT 'stats.{c}.{k}' AS fact, {f}({c}) AS value FROM x" for c in ("ph", "temp", "crop") for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
        + [f"SELECT 'corr.{a}.{b}', corr({a}, {b}) FROM x" for a in ("ph", "temp", "crop") for b in ("ph", "temp", "crop")]
        + [f"SELECT 'scaler.mean.{i}', m{c} FROM z UNION ALL SELECT 'scaler.scale.{i}', s{c} FROM z" for i, c in enumerate(("ph", "temp"))]
        + ["SELECT 'split.' || split, count(*) FROM parts GROUP BY split", "SELECT 'split.total', count(*) FROM x"]
        + ["SELECT 'categories.crop', max(crop) + 1 FROM x"]
    )
    + ")",
)
def q_manifest(spark, d):
    _res, _diag, b = _bundle(spark, d)
    m = json.loads(spark.read.text(b.manifest_path, wholetext=True).first()["value"])
    rows = [(f"stats.{c['name']}.{k}", v) for c in m["columns"] for k, v in c["stats"].items()]
    rows += [(f"corr.{i}.{j}", v) for i, per in m["correlations"].items() for j, v in per.items()]
    scaler = m["pipeline_context"]["scaler_params"]
    rows += [(f"scaler.{k}.{i}", v) for k in ("mean", "scale") for i, v in enumerate(scaler[k])]
    rows += [(f"split.{k}", v) for k, v in m["split_info"]["counts"].items()]
    rows += [(f"categories.{c}", v["categories"]) for c, v in m["pipeline_context"]["categorical_mappings"].items()]
    return _facts(spark, rows)


TEXT_PLAN = CleanPlan(
    auto_unit_conversion=True,
    categorical_columns=("crop",),
    date_columns=("date",),
    dedup_keys=(),
    missing_strategy="median",
    outlier_method="iqr",
    physical_bounds={"ph": (0.0, 8.0), "temp": (-15.0, 60.0)},
)

_TEXT_SQL = _BUNDLE_SQL[: _BUNDLE_SQL.index("z AS (")].rstrip().rstrip(",").replace(
    _BUNDLE_SQL[_BUNDLE_SQL.index("c AS (") : _BUNDLE_SQL.index("s AS (")],
    """c AS (SELECT rid, crop, CASE WHEN ph > 8.0 THEN NULL ELSE ph END AS ph, CASE WHEN t < -15.0 OR t > 60.0 THEN NULL ELSE t END AS temp,
    yield * 1.12085 AS yield, field_id, date FROM (SELECT *, (temp - 32.0) * 5.0 / 9.0 AS t FROM harvest)),
""",
)


@register("clean_text_input", _TEXT_SQL + " SELECT rid, crop, ROUND(yield, 6) AS yield, ROUND(ph, 6) AS ph, ROUND(temp, 6) AS temp FROM d")
def q_clean_text_input(spark, d):
    def comma(c):
        return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))

    h = harvest(spark, d)
    text = h.select("rid", "field_id", "date", "crop", comma("yield").alias("yield_lb_acre"), comma("ph").alias("ph"), comma("temp").alias("temp_f"))
    out = clean(text, TEXT_PLAN).df
    return out.select("rid", "crop", r6("yield").alias("yield"), r6("ph").alias("ph"), r6("temp").alias("temp"))


@register(
    "bundle_split_rows",
    _BUNDLE_SQL + "SELECT rid, [CAST(ph AS FLOAT), CAST(temp AS FLOAT), CAST(crop AS FLOAT)] AS features, CAST(y AS FLOAT) AS target FROM parts WHERE split = 'val'",
)
def q_bundle_split_rows(spark, d):
    _res, _diag, b = _bundle(spark, d)
    return spark.read.parquet(b.features_path).where("split = 'val'").select("rid", "features", "target")


_RUN_SQL = (
    "SELECT 'obs_total_rows' AS key, CAST((SELECT count(*) FROM harvest) AS DOUBLE) AS value"
    " UNION ALL SELECT 'obs_duplicates_removed', (SELECT count(*) FROM harvest) - (SELECT count(*) FROM d)"
    " UNION ALL SELECT 'obs_agronomic_outliers_removed', 0"
    " UNION ALL SELECT 'obs_out_of_bounds_removed', (SELECT 2 * count(*) - count(c.ph) - count(c.temp) FROM c)"
    " UNION ALL SELECT 'obs_outliers_removed', (SELECT count(c.yield) + count(c.ph) + count(c.temp) FROM c) - (SELECT count(yield) + count(ph) + count(temp) FROM o)"
    " UNION ALL SELECT 'obs_values_imputed', (SELECT 3 * count(*) - count(yield) - count(ph) - count(temp) FROM o)"
    " UNION ALL SELECT 'split_train', 0.7 UNION ALL SELECT 'split_val', 0.2 UNION ALL SELECT 'split_test', 0.1"
)


@register("run_log", _BUNDLE_SQL + _RUN_SQL)
def q_run_log(spark, d):
    res, diag, b = _bundle(spark, d)
    runs = FF.scratch_path(spark, "runs")
    cfg = {k: v for k, v in HARVEST_PLAN.__dict__.items()}
    rid = EX.log_run(spark, runs, cfg, diag, (0.7, 0.2, 0.1), b.baseline, {"file_name": "harvest", "target": "yield"})
    run = spark.read.parquet(runs).where(F.col("run_id") == rid)
    return run.where(F.col("key").rlike("^(obs|split)_")).select("key", F.col("value").cast("double").alias("value"))


@register(
    "category_table",
    with_ctes(HARVEST_SQL)
    + """
SELECT 'crop' AS "column", CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code, v AS value
FROM (SELECT DISTINCT COALESCE(crop, 'nan') AS v FROM harvest)
UNION ALL
SELECT 'field_id', CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER), v
FROM (SELECT DISTINCT COALESCE(field_id, 'nan') AS v FROM harvest)""",
)
def q_category_table(spark, d):
    return FE.category_table(harvest(spark, d), ["crop", "field_id"])


_REPORT_MEASURES = {
    "summary": ["rows_removed"],
    "nulls_before": ["null_count"],
    "nulls_after": ["null_count"],
    "describe_after": ["count", "mean", "min", "max"],
    "boxplot": ["q1", "median", "q3", "n_fliers"],
    "histogram": ["n"],
}


def _report_sql() -> str:
    """The six report tables as (part, item, measure, value) rows, from the oracles of their own queries."""
    last = "d1 AS (SELECT rid, date, field_id, crop, temp, humidity, day FROM d WHERE rn = 1)"
    summary = "SELECT 'rows_removed' AS item, 'rows_removed' AS m, (SELECT count(*) FROM obs) - (SELECT count(*) FROM d1) AS v"
    nulls = {s: " UNION ALL ".join(f"SELECT '{c}', 'null_count', count(*) - count({c}) FROM {s}" for c in _OBS_COLS) for s in ("obs", "d1")}
    desc = " UNION ALL ".join(
        f"SELECT '{c}', '{k}', {e} FROM d1" for c in ("temp", "humidity") for k, e in (("count", f"count({c})"), ("mean", f"round(avg({c}), 3)"), ("min", f"round(min({c}), 3)"), ("max", f"round(max({c}), 3)"))
    )
    box = ORACLE["boxplot_stats"][len(_CLEAN_CHAIN.strip()):]
    hist = ORACLE["histogram_before_after"][len(_CLEAN_CHAIN.strip()):]
    views, box_body = box.split("SELECT q.state, q.", 1)
    mm, hist_body = hist.split('SELECT l."column", state,', 1)
    mm = mm[mm.index(", mm AS"):]
    return (
        _CLEAN_CHAIN.rstrip() + ",\n" + last + views + mm
        + ", bx AS (SELECT q.state, q." + box_body + '), hs AS (SELECT l."column", state,' + hist_body + ")\n"
        + "SELECT part, item, m AS measure, round(CAST(v AS DOUBLE), 4) + 0.0 AS value FROM (\n"
        + f"SELECT 'summary' AS part, * FROM ({summary})"
        + f" UNION ALL SELECT 'nulls_before', * FROM ({nulls['obs']}) UNION ALL SELECT 'nulls_after', * FROM ({nulls['d1']})"
        + f" UNION ALL SELECT 'describe_after', * FROM ({desc})"
        + " UNION ALL " + " UNION ALL ".join(f"SELECT 'boxplot', state || '.' || \"column\", '{k}', {k} FROM bx" for k in _REPORT_MEASURES["boxplot"])
        + " UNION ALL SELECT 'histogram', state || '.' || \"column\" || '.' || bin, 'n', n FROM hs)"
    )


@register("quality_report", _report_sql())
def q_quality_report(spark, d):
    before = obs(spark, d)
    after = clean(before, OBS_PLAN).df
    paths = EX.write_report_tables(before, after, ["temp", "humidity"], FF.scratch_path(spark, "report"))
    parts = []
    for part, path in paths.items():
        t = spark.read.parquet(path)
        if part == "summary":
            item = F.lit("rows_removed")
        elif part in ("boxplot", "histogram"):
            item = F.concat_ws(".", "state", "column", *(["bin"] if part == "histogram" else []))
        else:
            item = F.col("column")
        if part == "describe_after":
            t = t.where(F.col("column").isin("temp", "humidity"))
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in _REPORT_MEASURES[part]]))
        parts.append(t.select(F.lit(part).alias("part"), item.alias("item"), cells.alias("c")))
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.select("part", "item", F.col("c.m").alias("measure"), (F.round("c.v", 4) + F.lit(0.0)).alias("value"))
