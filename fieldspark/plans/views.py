"""Field-observation views over the driver tables (same expressions in Spark and in SQL).

The driver tables hold no NULLs, so missing cells are injected deterministically from the keys;
every row of the source table is kept.

* ``obs``     over ``events``:   one weather observation per event.
* ``harvest`` over ``lineitem``: one yield measurement per line item. ``(orderkey, linenumber)``
  repeats in the driver data, so the row id is the text key ``orderkey:linenumber:partkey:suppkey``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("rid"),
        F.col("ts").alias("date"),
        F.col("user_id").cast("string").alias("field_id"),
        F.when(eid % 17 == 4, F.lit(None)).otherwise(F.col("event_type")).alias("crop"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("value")).alias("temp"),
        F.when(eid % 13 == 5, F.lit(None))
        .otherwise(F.get_json_object("props", "$.k").try_cast("double"))
        .alias("humidity"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
    )


OBS_SQL = """obs AS (
  SELECT event_id AS rid, ts AS date, CAST(user_id AS VARCHAR) AS field_id,
         CASE WHEN event_id % 17 = 4 THEN NULL ELSE event_type END AS crop,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS temp,
         CASE WHEN event_id % 13 = 5 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS humidity,
         CAST(date_trunc('day', ts) AS TIMESTAMP) AS day
  FROM events)"""


def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
        F.col("l_suppkey").cast("string").alias("field_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("crop"),
        F.col("l_quantity").alias("yield"),
        (F.col("l_discount") * 100.0).alias("ph"),
        (F.col("l_tax") * 500.0).alias("temp"),
    )


HARVEST_SQL = """harvest AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, CAST(l_suppkey AS VARCHAR) AS field_id,
         l_shipdate AS date, l_returnflag AS crop, l_quantity AS yield,
         l_discount * 100.0 AS ph, l_tax * 500.0 AS temp
  FROM lineitem)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
