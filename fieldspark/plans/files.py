"""Field files derived from the driver tables, written by Spark, for the ingest queries.

One delimited text file per 1 000 orders (so the number of files grows with the table, not the
size of each file). The layout varies with the file number ``f``:

* separator: ``,`` / ``;`` / TAB for ``f % 3`` = 0 / 1 / 2 (``;`` files write decimal commas)
* two junk lines above the header when ``f`` is odd
* header names vary (canonical, Italian, mixed case / padded) and files with ``f % 5 == 4`` have
  no temperature column
* dates as ISO text, ``dd/MM/yyyy`` text or Excel serial day numbers (``f % 3``)
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.session import ensure_checkpoint_dir

FILE_ROWS = 1000
H_DATE = ["date", "Data", "DATE ", "data"]
H_FIELD = ["field_id", "Campo", "ID Appezzamento", "Field_ID"]
H_TEMP = ["temp", "Temperatura", "Temp_Aria_C", "TEMP"]
H_YIELD = ["yield", "Resa", "Resa_Stimata_kg_ha", " Yield"]
H_STATUS = "Stato"
JUNK = ("Azienda agricola - registro ", "Esportato da gestionale")

_CACHE: dict[tuple[str, str], str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never a machine-local tmp)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def field_file_lines(orders: DataFrame) -> DataFrame:
    """(file_id, ord, line) for every line of every field file."""
    f = F.floor(F.col("o_orderkey") / F.lit(FILE_ROWS)).cast("bigint")
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", f.alias("f"))
    sep = _pick([",", ";", "\t"], F.col("f") % 3)
    has_temp = (F.col("f") % 5) != 4
    comma = (F.col("f") % 3) == 1

    def num(c: Column) -> Column:
        t = c.cast("string")
        return F.when(comma, F.regexp_replace(t, r"\.", ",")).otherwise(t)

    date_cell = (
        F.when(F.col("f") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("f") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
    )
    temp_cell = num(F.round(F.col("o_totalprice") / 10000.0, 2))
    data = o.select(
        "f",
        F.col("o_orderkey").alias("ord"),
        F.concat_ws(
            "",
            date_cell, sep, F.col("o_custkey").cast("string"),
            F.when(has_temp, F.concat(sep, temp_cell)).otherwise(F.lit("")),
            sep, num(F.col("o_totalprice")), sep, F.col("o_orderstatus"),
        ).alias("line"),
    )
    files = o.select("f").distinct()
    fs = F.col("f")
    hsep = _pick([",", ";", "\t"], fs % 3)
    header = files.select(
        "f",
        F.lit(-1).cast("bigint").alias("ord"),
        F.concat_ws(
            "",
            _pick(H_DATE, fs % 4), hsep, _pick(H_FIELD, F.floor(fs / 2) % 4),
            F.when(fs % 5 != 4, F.concat(hsep, _pick(H_TEMP, F.floor(fs / 5) % 4))).otherwise(F.lit("")),
            hsep, _pick(H_YIELD, F.floor(fs / 3) % 4), hsep, F.lit(H_STATUS),
        ).alias("line"),
    )
    junk1 = files.where(fs % 2 == 1).select("f", F.lit(-3).cast("bigint").alias("ord"), F.concat(F.lit(JUNK[0]), fs.cast("string")).alias("line"))
    junk2 = files.where(fs % 2 == 1).select("f", F.lit(-2).cast("bigint").alias("ord"), F.lit(JUNK[1]).alias("line"))
    return data.unionByName(header).unionByName(junk1).unionByName(junk2).withColumnRenamed("f", "file_id")


def write_field_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the field files once per (session, input folder); returns the folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    out = scratch_path(spark, "field-files")
    lines = field_file_lines(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    # one writer task per file id, lines in file order (header and junk first)
    (
        lines.repartition("file_id")
        .sortWithinPartitions("file_id", "ord")
        .select("file_id", "line")
        .write.partitionBy("file_id")
        .mode("overwrite")
        .text(out)
    )
    _CACHE[key] = out
    return out


def write_mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """Comma files of ``orders`` with mixed date shapes, missing markers, quoted line breaks and lines
    with too many or too few cells; returns the folder."""
    key = (spark.sparkContext.applicationId, f"mixed:{sf_dir}")
    if key in _CACHE:
        return _CACHE[key]
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    date = (
        F.when(k % 7 == 0, F.date_format(day, "yyyy-MM-dd HH:mm"))
        .when(k % 7 == 1, F.date_format(day, "yyyy-M-d"))
        .when(k % 7 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:00.5")))
        .when(k % 7 == 3, F.date_format(day, "dd/MM/yyyy"))
        .when(k % 7 == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T06:00:00+02:00")))
        .when(k % 7 == 5, F.lit("n.d."))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    temp = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("NA")).when(k % 5 == 2, F.lit("NaN")).otherwise(F.col("o_custkey").cast("string"))
    note = F.when(k % 11 == 0, F.lit('"due, righe\nqui"')).otherwise(F.col("o_orderstatus"))
    line = F.concat_ws(",", date, k.cast("string"), temp, F.when(k % 17 != 0, note), F.when((k % 13 == 0) & (k % 17 != 0), F.lit("oltre")))
    f = F.floor(k / F.lit(FILE_ROWS)).cast("bigint").alias("file_id")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    head = orders.select(f, F.lit(-1).cast("bigint").alias("ord"), F.lit("date,field_id,temp,note").alias("line")).distinct()
    lines = orders.select(f, k.alias("ord"), line.alias("line")).unionByName(head)
    out = scratch_path(spark, "mixed-files")
    lines.repartition("file_id").sortWithinPartitions("file_id", "ord").select("file_id", "line").write.partitionBy("file_id").text(out)
    _CACHE[key] = out
    return out


def write_ordered_files(spark: SparkSession, sf_dir: str) -> str:
    """Comma files of ``orders`` with the day first, with the month first, and with days up to 12 only (by
    file number); returns the folder."""
    key = (spark.sparkContext.applicationId, f"ordered:{sf_dir}")
    if key in _CACHE:
        return _CACHE[key]
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    f = F.floor(k / F.lit(FILE_ROWS)).cast("bigint")
    low = F.concat(F.lpad((1 + k % 12).cast("string"), 2, "0"), F.date_format(day, "/MM/yyyy"))
    date = F.when(f % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(f % 3 == 1, F.date_format(day, "MM/dd/yyyy")).otherwise(low)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = orders.select(f.alias("file_id"), k.alias("ord"), F.concat_ws(",", date, k.cast("string"), F.lit("1")).alias("line"))
    head = orders.select(f.alias("file_id"), F.lit(-1).cast("bigint").alias("ord"), F.lit("date,field_id,temp").alias("line")).distinct()
    out = scratch_path(spark, "ordered-files")
    lines.unionByName(head).repartition("file_id").sortWithinPartitions("file_id", "ord").select("file_id", "line").write.partitionBy("file_id").text(out)
    _CACHE[key] = out
    return out


def file_label(source_file: Column) -> Column:
    """'file_id=N' from a relative path written by ``write_field_files``."""
    return F.regexp_extract(source_file, r"(file_id=[0-9]+)", 1)
