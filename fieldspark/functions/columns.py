"""Column expressions shared by the operators (all JVM-side, no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) --------------------------------------
# Excel serial day numbers strictly inside this open interval are read as days since 1899-12-30.
EXCEL_SERIAL_MIN = 30000.0
EXCEL_SERIAL_MAX = 60000.0
# Days between 1899-12-30 (Excel epoch) and 1970-01-01 (Unix epoch).
EXCEL_EPOCH_OFFSET_DAYS = 25569
# Dates that arrive as text: day-first or slashed ones are put in ISO order, then ISO text (unpadded
# fields, a space or T before the time, fractions, an offset, which is dropped) is read as wall time.
DATE_ORDERS = (
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})", "$3-$2-$1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
)
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?\s?(Z|[+-]\d{1,2}:?\d{2})?)?$"
NO_NUMBER = r"^\s*\d+[-/]"  # texts that are no number; a failed cast costs far more than this look
# fixed values: texts that stand for a missing cell
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN is 'missing' for the reference; Spark keeps NaN as a value, so map it to NULL."""
    return F.nanvl(col_(c).cast("double"), F.lit(None).cast("double"))


def coerce_numeric(c: str | Column) -> Column:
    """Text with a decimal comma ('12,5') -> 12.5; unparsable text -> NULL; NaN -> NULL."""
    text = F.regexp_replace(F.trim(col_(c).cast("string")), ",", ".")
    return nan_to_null(text.try_cast("double"))


def excel_serial_to_timestamp(x: str | Column) -> Column:
    """Excel serial (days since 1899-12-30, fractions kept) -> TIMESTAMP_NTZ at micro precision."""
    micros = F.round((col_(x) - F.lit(EXCEL_EPOCH_OFFSET_DAYS)) * F.lit(86400000000.0)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def is_excel_serial(x: str | Column) -> Column:
    v = col_(x)
    return (v > F.lit(EXCEL_SERIAL_MIN)) & (v < F.lit(EXCEL_SERIAL_MAX))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once a row, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def parse_timestamp(c: str | Column) -> Column:
    """Text -> TIMESTAMP_NTZ without a detour over the session's time zone; unparsable -> NULL."""
    text = F.trim(col_(c).cast("string"))
    for shape, order in DATE_ORDERS:
        text = F.regexp_replace(text, shape, order)
    zone = r"(:\d{1,2}(?:\.\d{1,9})?)\s?(?:Z|[+-]\d{1,2}:?\d{2})$"
    return once(text, lambda t: F.when(t.rlike(ISO_SHAPE), F.regexp_replace(t, zone, "$1").try_cast("timestamp_ntz")))


def missing_to_null(c: str | Column) -> Column:
    """Texts that stand for a missing cell -> NULL."""
    return F.when(~col_(c).isin(*MISSING_CELLS), col_(c))


def normalise_date(c: str | Column) -> Column:
    """Date normalisation at load: Excel serials, then text formats; anything else -> NULL."""
    v = col_(c)
    text = v.cast("string")
    as_num = F.when(~text.rlike(NO_NUMBER), text.try_cast("double"))
    return once(as_num, lambda n: F.when(is_excel_serial(n), excel_serial_to_timestamp(n)).otherwise(parse_timestamp(v)))


def uniform(seed: int, name: str, key: str | Column) -> Column:
    """Deterministic U[0,1) from md5(seed:name:key); identical in DuckDB, independent of partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), col_(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def header_normalise(c: str | Column) -> Column:
    """Lower case, every non letter/digit to a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col_(c)), r"[^\p{L}\p{N}]", " "))


def name_normalise(c: str | Column) -> Column:
    """Column-name normalisation at load: trim + lower."""
    return F.lower(F.trim(col_(c)))


def schema_hash(names: Column) -> Column:
    """First 16 hex chars of SHA-256 over the comma-joined sorted names (order-insensitive)."""
    return F.substring(F.sha2(F.array_join(F.sort_array(names), ","), 256), 1, 16)


def is_finite(c: str | Column) -> Column:
    v = col_(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
