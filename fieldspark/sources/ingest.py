"""Ingest folders of inconsistent delimited files as one validated table.

Pipeline (every step a Spark job over all files at once, not a driver loop over files):

1. ``ranges.file_records``  byte ranges of files of any size -> records (source_file, line_no, line),
   decoded (UTF-8, else Latin-1), with line breaks inside quotes kept
2. ``file_digests`` (source_file, file_hash = SHA-256 of the bytes, fed block by block)
3. ``sniff_layout`` per file, the separator among ``, ; TAB`` whose modal field count is largest
4. ``header_rows``  of the first 15 lines, the one with most cells in hints + required names
5. ``header_catalog`` (source_file, pos, header, name) with names trimmed/lower-cased and,
   optionally, matched to canonical names (``headers.match_headers``)
6. ``parse_rows``   data lines after the header -> map(name -> cell) -> one column per name
   (outer union by name: a file without a column gives NULLs)
7. ``validate``     per-file required-column check; ``raise`` or ``skip`` (left-semi on good files)
8. date normalisation (Excel serials, text formats, the order of day and month by file: see ``dates``);
   rows without a valid date are not in ``df``; ``rejected`` lists them, and lines with too few or too many cells, with a reason.

Row identity is explicit: ``(source_file, line_no)``, also as the text ``rid``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import missing_to_null, name_normalise
from fieldspark.operators.lookup import few
from fieldspark.session import cut_lineage, ensure_checkpoint_dir
from fieldspark.sources.dates import date_orders, parse_ordered
from fieldspark.sources.ranges import RANGE_BYTES, file_records, load_ranges

# --- fixed values (must equal the reference's behaviour) --------------------------------------
REQUIRED_COLUMNS = ("date", "field_id", "temp", "humidity", "ph", "yield")
HEADER_HINTS = (
    "date", "data", "field_id", "campo", "temp", "temperatura", "humidity",
    "umidità", "umidita", "ph", "yield", "resa", "rainfall", "pioggia",
)
HEADER_SCAN_ROWS = 15
SEPARATORS = (",", ";", "\t")
FILE_EXTENSIONS = ("csv", "txt", "tsv")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def file_digests(spark: SparkSession, path: str, extensions: tuple[str, ...] = FILE_EXTENSIONS) -> DataFrame:
    """(source_file relative to ``path``, file_hash) for every matching file below ``path``."""
    return load_ranges(spark, path, "digests", extensions=extensions).select("source_file", "file_hash")


def _re_escape(s: str) -> str:
    import re

    return re.escape(s)


HELD = "\ufdd0"  # stands for a separator or line break inside quotes while text is split (no character)


def hold_quoted(text: Column, sep: Column) -> Column:
    """``text`` with each ``sep`` inside double quotes held back, in linear time: of the pieces between
    quotes, those with an odd number of quotes behind them are quoted."""
    pieces = F.split(text, '"')
    last = F.size(pieces) - 1
    held = F.transform(pieces, lambda x, i: F.when((last - i) % 2 == 1, F.replace(x, sep, F.lit(HELD))).otherwise(x))
    return F.when(text.contains('"'), F.array_join(held, '"')).otherwise(text)


def sniff_layout(lines: DataFrame, seps: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(source_file, sep, n_columns): per separator the modal field count over the file's
    non-empty lines; the separator with the largest modal count (> 1) wins, ties in list order."""
    counts = lines.select(
        "source_file",
        F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.size(F.split(hold_quoted(F.col("line"), F.lit(s)), _re_escape(s))).alias("n")) for i, s in enumerate(seps)])).alias("c"),
    ).groupBy("source_file", "c.k", "c.n").agg(F.count(F.lit(1)).alias("lines"))
    modal = counts.groupBy("source_file", "k").agg(F.max_by("n", F.struct("lines", "n")).alias("mode"))
    best = modal.where(F.col("mode") > 1).groupBy("source_file").agg(
        F.max(F.struct(F.col("mode"), (-F.col("k")).alias("negk"))).alias("b")
    )
    sep_of = F.element_at(_lit_array(seps), (-F.col("b.negk") + 1).cast("int"))
    return best.select("source_file", sep_of.alias("sep"), F.col("b.mode").alias("n_columns"))


def split_cells(line: Column, sep: Column) -> Column:
    """Cells of a delimited line: separators inside double quotes are kept, quoted cells are
    unquoted (``""`` -> ``"``), cells are trimmed."""
    parts = F.split(hold_quoted(line, sep), F.concat(F.lit("\\Q"), sep, F.lit("\\E")))

    def unquote(c: Column) -> Column:
        t = F.trim(F.replace(c, F.lit(HELD), sep))
        quoted = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)
        return F.when(quoted, F.replace(F.substring(t, 2, F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)

    return F.transform(parts, unquote)


def header_rows(lines: DataFrame, layout: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """(source_file, header_line, header ARRAY<STRING>): among the first 15 non-empty lines the
    one with most cells (lower-cased, trimmed) in hints + required; the first wins ties."""
    hints = sorted(set(HEADER_HINTS) | {r.lower() for r in required})
    w = Window.partitionBy("source_file").orderBy("line_no")
    first = lines.join(layout, "source_file").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= HEADER_SCAN_ROWS)
    cells = split_cells(F.col("line"), F.col("sep"))
    scored = first.select(
        "source_file",
        "line_no",
        cells.alias("header"),
        F.size(F.filter(cells, lambda c: F.array_contains(_lit_array(hints), F.lower(F.trim(c))))).alias("score"),
    )
    best = scored.groupBy("source_file").agg(F.max(F.struct("score", (-F.col("line_no")).alias("neg"), "header")).alias("b"))
    return best.select("source_file", (-F.col("b.neg")).alias("header_line"), F.col("b.header").alias("header"))


def header_catalog(headers: DataFrame) -> DataFrame:
    """(source_file, pos, header, name): name = trimmed, lower-cased header."""
    return headers.select("source_file", F.posexplode("header").alias("pos", "header")).withColumn("name", name_normalise(F.col("header")))


def dedupe_names(catalog: DataFrame) -> DataFrame:
    """Repeated names inside one file get ``.1``, ``.2`` suffixes (the first keeps the name)."""
    w = Window.partitionBy("source_file", "name").orderBy("pos")
    k = F.row_number().over(w) - 1
    return catalog.withColumn("name", F.when(k == 0, F.col("name")).otherwise(F.concat("name", F.lit("."), k.cast("string"))))


def parse_rows(lines: DataFrame, layout: DataFrame, header_lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Data lines after each file's header -> (source_file, line_no, cells MAP<name, text>)."""
    names = catalog.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_n"))
    names = names.select("source_file", F.transform("_n", lambda s: s["name"]).alias("names"))
    meta = cut_lineage(layout.join(header_lines.select("source_file", "header_line"), "source_file").join(names, "source_file"))
    body = lines.join(few(meta), "source_file").where(F.col("line_no") > F.col("header_line"))
    cells = split_cells(F.col("line"), F.col("sep"))
    body = body.withColumn("_cells", F.transform(cells, missing_to_null))
    n = F.least(F.size("names"), F.size("_cells"))
    m = F.map_from_arrays(F.slice("names", 1, n), F.slice("_cells", 1, n))
    # PERMISSIVE: a line with a different number of cells than the header is kept and flagged; cells
    # beyond the header go to ``extra_cells``
    malformed = F.size("_cells") != F.size("names")
    extra = F.when(F.size("_cells") > F.size("names"), F.slice("_cells", F.size("names") + 1, F.size("_cells")))
    return body.select("source_file", "line_no", m.alias("cells"), malformed.alias("malformed"), extra.alias("extra_cells"), F.col("line").alias("raw_line"))


@dataclass
class IngestResult:
    df: DataFrame  # validated rows, one column per name (text), provenance, ``malformed`` flag
    files: DataFrame  # (source_file, file_hash, sep, header_line, n_columns, missing, ok, reason[, date_order])
    catalog: DataFrame  # (source_file, pos, header, name)
    rejected: DataFrame  # (source_file, line_no, reason, raw_line): lines that are not in ``df`` as a whole


def ingest(
    spark: SparkSession,
    path: str,
    required: tuple[str, ...] = REQUIRED_COLUMNS,
    synonyms: dict[str, list[str]] | None = None,
    fuzzy: bool = False,
    threshold: float = 85.0,
    on_error: str = "raise",
    normalise_dates: bool = True,
    range_bytes: int = RANGE_BYTES,
    infer_date_order: bool = True,
) -> IngestResult:
    """Load every delimited file below ``path`` into one table (see module doc). Files are cut into
    ranges of ``range_bytes``, so that one file of any size is read by many tasks; each step up to the
    headers reads them anew; tables of a row a file or header and the parsed lines are kept (checkpointed).
    The former are broadcast to the lines up to a bound, so that no line moves."""
    from fieldspark.sources.headers import match_headers_composite

    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")
    hashes = cut_lineage(file_digests(spark, path))
    lines = file_records(spark, path, range_bytes, FILE_EXTENSIONS)
    layout = cut_lineage(sniff_layout(lines))
    hdr = cut_lineage(header_rows(lines, few(layout), required))
    catalog = header_catalog(hdr)
    if fuzzy:
        matched = match_headers_composite(catalog, list(required), synonyms or {}, threshold)
        catalog = matched.select("source_file", "pos", "header", F.coalesce("canonical", "name").alias("name"))
    catalog = cut_lineage(dedupe_names(catalog))
    present = catalog.groupBy("source_file").agg(F.collect_set("name").alias("_names"))
    report = cut_lineage(
        hashes
        .join(layout, "source_file", "left")
        .join(hdr.select("source_file", "header_line"), "source_file", "left")
        .join(present, "source_file", "left")
        .withColumn("missing", F.array_except(_lit_array(list(required)), F.coalesce("_names", F.array().cast("array<string>"))))
        .withColumn("ok", F.col("sep").isNotNull() & (F.size("missing") == 0))
        .withColumn(
            "reason",
            F.when(F.col("sep").isNull(), F.lit("no delimited layout"))
            .when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")))
            .otherwise(F.lit(None)),
        )
        .drop("_names")
    )
    if on_error == "raise":
        bad = report.where(~F.col("ok")).select("source_file", "reason")
        if first := bad.first():
            listed = f"{ensure_checkpoint_dir(spark)}/failed-files-{uuid.uuid4().hex}"
            bad.write.parquet(listed)
            raise ValueError(f"{spark.read.parquet(listed).count()} files failed validation, listed in {listed}; one is {first['source_file']}: {first['reason']}")
    good = report.where("ok").select("source_file")
    # kept, as the order of dates, ``df`` and ``rejected`` read it; a filter on a date over the parse itself
    # would also be pushed below it and split each line anew wherever the date's expression names the cell
    rows = cut_lineage(parse_rows(lines.join(few(good), "source_file", "left_semi"), layout, hdr, catalog))
    all_names = [r["name"] for r in catalog.join(good, "source_file", "left_semi").select("name").distinct().orderBy("name").collect()]
    out = rows.select(
        "source_file",
        "line_no",
        F.concat_ws(":", "source_file", F.lpad(F.col("line_no").cast("string"), 10, "0")).alias("rid"),
        *[F.col("cells").getItem(n).alias(n) for n in all_names],
        "malformed",
    ).join(few(hashes), "source_file")
    no_date = F.lit(False)
    if normalise_dates and "date" in all_names:
        cell, order = F.col("cells").getItem("date"), F.lit(None).cast("string")
        if infer_date_order:
            orders = cut_lineage(date_orders(rows.select("source_file", cell.alias("cell")), ["source_file"]).select("source_file", "date_order"))
            rows, out, report = (x.join(few(orders), "source_file", "left") for x in (rows, out, report))
            order = F.col("date_order")
        no_date = parse_ordered(cell, order).isNull()
        # explode: a filter is not pushed below it, so that the date is parsed once a row
        out = out.withColumn("date", F.explode(F.array(parse_ordered(F.col("date"), order)))).where(F.col("date").isNotNull()).drop("date_order")
    reason = F.when(no_date, F.lit("no readable date")).when(F.size("extra_cells") > 0, F.lit("more cells than the header")).when(F.col("malformed"), F.lit("fewer cells than the header"))
    rejected = rows.select("source_file", "line_no", reason.alias("reason"), "raw_line").where(F.col("reason").isNotNull())
    return IngestResult(out, report, catalog, rejected)
