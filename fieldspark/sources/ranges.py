"""Delimited files of any size, read by byte ranges.

``DelimitedRanges`` is a Python data source whose partitions are ranges of files; a line belongs to the
range that it begins in, as with Spark's own text reader, and no row holds more than a line. What a
range can't know alone is whether its first line begins inside a quoted cell of an earlier range. Each
line therefore carries the parity of quotes and the number of records before it *within its range*,
counted for both answers; a parallel prefix scan over one summary row a range (``range_states``) gives
the answer, and with it the record that each line belongs to. Lines that are a record of their own
never move; only the lines of records with a quoted line break are grouped.

``option("what", ...)``: ``lines`` (the default), ``ranges`` (the summaries, without lines) or
``digests`` (SHA-256 and size of every file, fed block by block, a file a task).
"""

from __future__ import annotations

import hashlib
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldspark.operators.lookup import few
from fieldspark.session import cut_lineage, ship

RANGE_BYTES = 128 << 20
READ_BYTES = 1 << 20  # a task holds one block of so many bytes, and the line that it is in
PACKED_RANGES, PACKED_BYTES = 64, 1 << 20  # small files or ranges share a task up to these (and a range's size)

SCHEMAS = {
    "lines": "source_file string, range_no int, pos long, line binary, odd_before boolean, odd_after boolean, k0 long, k1 long",
    "ranges": "source_file string, range_no int, n_lines long, odd boolean, k0 long, k1 long, utf8 boolean",
    "digests": "source_file string, n_bytes long, file_hash string",
}


@dataclass(frozen=True)
class Ranges(InputPartition):
    parts: tuple[tuple[str, str, int, int, int], ...]  # (relative name, path, range number, first byte, end)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def line_blocks(f, first: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[list[bytes]]:
    """The lines that begin in [first, end) of an open file, a list for each block read. A carriage
    return before the line break goes with it; the line may end beyond ``end``."""
    at = max(first - 1, 0)  # the byte before tells whether a line begins at ``first``
    f.seek(at)
    skip = first > 0
    held: list[bytes] = []  # pieces of the line that the blocks so far have not ended
    begin = first  # where that line begins
    while True:
        block = f.read(read_bytes)
        if not block:
            if held and not skip and begin < end:
                yield [b"".join(held)]
            return
        pieces = block.split(b"\n")
        if skip:
            if len(pieces) == 1:
                at += len(block)
                continue
            begin = at + len(pieces[0]) + 1
            skip = False
            pieces, held = pieces[1:], []
        elif held:
            pieces[0] = b"".join([*held, pieces[0]]) if len(pieces) > 1 else pieces[0]
        at += len(block)
        lines = []
        for p in pieces[:-1]:
            if begin >= end:
                break
            begin += len(p) + 1
            lines.append(p[:-1] if p.endswith(b"\r") else p)
        if lines:
            yield lines
        if begin >= end:
            return
        held = [*held, pieces[-1]] if len(pieces) == 1 else [pieces[-1]] if pieces[-1] else []


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.what = options.get("what", "lines")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.read_bytes = int(options.get("readbytes", READ_BYTES))
        self.extensions = tuple(f".{e}" for e in options.get("extensions", "csv,txt,tsv").split(","))

    def files(self) -> list[tuple[str, str, int]]:
        """(name relative to the folder, path, size), without hidden files."""
        fs, root = _open(self.path)
        top = fs.get_file_info(root)
        if top.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if top.type == pafs.FileType.File:
            return [(posixpath.basename(root), root, top.size)]
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            name = posixpath.relpath(info.path, root)
            if info.type == pafs.FileType.File and name.endswith(self.extensions) and not any(p[0] in "._" for p in name.split("/")):
                found.append((name, info.path, info.size))
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        cut = self.range_bytes if self.what != "digests" else 1 << 62
        out: list[InputPartition] = []
        part: list[tuple[str, str, int, int, int]] = []
        held = 0
        for name, path, size in self.files():
            for number, first in enumerate(range(0, max(size, 1), cut)):
                end = min(first + cut, size)
                if part and (held + end - first > max(self.range_bytes, PACKED_BYTES) or len(part) >= PACKED_RANGES):
                    out.append(Ranges(tuple(part)))
                    part, held = [], 0
                part.append((name, path, number, first, end))
                held += end - first
        return [*out, Ranges(tuple(part))] if part else out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        for part in partition.parts if partition else ():  # Spark passes None where there are no partitions
            with fs.open_input_file(part[1]) as f:
                yield from getattr(self, f"_{self.what}")(f, *part)

    def _scan(self, f, first: int, end: int):
        """(lines, odd_before, odd_after, k0, k1, first position) of each block of a range."""
        odd, k0, k1, pos = 0, 0, 0, 0
        for lines in line_blocks(f, first, end, self.read_bytes):
            quotes = np.fromiter((x.count(b'"') for x in lines), np.int64, len(lines))
            after = (odd + np.cumsum(quotes)) & 1
            before = np.append(odd, after[:-1])
            ends1 = np.cumsum(after)
            ends0 = np.arange(1, len(lines) + 1) - ends1
            yield lines, before, after, k0 + np.append(0, ends0[:-1]), k1 + np.append(0, ends1[:-1]), pos
            odd, k0, k1, pos = int(after[-1]), k0 + int(ends0[-1]), k1 + int(ends1[-1]), pos + len(lines)

    def _lines(self, f, name: str, path: str, number: int, first: int, end: int):
        for lines, before, after, k0, k1, pos in self._scan(f, first, end):
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(lines, pa.binary()), pa.array(before == 1), pa.array(after == 1), pa.array(k0), pa.array(k1)],
                names=["source_file", "range_no", "pos", "line", "odd_before", "odd_after", "k0", "k1"],
            )

    def _ranges(self, f, name: str, path: str, number: int, first: int, end: int):
        n, odd, ends1, utf8 = 0, False, 0, True
        for lines, _, after, _, k1, pos in self._scan(f, first, end):
            n, odd, ends1 = pos + len(lines), bool(after[-1]), int(k1[-1] + after[-1])
            if utf8:
                try:
                    b"\n".join(lines).decode()
                except UnicodeDecodeError:
                    utf8 = False
        yield pa.RecordBatch.from_pylist(
            [{"source_file": name, "range_no": number, "n_lines": n, "odd": odd, "k0": n - ends1, "k1": ends1, "utf8": utf8}],
            pa.schema([("source_file", pa.string()), ("range_no", pa.int32()), ("n_lines", pa.int64()), ("odd", pa.bool_()), ("k0", pa.int64()), ("k1", pa.int64()), ("utf8", pa.bool_())]),
        )

    def _digests(self, f, name: str, path: str, number: int, first: int, end: int):
        sha, size = hashlib.sha256(), 0
        while block := f.read(self.read_bytes):
            sha.update(block)
            size += len(block)
        yield pa.RecordBatch.from_pylist([{"source_file": name, "n_bytes": size, "file_hash": sha.hexdigest()}])


class DelimitedRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited_ranges"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "lines")]

    def reader(self, schema) -> RangeReader:
        return RangeReader({k.lower(): v for k, v in self.options.items()})


def load_ranges(spark: SparkSession, path: str, what: str = "lines", range_bytes: int = RANGE_BYTES, extensions: tuple[str, ...] = ("csv", "txt", "tsv")) -> DataFrame:
    """One of ``SCHEMAS`` for the files below ``path``. Tasks open files with ``pyarrow.fs`` (local or
    mounted folders, HDFS, S3)."""
    ship(spark)
    spark.dataSource.register(DelimitedRanges)
    reader = spark.read.format("delimited_ranges").option("what", what).option("rangeBytes", range_bytes)
    return reader.option("extensions", ",".join(extensions)).load(path)


def range_states(ranges: DataFrame) -> DataFrame:
    """source_file, range_no, odd_start (does the range begin inside quotes), records_before,
    lines_before, paired (has the file an even number of quotes), utf8 (is the whole file valid).

    A scan over one row for each range (128 MB of a file): the quotes before a range give the parity it
    begins with, that parity picks which of its two record counts holds, and these add up.
    """
    file = Window.partitionBy("source_file")
    before = file.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.col("odd").cast("int")
    at = ranges.withColumn("odd_start", F.coalesce(F.sum(odd).over(before), F.lit(0)) % 2 == 1)
    return at.select(
        "source_file",
        "range_no",
        "odd_start",
        F.coalesce(F.sum(F.when(F.col("odd_start"), F.col("k1")).otherwise(F.col("k0"))).over(before), F.lit(0)).alias("records_before"),
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
        (F.sum(odd).over(file) % 2 == 0).alias("paired"),
        F.min("utf8").over(file).alias("utf8"),
    )


def records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(source_file, line_no, line): the records that are not blank, numbered in file order. A line break
    inside quotes belongs to its record; a file with an odd number of quotes is split at every line
    break. Text is UTF-8 where the whole file is valid, else Latin-1."""
    text = F.when(F.col("utf8"), F.col("line").cast("string")).otherwise(F.decode("line", "ISO-8859-1"))
    start = F.col("odd_start")
    nth = F.col("records_before") + F.when(start, F.col("k1")).otherwise(F.col("k0"))
    rows = lines.join(states, ["source_file", "range_no"]).select(
        "source_file",
        "range_no",
        "pos",
        F.when(F.col("paired"), nth).otherwise(F.col("lines_before") + F.col("pos")).alias("line_no"),
        text.alias("line"),
        (F.col("paired") & ((start != F.col("odd_before")) | (start != F.col("odd_after")))).alias("open"),
    )
    parts = rows.where("open").groupBy("source_file", "line_no").agg(F.sort_array(F.collect_list(F.struct("range_no", "pos", "line"))).alias("parts"))
    joined = parts.select("source_file", "line_no", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"))
    return rows.where("not open").select("source_file", "line_no", "line").unionByName(joined).where(F.length(F.trim("line")) > 0)


def file_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, extensions: tuple[str, ...] = ("csv", "txt", "tsv")) -> DataFrame:
    """``records`` of all delimited files below ``path``; only the states, a row a range, are kept,
    and broadcast up to a bound, so that lines stay in the task that reads them."""
    states = cut_lineage(range_states(load_ranges(spark, path, "ranges", range_bytes, extensions)))
    return records(load_ranges(spark, path, "lines", range_bytes, extensions), few(states))
