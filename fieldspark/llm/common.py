"""Helpers shared by the corpus operators: tables, bounded Arrow slices, vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage, ship  # noqa: F401 - ship is imported from here

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key's decimal text modulo ``folds``; a null key falls in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def slices(batches, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges of at most ``max_bytes`` of text (one row at least)."""
    for b in batches:
        i = b.schema.get_field_index(column)
        size = pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            end = max(int(np.searchsorted(total, base + max_bytes, "right")), at + 1)
            yield b.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark's Python workers live on and serve later stages, and
    without this each keeps the peak of all tasks so far."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_CACHE: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("p", ())) < n:
        _CACHE["p"], _CACHE["q"] = _powers(_P, n), _powers(pow(_P, -1, 1 << 64), n)
    return _CACHE["p"], _CACHE["q"]


def text_bytes(texts: pa.Array, lower: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and row offsets into them; nulls are empty. ``lower`` is None, "ascii"
    (A-Z alone) or "unicode"."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    arr = pc.utf8_lower(arr) if lower == "unicode" else arr
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    if lower == "ascii":  # by hand: pyarrow's ascii_lower loses the text of a cast slice, whose offsets begin above 0
        data = data | ((data - np.uint8(65) < 26).astype(np.uint8) << 5)
    return data, offsets - offsets[0]


def run_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first and end positions of the maximal runs of bytes in ``member`` (256 flags); runs
    end where a row ends. Each block of the buffer takes one prefix sum of a polynomial hash, so the
    memory beside the runs themselves doesn't depend on a text's length (unless a run is as long)."""
    n = len(data)
    inner = offsets[1:-1]
    hashes, firsts, ends, at = [], [], [], 0
    while at < n:
        end = min(at + BLOCK_BYTES, n)
        while end < n and member[data[end]]:  # never cut a run
            gap = np.flatnonzero(~member[data[end : end + BLOCK_BYTES]])
            end += int(gap[0]) if len(gap) else min(BLOCK_BYTES, n - end)
        block = data[at:end]
        word = np.zeros(len(block) + 2, bool)
        word[1:-1] = member[block]
        fresh = word[1:-1] & ~word[:-2]
        last = word[1:-1] & ~word[2:]
        cuts = inner[np.searchsorted(inner, at, "left") : np.searchsorted(inner, end, "left")] - at
        fresh[cuts] = word[1:-1][cuts]
        cuts = cuts[cuts > 0]
        last[cuts - 1] = word[1:-1][cuts - 1]
        start, stop = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        p, q = power_tables(len(block))
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * p[: len(block)], out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * q[start] + (stop - start).astype(np.uint64)))
        firsts.append(start + at)
        ends.append(stop + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(ends)


def word_hashes(texts: pa.Array, lower: str = "unicode") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and row offsets into them.

    A word is a maximal run of ASCII letters, digits and non-ASCII characters, in lower case (of all
    letters, or with ``lower="ascii"`` of A-Z alone).
    """
    data, offsets = text_bytes(texts, lower)
    h, first, _ = run_hashes(data, offsets, _WORD)
    return h, np.searchsorted(first, offsets, "left")


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``n`` words (empty if there are fewer)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(_Q)
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Shingle hashes of one text; a shorter text is one shingle, an empty one has none."""
    if len(words) >= n or not len(words):
        return window_hashes(words, n)
    return window_hashes(words, len(words)) ^ np.uint64(len(words))


FILTER_BITS = 26  # bitmaps sent to every task have 2^26 bits: 8 MB, whatever they are filled from
_FILTER_MASK = (1 << FILTER_BITS) - 1
BITMAP_ROW = 32768  # bits in a row of Spark's bitmap functions
BROADCAST_ROWS = 1 << 12  # bitmap rows that are broadcast: 16 MB at most


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Bitmap with one bit set for the low bits of each hash, put together by Spark in rows of 4 KB; all
    of it, 2^(FILTER_BITS - 3) bytes at most, comes to the driver. Fuller bitmaps let more pass, they
    never lose a hash."""
    slot = F.col(column).bitwiseAND(_FILTER_MASK)
    found = hashes.select(F.floor(slot / BITMAP_ROW).cast("int").alias("at"), (slot % BITMAP_ROW).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for at, bits in found.toLocalIterator():
        out[at * (BITMAP_ROW // 8) : (at + 1) * (BITMAP_ROW // 8)] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose bit is set."""
    slot = hashes.view(np.uint64) & np.uint64(_FILTER_MASK)
    return np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1))


def bit_is_set(bits: str, at: Column) -> Column:
    """Is bit ``at`` of the binary column ``bits`` set? Null bits are not."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int")) == 1, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` without the rows whose ``keys`` (nulls equal nulls) are a row of ``gone`` (each row once).
    A bitmap of about 16 bits a row of ``gone``, broadcast up to 16 MB, lets nearly all other rows pass
    where they are; only those that it may hold are joined, and moved."""
    bucket, bits, maybe = unused(docs, "_bucket", "_bits", "_maybe")
    names = unused(docs, *[f"_gone{i}" for i in range(len(keys))])
    gone = cut_lineage(gone.toDF(*names))
    rows = gone.count()
    if not rows:
        return docs
    buckets = 1 << max(rows * 16 // BITMAP_ROW, 1).bit_length()
    same = F.lit(True)
    for k, g in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(g))
    if buckets > BROADCAST_ROWS:
        return docs.join(gone, same, "left_anti")

    def place(of: list[str]) -> tuple[Column, Column]:
        h = F.xxhash64(*of)
        return F.pmod(h, F.lit(buckets)), F.pmod(F.xxhash64(h), F.lit(BITMAP_ROW))

    row, slot = place(names)
    bitmap = cut_lineage(gone.select(row.alias(bucket), slot.alias("slot")).groupBy(bucket).agg(F.bitmap_construct_agg("slot").alias(bits)))
    row, slot = place(keys)
    probed = docs.join(F.broadcast(bitmap), row == F.col(bucket), "left").withColumn(maybe, bit_is_set(bits, slot))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return probed.where(~F.col(maybe)).select(*names).unionAll(probed.where(F.col(maybe)).join(gone, same, "left_anti").select(*names))
