"""Operator 10: benchmark decontamination by greedy string tiling.

Windows of ``LEAST`` words are the seeds. A fixed-size bitmap of the benchmark's seeds, small enough
for every task, throws out the windows of a document that no item has; the few that stay are joined
with the seed table by equality. A pair of document and item with enough shared seeds is tiled: the
longest non-overlapping matches are marked again and again, found by running Karp-Rabin hashes, and
the share of the item's words under tiles decides. Tiles may come in any order in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import bitmap_of, in_bitmap, power_tables, ship, slices, table, text_of, window_hashes, without, word_hashes
from fieldspark.session import cut_lineage

LEAST = 5  # words of a tile at least
COVERAGE = 0.5  # of an item's words under tiles, from which a document counts as contaminated


def running_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, each from two prefix sums."""
    p, q = power_tables(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=total[1:])
    return (total[size:] - total[: len(total) - size]) * q[: len(words) - size + 1]


def _free_windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of ``size`` words without a marked word."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.zeros(len(words) + 1, np.int64)
    np.cumsum(~free, out=marked[1:])
    at = np.flatnonzero(marked[size:] == marked[: len(marked) - size])
    return at, running_hashes(words, size)[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, words) of the tiles, in the order in
    which they were marked. Of equally long matches the first in the document, then the first in the
    item, is marked.

    Each round looks for the greatest length at which unmarked windows still match, by halving, and
    marks all matches of that length in one walk: a window of the item that is taken never comes back,
    so a round is linear in both texts however often a window repeats.
    """
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    longest = min(len(doc), len(item))
    while longest >= least:
        low, high = least - 1, longest  # windows of ``low`` words match (or are too short), longer than ``high`` don't
        while low < high:
            size = (low + high + 1) // 2
            if np.intersect1d(_free_windows(doc, doc_free, size)[1], _free_windows(item, item_free, size)[1]).size:
                low = size
            else:
                high = size - 1
        if low < least:
            break
        places: dict[int, list[int]] = {}
        at, h = _free_windows(item, item_free, low)
        for j, x in zip(at[::-1].tolist(), h[::-1].tolist()):
            places.setdefault(x, []).append(j)  # the first in the item last
        at, h = _free_windows(doc, doc_free, low)
        end = 0
        for i, x in zip(at.tolist(), h.tolist()):
            stack = places.get(x)
            if i < end or not stack:
                continue
            while stack and not item_free[stack[-1] : stack[-1] + low].all():
                stack.pop()
            if stack and np.array_equal(doc[i : i + low], item[stack[-1] : stack[-1] + low]):
                j, end = stack.pop(), i + low
                doc_free[i:end] = False
                item_free[j : j + low] = False
                out.append((i, j, low))
        longest = low - 1
    return out


def _words(texts) -> list[np.ndarray]:
    h, rows = word_hashes(pa.array(texts, pa.large_string()))
    return [h[a:b] for a, b in zip(rows[:-1], rows[1:])]


def _seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, item_words, position, seed of every window of every item; items of fewer words than a
    tile have none."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "_text"):
            h, rows = word_hashes(b.column(1))
            for r in range(b.num_rows):
                words = h[rows[r] : rows[r + 1]]
                seeds = window_hashes(words, LEAST).view(np.int64)
                n = len(seeds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, len(words)), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(seeds)], names=["item_id", "item_words", "position", "seed"])

    return benchmark.select("item_id", text_of().alias("_text")).mapInArrow(run, f"item_id {kind}, item_words int, position int, seed long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, coverage, tiles: one row per document and benchmark
    item of which at least ``coverage`` of the words lie under tiles.

    Words are runs of letters and digits in lower case. Null and empty texts and items, and items of
    fewer than ``LEAST`` words, give no row. Rows that repeat a doc_id (or item_id) are tiled one by
    one and the greatest coverage of the pair counts; rows with a null doc_id or item_id are left
    out. Very long texts are read whole. Empty tables give an empty result; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where(F.col("item_id").isNotNull())
    seeds = cut_lineage(_seeds(items).distinct())
    bitmap = spark.sparkContext.broadcast(bitmap_of(seeds, "seed"))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def candidates(batches):
        bits = bitmap.value
        for b in slices(batches, "_text"):
            h, rows = word_hashes(b.column(1))
            grams = window_hashes(h, LEAST)
            hit = in_bitmap(bits, grams)
            row = np.searchsorted(rows, hit, "right") - 1
            keep = hit + LEAST <= rows[row + 1]  # windows within one text
            hit, row = hit[keep], row[keep]
            which, first = np.unique(row, return_index=True)
            if len(which):
                found = [np.unique(x).view(np.int64) for x in np.split(grams[hit], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)), b.column(1).take(pa.array(which)), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "text", "seeds"],
                )

    narrow = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("_text"))
    near = cut_lineage(narrow.mapInArrow(candidates, f"doc_id {kind}, text string, seeds array<long>"))
    # each word under a tile lies in a shared seed, and a seed covers LEAST words: a pair shares at least
    # ``needed`` positions of the item, so one of them is left when the needed - 1 most frequent go
    found = near.select("doc_id", F.explode("seeds").alias("seed"))
    often = found.groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    needed = F.greatest(F.ceil(F.col("item_words") * coverage / LEAST), F.lit(1))
    nth = F.row_number().over(Window.partitionBy("item_id", "item_words").orderBy(F.desc("often"), "position"))
    rare = seeds.join(often, "seed").withColumn("needed", needed).withColumn("nth", nth).where("nth >= needed").select("seed", "item_id", "item_words", "needed").distinct()
    pairs = found.join(rare, "seed").select("doc_id", "item_id", "item_words", "needed").distinct()
    whole = seeds.groupBy("item_id", "item_words").agg(F.collect_list("seed").alias("all"))  # of one item
    pairs = cut_lineage(pairs.join(whole, ["item_id", "item_words"]).join(near.select("doc_id", "seeds"), "doc_id")
        .where(F.size(F.filter("all", lambda x: F.array_contains("seeds", x))) >= F.col("needed")).select("doc_id", "item_id").distinct())
    both = pairs.join(items.select("item_id", text_of().alias("item_text")), "item_id").join(near.select("doc_id", "text"), "doc_id")

    def tile(batches):
        for b in slices(batches, "text"):
            doc_of, item_of = _words(b.column(1)), _words(b.column(3))
            found = [tiles(d, i) for d, i in zip(doc_of, item_of)]
            n = np.array([len(i) for i in item_of], np.int64)
            c = np.array([sum(t[2] for t in f) for f in found], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(c), pa.array(c / np.maximum(n, 1)), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"])

    tiled = both.select("doc_id", "text", "item_id", "item_text").mapInArrow(tile, f"doc_id {kind}, item_id {item_kind}, item_words long, covered_words long, coverage double, tiles long")
    best = F.max(F.struct("coverage", "covered_words", "item_words", "tiles")).alias("b")
    return tiled.where(F.col("coverage") >= coverage).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_words", "b.covered_words", "b.coverage", "b.tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` names; all columns stay, and rows with a
    null doc_id stay."""
    return without(docs, contaminated(docs, benchmark, coverage).select("doc_id").distinct(), ["doc_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
