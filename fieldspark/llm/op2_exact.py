"""Operator 2: exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Pass 1 sets, for each text, ``HASHES`` slots of a counting filter and keeps the slots hit twice or
more as a bitmap table. Pass 2 probes it: a text whose slots were not all hit twice is certainly
single and goes straight to the result; only the others shuffle, by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import BITMAP_ROW, BROADCAST_ROWS, bit_is_set, table, text_of, unused
from fieldspark.session import cut_lineage

HASHES = 2
SLOTS_PER_ROW = 32
MIN_SLOTS, MAX_SLOTS = 1 << 20, 1 << 36


def slots_for(rows: int) -> int:
    """Filter size: about 32 slots a row, a power of two."""
    return min(max(MIN_SLOTS, 1 << (max(rows, 1) * SLOTS_PER_ROW - 1).bit_length()), MAX_SLOTS)


def _places(sha: Column, slots: int) -> tuple[Column, list[Column]]:
    """(bitmap row, the HASHES slots in it) of a text: all its slots lie in one row of the bitmap, so one
    look-up answers for all."""
    row = F.pmod(F.xxhash64(sha, F.lit(0)), F.lit(max(slots // BITMAP_ROW, 1)))
    return row, [F.pmod(F.xxhash64(sha, F.lit(1 + i)), F.lit(min(slots, BITMAP_ROW))) for i in range(HASHES)]


def repeated_slots(keyed: DataFrame, slots: int, sha: str = "_sha") -> DataFrame:
    """(row, bits): the slots that two rows or more have set. A slot is counted within each task
    before the shuffle, so a text that a third of all rows share sends one row a task."""
    row, places = _places(F.col(sha), slots)
    hit = keyed.select(row.alias("row"), F.explode(F.array(*places)).alias("slot")).groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"))
    return hit.where(F.col("n") > 1).groupBy("row").agg(F.bitmap_construct_agg("slot").alias("bits"))


def possibly_repeated(rows: DataFrame, bitmap: DataFrame, slots: int, sha: Column) -> DataFrame:
    """``rows`` with a last column (``_maybe``, if no other has that name): false only where no other row of the filter's table has the same hash.
    A bitmap of up to 16 MB (4 million texts) is broadcast, and rows stay where they are; a larger one
    is joined by its row number, for which the rows move once."""
    at, bits, maybe = unused(rows, "_at", "_bits", "_maybe")
    row, places = _places(sha, slots)
    side = bitmap.toDF(at, bits)
    side = F.broadcast(side) if slots <= BROADCAST_ROWS * BITMAP_ROW else side
    hit = F.lit(True)
    for place in places:
        hit = hit & bit_is_set(bits, place)
    return rows.join(side, row == F.col(at), "left").withColumn(maybe, hit).drop(at, bits)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def _filtered(docs: DataFrame, key: str, text: str, slots: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(key and digest of every row, bitmap of the repeated slots, slots): pass 1."""
    keyed = cut_lineage(docs.select(F.col(key).alias("_key"), _digest(text).alias("_sha")))
    slots = slots or slots_for(keyed.count())
    return keyed, cut_lineage(repeated_slots(keyed, slots)), slots


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if their characters are; a null text counts as empty. The largest key of a group
    stays; rows that repeat that key stay together (they are one document). A group whose keys are
    all null keeps all its rows, keep_id null. An empty table gives an empty result; other columns
    of ``docs`` are not looked at.
    """
    keyed, bitmap, slots = _filtered(docs, key, text, slots)
    probed = cut_lineage(possibly_repeated(keyed, bitmap, slots, F.col("_sha")))
    again = probed.where("_maybe")
    sums = cut_lineage(again.groupBy("_sha").agg(F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    sums = sums.where("group_size > 1")
    found = again.join(sums, "_sha", "left").select("_key", "_sha", "keep_id", "group_size")
    once = probed.where("not _maybe").select("_key", "_sha", F.lit(None).cast(docs.schema[key].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    both = once.unionByName(found)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("_key")).otherwise(F.col("keep_id"))
    return both.select(
        F.col("_key").alias(key),
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("_key").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int | None = None) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep; all columns stay. A row goes by
    key and text together, so a key that also stands on another text keeps that other row. Rows that
    the filter calls single pass straight through; of the others, those with a greater key on the
    same text go."""
    keyed, bitmap, slots = _filtered(docs, key, text, slots)
    again = possibly_repeated(keyed, bitmap, slots, F.col("_sha")).where("_maybe")
    keep = cut_lineage(again.groupBy("_sha").agg(F.max("_key").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_keep"))
    digest, sha, greatest = unused(docs, "_digest", "_sha", "_keep")
    probed = possibly_repeated(docs.withColumn(digest, _digest(text)), bitmap, slots, F.col(digest))
    maybe = F.col(probed.columns[-1])
    gone = (F.col(digest) == F.col(sha)) & ~F.col(key).eqNullSafe(F.col(greatest))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return probed.where(~maybe).select(*names).unionAll(probed.where(maybe).join(keep.toDF(sha, greatest), gone, "left_anti").select(*names))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
