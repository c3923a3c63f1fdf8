"""Operator 12: spelling variants by dense prefix-suffix tiling.

Words one edit apart share the first or the second half of the longer one. Each word is put under both
halves, as the longer and as the shorter word of a pair; every such group is cut into tiles of at most
about ``TILE`` by ``TILE`` words, each a row of its own. A task lays the words of a tile out as padded
code-point matrices and compares them column by column, all with all: where the lengths of common
prefix and common suffix reach the longer length less one, the two are one edit apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import ship, table, text_of
from fieldspark.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
GAIN = 2  # a form is at least so many times as frequent as the word
TILE = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def altered(run: Column, key: Column, every: int) -> Column:
    """``run``, without its code point h % length where ``every`` divides h = crc32(key:run)."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, every: int = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n over all runs of letters of all texts."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("_run"))
    words = runs.select("_key", F.translate("_run", UPPER, LOWER).alias("_run")).select(altered(F.col("_run"), F.col("_key"), every).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """cls, side, half, longer, word, n: each word under both halves of a pair's longer word of length
    cls, as that word (longer) and as one that lacks a code point of it."""
    length = F.length("word")
    rows = []
    for longer in (True, False):
        cls = length if longer else length + 1
        head = F.floor(cls / 2).cast("int")
        for side in ("head", "tail"):
            half = F.substring("word", F.lit(1), head) if side == "head" else F.substring("word", length - (cls - head) + 1, cls - head)
            rows.append(F.struct(cls.cast("int").alias("cls"), F.lit(side).alias("side"), half.alias("half"), F.lit(longer).alias("longer")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("r")).select("r.*", "word", "n")


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """cls, head (side is the first half), same, a, b (lists of word and n): a row for each tile. The
    longer words of a group meet each other (same: both lists are one) and the shorter ones."""
    rows = _halves(words)
    keys = ["cls", "side", "half"]
    size = rows.groupBy(*keys).agg(F.count_if("longer").alias("x"), F.count_if(~F.col("longer")).alias("y")).where("x > 0 and x + y > 1")
    parts = size.select(*keys, F.ceil(F.col("x") / tile).alias("px"), F.ceil(F.col("y") / tile).alias("py"))
    rows = rows.join(parts, keys)
    own = F.pmod(F.xxhash64("word"), F.when(F.col("longer"), F.col("px")).otherwise(F.col("py")))
    rows = rows.withColumn("own", own)
    none = F.array().cast("array<bigint>")
    upto = F.when(F.col("longer"), F.sequence(F.lit(0).cast("long"), F.col("px") - 1)).otherwise(none)
    # kind 0: longer with longer, parts i <= j, a word lies in i or in j or in both
    both = rows.where("longer").select(*keys, "own", "word", "n", F.explode(upto).alias("o"))
    both = both.select(*keys, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.lit(0).alias("kind"), (F.col("own") <= F.col("o")).alias("first"), "word", "n")
    # kind 1: longer (part i) with shorter (part j)
    other = F.when(F.col("longer"), F.col("py")).otherwise(F.col("px"))
    mixed = rows.where("py > 0").select(*keys, "own", "longer", "word", "n", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias("o"))
    mixed = mixed.select(*keys, F.when(F.col("longer"), F.col("own")).otherwise(F.col("o")).alias("i"), F.when(F.col("longer"), F.col("o")).otherwise(F.col("own")).alias("j"), F.lit(1).alias("kind"), F.col("longer").alias("first"), "word", "n")
    entry = F.struct("word", "n")
    cut = both.union(mixed).groupBy(*keys, "kind", "i", "j").agg(F.collect_list(F.when(F.col("first"), entry)).alias("a"), F.collect_list(F.when(~F.col("first"), entry)).alias("b"))
    same = (F.col("kind") == 0) & (F.col("i") == F.col("j"))
    return cut.select("cls", (F.col("side") == "head").alias("head"), same.alias("same"), "a", "b").where("size(a) > 0 and (same or size(b) > 0)")


def _matrix(words: list[str], width: int, reverse: bool) -> np.ndarray:
    """Code points of the words, a row each, padded with 0 at the end."""
    cells = np.array([w[::-1] if reverse else w for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)
    return cells.astype(np.uint8) if cells.max(initial=0) < 256 else cells


def _common(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Equal leading columns of every row of ``a`` with every row of ``b``."""
    run = np.ones((len(a), len(b)), bool)
    total = np.zeros((len(a), len(b)), np.uint16)
    for j in range(length):
        run &= a[:, j, None] == b[None, :, j]
        if not run.any():
            break
        total += run
    return total


def single_edits(a: list[str], b: list[str], cls: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, length of the common prefix) of the pairs that are one edit apart; words of
    ``a`` have length ``cls``, those of ``b`` the same or one less."""
    shorter = len(b[0])
    prefix = _common(_matrix(a, cls, False), _matrix(b, cls, False), shorter)
    suffix = _common(_matrix(a, cls, True), _matrix(b, cls, True), shorter)
    near = (prefix + suffix >= cls - 1) & (prefix < cls)  # a word is not near itself
    i, j = np.nonzero(near)
    return i, j, prefix[i, j]


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, near, near_n: both directions of every pair of words one edit apart. A pair that shares both
    halves is taken from the group of the first."""
    ship(words.sparkSession)

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for r in range(batch.num_rows):
                cls, head, same = (columns[i][r].as_py() for i in range(3))
                a = columns[3][r].values
                b = a if same else columns[4][r].values
                wa, wb = a.field("word"), b.field("word")
                i, j, prefix = single_edits(wa.to_pylist(), wb.to_pylist(), cls)
                keep = (prefix >= cls // 2) if head else (prefix < cls // 2)
                if same:
                    keep &= i < j
                i, j = pa.array(i[keep]), pa.array(j[keep])
                if len(i):
                    words = pa.concat_arrays([wa.take(i), wb.take(j)])
                    near = pa.concat_arrays([wb.take(j), wa.take(i)])
                    yield pa.RecordBatch.from_arrays([words, near, pa.concat_arrays([b.field("n").take(j), a.field("n").take(i)])], names=["word", "near", "near_n"])

    return tiles(words, tile).mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form), whose chains end: each round jumps to the root's root, so a
    chain of k forms takes log2(k) rounds."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        over = at.select(F.col("word").alias("root"), F.col("root").alias("_over"))
        step = cut_lineage(at.join(over, "root", "left").select("word", F.coalesce("_over", "root").alias("root"), F.col("_over").isNotNull().alias("_moved")))
        at = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; each word once).

    Near words differ by one inserted, deleted or replaced code point. The form of a word is its near
    word of largest n (ties: the least word), if that is GAIN times the word's n or more; root follows
    the forms to the last. Words without near words have n_near 0 and no form; a null word is left out.
    An empty table gives an empty result.
    """
    words = cut_lineage(words.where("word is not null").select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near")))
    near = near_pairs(words, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    full = words.join(near.select("word", "n_near", F.col("b.near").alias("_f"), (-F.col("b.neg")).alias("_fn")), "word", "left")
    takes = F.col("_fn") >= GAIN * F.col("n")
    full = cut_lineage(full.select("word", F.when(takes, F.col("_f")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("_fn")).alias("form_n")))
    last = roots(full.where("form is not null"))
    return full.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the vocabulary of ``docs``. Null texts have no words, a null doc_id counts as empty
    in the hash, rows that repeat a doc_id count each; very long texts are read whole. Other columns are
    not looked at."""
    return variants(vocabulary(docs))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


# In SQL, crc32 runs over the hexadecimal bytes with a table made by its rule. levenshtein() counts bytes,
# so the 64 letters from U+00C0 are given one-byte stand-ins that no lower-cased run has.
_STAND_INS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~"
OP12_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
once AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(key) + 1), lambda i: ('0x' || substr(hex(key), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM once, tab),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n, length(word) AS l, translate(word, '{''.join(map(chr, range(0xC0, 0x100)))}', '{_STAND_INS}') AS z
    FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND a.word <> b.word WHERE levenshtein(a.z, b.z) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS f, max(near_n) AS fn FROM near GROUP BY word),
forms AS (SELECT v.word, CASE WHEN fn >= 2 * n THEN f END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN fn >= 2 * n THEN fn END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
