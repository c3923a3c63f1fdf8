"""Operator 11: ranked lexical search, a term at a time with limited accumulators.

1. Query items are taken in blocks of ``BLOCK_BYTES`` of text. A pass over all documents keeps, per
   document, its length and the counts of the block's terms: a forward index without other words.
2. Document frequencies, the number of documents and their total length are aggregates of it.
3. Each task turns chunks of its part of the index into posting lists and runs every item over them,
   rarest term first. A document gets an accumulator only while the terms that are left could still
   lift a new one to the k-th best score known; after that the survivors alone are updated, exactly.
   The k-th best of earlier chunks of the task is the starting bound of the next one.
4. The k best of every task meet in two rankings, the first by salted parts of an item.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import ship, slices, table, text_of, word_hashes
from fieldspark.session import cut_lineage

BEST = 10
BLOCK_BYTES = 4 << 20  # text of the items of a block; the block's terms are what a task gets of it
CHUNK_POSTINGS = 1 << 21  # postings that a task inverts at a time
PARTS = 64  # salted parts of an item in the first ranking

# --- fixed values of the score ------------------------------------------------------------------
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75


def term_weight(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def item_terms(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(sorted hashes of all terms, per text the positions of its terms among them and their counts)."""
    h, rows = word_hashes(pa.array(texts, pa.large_string()), "ascii")
    vocabulary, code = np.unique(h, return_inverse=True)
    return vocabulary, [np.unique(code[a:b], return_counts=True) for a, b in zip(rows[:-1], rows[1:])]


def forward_index(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, codes, counts of every document with a term; codes are those of ``vocabulary`` (a
    broadcast array of hashes) that it holds, ascending, and n counts all its terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        terms = vocabulary.value
        for b in slices(batches, "_text"):
            h, rows = word_hashes(b.column(1), "ascii")
            n = np.diff(rows)
            code = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            hit = np.flatnonzero(terms[code] == h)
            row = np.searchsorted(rows, hit, "right") - 1
            pair, count = np.unique(row * len(terms) + code[hit], return_counts=True)
            some = np.flatnonzero(n)
            start = np.searchsorted(pair // len(terms), np.arange(b.num_rows + 1))
            offsets = pa.array(np.append(start[some], start[some[-1] + 1] if len(some) else 0), pa.int32())
            codes = pa.ListArray.from_arrays(offsets, pa.array(pair % len(terms), pa.int32()))
            counts = pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(n[some]), codes, counts], names=["doc_id", "n", "codes", "counts"])

    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(run, f"doc_id {kind}, n long, codes array<int>, counts array<int>")


class Postings:
    """Posting lists of a chunk of the forward index: per term the documents (ascending positions in
    the chunk), what the term adds to their scores, and the most it adds to any."""

    def __init__(self, n: np.ndarray, codes: np.ndarray, counts: np.ndarray, size: np.ndarray, weight: np.ndarray, documents: int, total: int):
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * documents) // total
        doc = np.repeat(np.arange(len(n)), size)
        order = np.argsort(codes, kind="stable")
        self.doc, code, tf = doc[order], codes[order].astype(np.int64), counts[order].astype(np.int64)
        self.adds = weight[code] * ((SCALE * tf) // (1000 * tf + SATURATION * m[self.doc]))
        self.start = np.searchsorted(code, np.arange(len(weight) + 1))
        held = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(len(weight), np.int64)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds, self.start[held])
        self.documents = len(n)


def best_of_chunk(p: Postings, codes: np.ndarray, counts: np.ndarray, df: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the documents of the chunk that may be among the k best: all whose score
    reaches both ``bound`` and the k-th score of the chunk. ``codes`` are the item's terms."""
    some = p.most[codes] > 0
    codes, counts = codes[some], counts[some]
    order = np.lexsort((codes, df[codes]))
    codes, counts = codes[order], counts[order]
    most = counts * p.most[codes]
    left = np.append(np.cumsum(most[::-1])[::-1], 0)  # what terms i and later add at most
    score = np.zeros(p.documents, np.int64)
    alive: np.ndarray | None = None
    for i, (c, q) in enumerate(zip(codes.tolist(), counts.tolist())):
        if alive is None:
            if left[0] - left[i] > left[i] >= bound:  # some partial score may be above what is left
                partial = score[score > 0]
                if len(partial) >= k:
                    bound = max(bound, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            if left[i] < bound:  # a document without an accumulator stays below the k-th
                alive = np.flatnonzero(score)
        docs, adds = p.doc[p.start[c] : p.start[c + 1]], p.adds[p.start[c] : p.start[c + 1]]
        if alive is None:
            score[docs] += q * adds
            continue
        alive = alive[score[alive] + left[i] >= bound]
        at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
        hit = docs[at] == alive
        score[alive[hit]] += q * adds[at[hit]]
    alive = np.flatnonzero(score) if alive is None else alive
    found = score[alive]
    if len(found) > k:
        bound = max(bound, int(np.partition(found, len(found) - k)[len(found) - k]))
    keep = found >= max(bound, 1)
    return alive[keep], found[keep]


def _chunks(batches):
    """(doc ids, n, codes, counts, sizes) of about CHUNK_POSTINGS postings each."""
    held, postings = [], 0
    for b in batches:
        held.append(b)
        postings += len(b.column(2).flatten())
        if postings >= CHUNK_POSTINGS:
            yield pa.Table.from_batches(held)
            held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _task_best(index: DataFrame, query, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of every task for every item of the block."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches):
        items, df, weight, documents, total = query.value
        best: list[list[tuple[int, object]]] = [[] for _ in items]
        for t in _chunks(batches):
            ids = t.column(0).combine_chunks()
            flat = [t.column(i).combine_chunks() for i in (2, 3)]
            size = pc.list_value_length(flat[0]).to_numpy(zero_copy_only=False)
            p = Postings(t.column(1).to_numpy(), flat[0].flatten().to_numpy(), flat[1].flatten().to_numpy(), size, weight, documents, total)
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            for i, (codes, counts) in enumerate(items):
                bound = -best[i][-1][0] if len(best[i]) >= k else 0
                at, score = best_of_chunk(p, codes, counts, df, k, bound)
                first = np.lexsort((place[at], -score))[:k]
                found = zip((-score[first]).tolist(), ids.take(pa.array(at[first])).to_pylist())
                best[i] = sorted([*best[i], *found])[:k]
        rows = [(i, d, -s) for i, b in enumerate(best) for s, d in b]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, ids.type), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.where(F.col("doc_id").isNotNull()).mapInArrow(run, f"item int, doc_id {kind}, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = rows.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("item", "_p").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, equal scores by doc_id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Null texts have no
    terms; very long ones are read whole. Documents with a null doc_id count in all statistics but are
    not ranked; rows that repeat a doc_id are documents of their own. Items with a null item_id are left
    out; of the rows of one item_id the least text counts. Items without terms, or whose terms no
    document has, give no row, and neither do empty tables. Other columns are not looked at. Terms are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(text_of()).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        names = [r["item_id"] for r in mine]
        vocabulary, terms = item_terms([r["text"] for r in mine])
        if not len(vocabulary):
            continue
        words = spark.sparkContext.broadcast(vocabulary)
        index = cut_lineage(forward_index(docs, words))
        documents, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():
            df[r["code"]] = r["count"]
        query = spark.sparkContext.broadcast((terms, df, term_weight(df, documents), documents, total or 1))
        found = cut_lineage(_ranked(_task_best(index, query, k), k))
        words.destroy()
        query.destroy()
        key = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(key), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
qn AS (SELECT item_id, term, count(*) AS q FROM q GROUP BY item_id, term),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qn) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(t)::BIGINT * big_n) // l) AS m FROM d, s WHERE len(t) > 0),
x AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM qn JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
