"""Operator 5: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of the hashed shingles over all documents (2^DF_BITS features).
2. Per document ``HASHES`` consistent weighted samples (Ioffe's method: a sample is equal in two
   documents with the probability of their weighted Jaccard similarity), cut into bands.
3. Texts that are equal are one node. Nodes that share a band meet in a bucket: each is paired with
   the bucket's least node and, in small random parts of the bucket, with each other, so these pairs
   grow with the bucket, not with its square.
4. Pairs are verified by the weighted Jaccard similarity of the whole texts; connected components of
   the verified pairs are the classes.
5. In buckets whose nodes are not in one class yet, all pairs between nodes of different classes are
   compared, in tiles.

All tables here grow with the documents, so every join is stated to be a sort-merge join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import bitmap_of, give_back, in_bitmap, mix, shingles, ship, slices, table, text_of, without, word_hashes
from fieldspark.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
HASHES = BANDS * ROWS
DF_BITS = 18
IDF_STRENGTH = 0.5
PART = 2  # expected nodes in a random part of a bucket of more than SMALL nodes
SMALL = 4  # a bucket of at most so many nodes is one part
TILE_NODES, TILE_BYTES = 256, 4 << 20  # expected nodes and bytes of text on a side of a tile at most
TILE_FEATURES = 1 << 13  # features of a tile that are multiplied at a time
TABLE_BITS = 16  # random numbers of a hash function: one triple for each value of so many bits
_CACHE: dict[str, object] = {}


def idf_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Weight of each feature: 1 for one that all documents have, 1 + IDF_STRENGTH for an unseen one."""
    seen = np.minimum(df, documents)
    return (1 + IDF_STRENGTH * np.log((documents + 1) / (seen + 1)) / np.log(documents + 2)).astype(np.float64)


def _vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingles, their counts) of each text."""
    h, rows = word_hashes(texts)
    return [np.unique(shingles(h[a:b], SHINGLE), return_counts=True) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]


def _feature(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by feature over the whole table (a feature's shingles are counted together), and the
    number of documents. Each task adds up its own counts; 2^DF_BITS sums come to the driver."""

    def run(batches):
        total, rows = np.zeros(1 << DF_BITS, np.int64), 0
        for b in slices(batches, "_text"):
            rows += b.num_rows
            x = [v for v, _ in _vectors(b.column(0))]
            total += np.bincount(_feature(np.concatenate(x)), minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows))], names=["feature", "n"])

    found = docs.select(text_of().alias("_text")).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << DF_BITS, np.int64)
    real = found[found["feature"] >= 0]
    out[real["feature"].to_numpy()] = real["n"].to_numpy()
    return out, int(found.loc[found["feature"] < 0, "n"].sum())


def _randoms() -> list[tuple[np.ndarray, ...]]:
    """(r, 1/r, ln c, beta) tables of each hash function, the same in every process."""
    if "tables" not in _CACHE:
        made, n = [], 1 << TABLE_BITS
        for k in range(HASHES):
            g = np.random.default_rng(7_919 + k)
            r, c, beta = g.gamma(2, 1, n), g.gamma(2, 1, n), g.random(n)
            made.append((r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32)))
        _CACHE["tables"] = made
    return _CACHE["tables"]


def sketch(vectors: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
    """One row of band keys for each non-empty vector."""
    x = np.concatenate([v for v, _ in vectors])
    log_s = np.log(np.concatenate([n for _, n in vectors]) * weight[_feature(x)]).astype(np.float32)
    size = np.array([len(v) for v, _ in vectors])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    keys = np.zeros((len(vectors), BANDS), np.uint64)
    for k, (r, inverse, log_c, beta) in enumerate(_randoms()):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
        at = ((x * odd) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        step = np.floor(log_s * inverse.take(at) + (b := beta.take(at)))
        score = log_c.take(at) - r.take(at) * (step - b + np.float32(1))
        least = np.repeat(np.minimum.reduceat(score, start), size)
        hit = np.flatnonzero(score == least)  # equal scores: the smallest shingle, which stands first
        first = hit[np.searchsorted(hit, start)]
        sample = mix(x[first] + step[first].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        band = k // ROWS
        keys[:, band] = mix(keys[:, band] * np.uint64(31) + sample + np.uint64(k))
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> float:
    """Weighted Jaccard similarity: sum of the lesser over sum of the greater weights."""
    wa, wb = a[1] * weight[_feature(a[0])], b[1] * weight[_feature(b[0])]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    total = wa.sum() + wb.sum() - both
    return float(both / total) if total else 0.0


def band_keys(docs: DataFrame, weights) -> DataFrame:
    """doc_id, _sha, _size, _bands of every row; texts without words have null bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "_text"):
            v = _vectors(b.column(3))
            some = [i for i, (x, _) in enumerate(v) if len(x)]
            bands: list = [None] * len(v)
            if some:
                for i, row in zip(some, sketch([v[i] for i in some], weights.value)):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "_sha", "_size", "_bands"])

    narrow = docs.select("doc_id", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("_sha"), F.octet_length(text_of()).alias("_size"), text_of().alias("_text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, _sha binary, _size int, _bands array<long>")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """node, size, bucket, n, head of ``nodes`` (node, size, bands) in each bucket of n > 1 nodes; head
    is the least. Counts and least nodes are gathered before the shuffle."""
    rows = nodes.select("node", "size", F.posexplode("bands").alias("i", "key")).select("node", "size", F.xxhash64("i", "key").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    return cut_lineage(rows.join(heads.hint("merge"), "bucket"))


def candidate_pairs(full: DataFrame) -> DataFrame:
    """(a, b), a < b: first pairs of ``bucket_rows`` to verify. A bucket of n nodes gives at most n pairs
    with its least node and about n pairs inside its random parts; one of at most SMALL nodes gives all
    its pairs. Parts have keys of their own, so no task gets a whole large bucket."""
    star = full.where(F.col("n") > SMALL).select(F.col("head").alias("a"), F.col("node").alias("b"))
    parts = F.when(F.col("n") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("n") / PART))
    part = F.xxhash64("bucket", F.pmod(F.xxhash64("node", "bucket"), parts))
    groups = full.select(part.alias("part"), "node").groupBy("part").agg(F.sort_array(F.collect_set("node")).alias("g")).where(F.size("g") > 1)
    inside = groups.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    return star.union(inside).where("a < b").distinct()


def open_buckets(full: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, label, size of the large buckets whose nodes are in several classes, with the
    bucket's class of most nodes (big), and nodes and bytes of all (n, bytes) and of the other classes
    (m, rest)."""
    rows = full.where(F.col("n") > SMALL).join(labels.hint("merge"), "node", "left")
    rows = cut_lineage(rows.select("bucket", "node", F.coalesce("label", "node").alias("label"), F.col("size").cast("long").alias("size")))
    sums = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s"))
    top = F.max(F.struct("k", "label", "s"))
    found = sums.groupBy("bucket").agg(F.sum("k").alias("n"), F.sum("s").alias("bytes"), top.alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    found = found.select("bucket", "n", "bytes", F.col("top.label").alias("big"), (F.col("n") - F.col("top.k")).alias("m"), (F.col("bytes") - F.col("top.s")).alias("rest"))
    return cut_lineage(rows.join(found.hint("merge"), "bucket"))


def _items(vectors: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, weights, rows) of all vectors, where a shingle that stands n times gives n keys, and the
    vectors' sums of weights."""
    x, n = np.concatenate([v for v, _ in vectors]), np.concatenate([c for _, c in vectors])
    row = np.repeat(np.repeat(np.arange(len(vectors)), [len(v) for v, _ in vectors]), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x = np.repeat(x, n)
    w = weight[_feature(x)]
    return x + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), w, row, np.bincount(row, w, len(vectors))


def similar(a: list, b: list, weight: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector of ``a`` and of ``b``: is their ``similarity`` ``threshold`` or more? Lesser weights
    are summed as products of 0/1 matrices; what is too near the threshold is computed pair by pair."""
    (ka, wa, ra, ta), (kb, _, rb, tb) = _items(a, weight), _items(b, weight)
    shared, place = np.intersect1d(ka, kb, return_indices=True)[:2]
    shared_weight = wa[place]
    both = np.zeros((len(a), len(b)))
    for at in range(0, len(shared), TILE_FEATURES):
        part = shared[at : at + TILE_FEATURES]
        sides = []
        for k, r, rows in ((ka, ra, len(a)), (kb, rb, len(b))):
            to = np.minimum(np.searchsorted(part, k), len(part) - 1)
            hit = part[to] == k
            side = np.zeros((rows, len(part)))
            side[r[hit], to[hit]] = 1
            sides.append(side)
        both += (sides[0] * shared_weight[at : at + TILE_FEATURES]) @ sides[1].T
    s = both / (ta[:, None] + tb[None, :] - both)
    out = s >= threshold
    for i, j in np.argwhere(np.abs(s - threshold) < 1e-9):
        out[i, j] = similarity(a[i], b[j], weight) >= threshold
    return out


def tile_links(docs: DataFrame, rows: DataFrame, weights, threshold: float) -> DataFrame:
    """(a, b): the similar pairs among all pairs of nodes of different classes of each open bucket.
    Nodes outside the class of most nodes are cut into parts, and so are all nodes; every two parts are
    a tile, compared by a call of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def parts(n: str, size: str):
        return F.ceil(F.col(n) / TILE_NODES + F.col(size) / TILE_BYTES)

    def side(of: DataFrame, number: int):
        mine, other = (("m", "rest"), ("n", "bytes"))[:: 1 if number == 0 else -1]
        own = F.pmod(F.xxhash64("node", "bucket", F.lit(number)), parts(*mine))
        cut = of.select("bucket", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts(*other) - 1)).alias("other"))
        return cut.select(F.xxhash64("bucket", *(("own", "other") if number == 0 else ("other", "own"))).alias("tile"), F.lit(number).alias("side"), "node", "label")

    texts = texts_of(docs, rows.select(F.col("node").alias("id")).distinct())
    tiles = side(rows.where("label <> big"), 0).union(side(rows, 1)).join(texts.withColumnRenamed("id", "node").hint("merge"), "node")

    def run(t: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        number = t.column("side").to_numpy()
        group = []
        for k in (0, 1):
            of = t.filter(pa.array(number == k))
            v = _vectors(pa.array([open_(x).decode("utf-8", "replace") for x in of.column("text").to_pylist()], pa.large_string()))
            some = [i for i, (x, _) in enumerate(v) if len(x)]
            group.append((of.take(pa.array(some, pa.int64())), [v[i] for i in some]))
        (a, va), (b, vb) = group
        if not va or not vb:
            return t.select(["node", "node"]).slice(0, 0).rename_columns(["a", "b"])
        labels = pa.concat_tables([a, b]).column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        i, j = np.nonzero(similar(va, vb, weights.value, threshold) & (labels[: len(va), None] != labels[None, len(va) :]))
        give_back()
        return pa.table({"a": a.column("node").take(pa.array(i)), "b": b.column("node").take(pa.array(j))})

    found = tiles.select("tile", "side", "node", "label", "text").groupBy("tile").applyInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text (compressed) of the rows whose id is in a bitmap of ``ids`` (id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(F.xxhash64("id").alias("h")), "h"))

    def pick(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches, "text"):
            at = pa.array(in_bitmap(bitmap.value, b.column(1).to_numpy(zero_copy_only=False)))
            raw = b.column(2).take(at).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([press(t) for t in raw], pa.binary())], names=["id", "text"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), text_of().alias("text"))
    out = cut_lineage(rows.mapInArrow(pick, f"id {kind}, text binary"))
    bitmap.destroy()
    return out


def verified(docs: DataFrame, pairs: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs whose whole texts are similar enough. Only texts whose id is in a bitmap of the pairs'
    ids move, compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def check(batches):
        w = weights.value
        open_ = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, "ta", 1 << 19):
            va, vb = (_vectors(pa.array([open_(t).decode("utf-8", "replace") for t in b.column(i).to_pylist()], pa.large_string())) for i in (2, 3))
            keep = pa.array([similarity(x, y, w) >= threshold for x, y in zip(va, vb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(0), keep), pc.filter(b.column(1), keep)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component. Every round takes the least of
    the neighbours' labels and of the label's own label; all tables stay in Spark, and each round
    writes one."""
    e = edges.union(edges.select("b", "a")).toDF("u", "v")
    labels = cut_lineage(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    while True:
        near = e.join(labels.select(F.col("u").alias("v"), "label").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("m"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("over"))
        step = labels.join(near.hint("merge"), "u").join(jump.hint("merge"), "label", "left").select("u", "label", F.least("label", "m", F.coalesce("over", "label")).alias("next"))
        step = cut_lineage(step)
        labels = step.select("u", F.col("next").alias("label"))
        if step.where("label <> next").isEmpty():
            return labels.toDF("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``links``: components of the classes that they join."""
    of = [labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b")]
    classes = links.join(of[0].hint("merge"), "a", "left").join(of[1].hint("merge"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    to = components(cut_lineage(classes.where("a <> b").distinct())).toDF("label", "to")
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    every = labels.union(fresh.join(labels, "node", "left_anti"))
    return cut_lineage(every.join(to.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def classes(docs: DataFrame, full: DataFrame, weights, threshold: float) -> DataFrame:
    """(node, label) of the linked nodes. Nodes that share a bucket and are similar have one label,
    whatever pairs are tried first: a bucket is left only when its nodes are in one class or all its
    pairs between classes are compared."""
    tried = cut_lineage(candidate_pairs(full))
    labels = components(cut_lineage(verified(docs, tried, weights, threshold)))
    rows = open_buckets(full, labels)
    if rows.isEmpty():
        return labels
    return merged(labels, cut_lineage(tile_links(docs, rows, weights, threshold)))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept for every row of ``docs``; class_id is the least doc_id of the class, whose
    row is kept.

    Texts whose weighted Jaccard similarity of five-word shingles is ``threshold`` or more are linked,
    and classes are the connected components. Equal texts are always in one class, empty and null
    texts too. A text of fewer than five words is one shingle. Rows that repeat a doc_id are one
    document with several texts and share a decision. Rows with a null doc_id stay, without a class.
    Very long texts are compared whole. An empty table gives an empty result; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(idf_weights(*document_frequencies(docs)))
    keyed = cut_lineage(band_keys(docs, weights))
    same = cut_lineage(keyed.where(F.col("doc_id").isNotNull()).groupBy("_sha").agg(F.min("doc_id").alias("node"), F.first("_size").alias("size"), F.first("_bands").alias("bands")))
    labels = classes(docs, bucket_rows(same.where(F.col("bands").isNotNull())), weights, threshold)
    of = cut_lineage(same.join(labels.hint("merge"), "node", "left").select(F.col("_sha").alias("sha"), F.coalesce("label", "node").alias("class_id")))
    out = keyed.select("doc_id", "_sha").join(of.hint("merge"), F.col("_sha") == F.col("sha"), "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class; all columns stay."""
    return without(docs, near_duplicates(docs, threshold).where(~F.col("kept")).select("doc_id").distinct(), ["doc_id"])


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
