"""Operators 11 to 13 against brute force, SQL and the cases of every column."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import op11_search as search_module
from fieldspark.llm.common import word_hashes
from fieldspark.llm.op11_search import Postings, best_of_chunk, search, term_weight
from fieldspark.llm.op12_variants import RUN, near_pairs, roots, single_edits, spelling_variants, tiles, variants, vocabulary
from fieldspark.llm.op13_rules import COUNTS, bucket_end, bucket_of, features, limits, merge, quality_rules, sketch, text_counts
from fieldspark.llm.queries import ORACLE, QUERIES
from fieldspark.plans.compare import compare, duckdb_connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_search", "op12_variants", "op13_rules"])
def test_sql(spark, sf001, name):
    assert compare(QUERIES[name](spark, sf001), duckdb_connect(sf001), ORACLE[name])["match"]


# --- operator 11 ----------------------------------------------------------------------------------
def brute_search(docs, items, k):
    held = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scored = []
        for d, t in held:
            tf, m = Counter(t), 100 - 75 + (75 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in asked if tf[w])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search_is_brute_force(spark):
    g = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rate = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(g.choices(words, rate, k=g.randint(0, 30)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties of more than k documents
    docs += [(None, "w1 w59"), (2000, None), (2001, ""), (2002, "W1, É-é w1"), (3, "w3 w59"), (2003, "w5 " * 20_000)]
    items = [(i, " ".join(g.choices(words, k=8))) for i in range(20)] + [(20, None), (21, ""), (22, "nowhere"), (23, "É w59 w59"), (24, "é"), (25, docs[7][1])]
    items += [(None, "w1")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, item int").repartition(5)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = brute_search(docs, items[:-1], 10)
    for block in (1 << 22, 60):
        got = search(d, q, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == want
    assert [r["doc_id"] for r in got.where("item_id = 25").orderBy("rank").collect()] == [7, *range(1000, 1009)]
    assert search(d.where("false"), q).count() == search(d, q.where("false")).count() == 0
    one = d.coalesce(1).orderBy(F.rand(3))
    assert sorted(map(tuple, search(one, q).collect())) == want


def test_search_reads_every_slice(spark):
    """Documents behind the first slice of an Arrow batch are ranked and counted as well."""
    texts = ["Aa bB, É-é @[`{ zZ9", "", None, "ÀZ az AZ"]
    whole = pa.array(texts * 3, pa.string())
    h, rows = word_hashes(whole, "ascii")
    for at in range(12):
        part, inner = word_hashes(whole.slice(at, 3), "ascii")
        end = min(at + 3, 12)
        assert part.tolist() == h[rows[at] : rows[end]].tolist() and inner.tolist() == (rows[at : end + 1] - rows[at]).tolist()
    g = random.Random(9)
    docs = [(i, " ".join(g.choices([f"W{j}" for j in range(40)], k=3000))) for i in range(300)]  # 3 MB: two slices
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = [(i, " ".join(g.choices([f"w{j}" for j in range(40)], k=5))) for i in range(4)]
    got = search(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_search(docs, items, 10)


def test_string_ids(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in search(d, q).collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_limited_accumulators_keep_the_best():
    g = np.random.default_rng(2)
    for _ in range(60):
        docs, terms, k = int(g.integers(1, 200)), int(g.integers(1, 12)), int(g.integers(1, 6))
        held = g.random((docs, terms)) < g.random(terms) ** 3
        tf = np.where(held, g.integers(1, 4, (docs, terms)), 0)
        row, code = np.nonzero(tf)
        n = tf.sum(axis=1) + 1
        df = (tf > 0).sum(axis=0)
        p = Postings(n, code.astype(np.int32), tf[row, code].astype(np.int32), (tf > 0).sum(axis=1), term_weight(df, docs), docs, int(n.sum()))
        counts = g.integers(1, 3, terms)
        full = np.zeros(docs, np.int64)
        for c in range(terms):
            at = slice(p.start[c], p.start[c + 1])
            full[p.doc[at]] += counts[c] * p.adds[at]
        top = np.sort(full[full > 0])[::-1][:k]
        bound = int(top[-1]) if len(top) == k and g.random() < 0.5 else 0
        at, score = best_of_chunk(p, np.arange(terms), counts, df, k, bound)
        assert (score == full[at]).all()
        assert np.sort(score)[::-1][:k].tolist() == top.tolist()
        if len(top):
            assert set(np.flatnonzero(full >= max(top[-1], 1) if len(top) == k else full > 0)) <= set(at.tolist())


def test_accumulators_stop(monkeypatch):
    """Once the rare term has given k good scores, the frequent term opens none of its 10 000."""
    docs = 10_000
    code = np.concatenate([np.zeros(20, np.int32), np.ones(docs, np.int32)])
    row = np.concatenate([np.arange(20), np.arange(docs)])
    order = np.argsort(row, kind="stable")
    df = np.array([20, docs])
    p = Postings(np.full(docs, 2), code[order], np.ones(docs + 20, np.int32), np.bincount(row), term_weight(df, docs) + 1, docs, 2 * docs)
    opened = []
    plain = np.flatnonzero
    monkeypatch.setattr(search_module.np, "flatnonzero", lambda x: opened.append(out := plain(x)) or out)
    at, _ = best_of_chunk(p, np.array([0, 1]), np.array([1, 1]), df, 10, 0)
    assert at.tolist() == list(range(20)) and [len(x) for x in opened] == [20]


# --- operator 12 ----------------------------------------------------------------------------------
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(count):
    near = {a: [b for b in count if one_edit(a, b)] for a in count}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-count[b], b), default=None)
        form[a] = best if best and count[best] >= 2 * count[a] else None
    out = []
    for a in count:
        last = a
        while form[last]:
            last = form[last]
        out.append((a, form[a], last, count[a], len(near[a]), count[form[a]] if form[a] else None))
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 3, 512])
def test_variants_are_brute_force(spark, tile):
    g = random.Random(tile)
    words = {"".join(g.choices("abé", k=g.randint(1, 7))) for _ in range(250)} | {"éèêë", "😀bcde", "😀bcd", "aaaaa", "aaaaaa", "aaaaaaa"}
    count = {w: g.choice([3, 4, 8, 16, 40, 100]) for w in words}
    df = spark.createDataFrame([*count.items(), (None, 9)], "word string, n long").repartition(4)
    assert sorted(map(tuple, variants(df, tile).collect()), key=lambda r: r[0]) == brute_variants(count)
    pairs = [(r["word"], r["near"]) for r in near_pairs(df.where("word is not null"), tile).collect()]
    assert len(pairs) == len(set(pairs)) and all(one_edit(a, b) for a, b in pairs)


def test_tiles_are_bounded(spark):
    """Words that share both halves with many others are spread over tiles of about the given size."""
    words = spark.range(3000).select(F.concat(F.lit("prefix"), F.lpad(F.conv("id", 10, 26), 6, "0")).alias("word"), F.lit(3).cast("long").alias("n"))
    size = tiles(words, 64).agg(F.max(F.greatest(F.size("a"), F.size("b")))).first()[0]
    assert 64 <= size < 160


def test_single_edits_of_equal_lengths_and_doubled_letters():
    i, j, _ = single_edits(["aabb", "abab"], ["aabb", "abbb"], 4)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (1, 1)]
    i, j, _ = single_edits(["aaaa", "abca"], ["aaa", "aca"], 4)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 1)]


def test_roots_follow_long_chains(spark):
    n = 40
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)], "word string, form string")
    assert {(r["word"], r["root"]) for r in roots(chain).collect()} == {(f"w{i}", f"w{n}") for i in range(n)}


def test_vocabulary_is_brute_force(spark):
    g = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("Été", "house", "GARDEN") for b in ("x", "ÿ", "") for c in "abcdefg"]
    docs = [(i, " ".join(g.choices(words, k=60)) + ",9 _" + "×÷") for i in range(120)] + [(None, "house housea " * 3), (5, None), (6, ""), (7, "longword " * 30_000), (7, "longword")]
    count = Counter()
    for d, t in docs:
        for run in re.findall(RUN, t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, word string, n string").repartition(3)
    assert {r["word"]: r["n"] for r in vocabulary(df).collect()} == want
    assert sorted(map(tuple, spelling_variants(df).collect()), key=lambda r: r[0]) == brute_variants(want)
    assert spelling_variants(df.where("false")).count() == 0


# --- operator 13 ----------------------------------------------------------------------------------
def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, x in enumerate(grams) if often[x] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)]


def test_counts_are_brute_force():
    g = random.Random(3)
    texts = ["".join(g.choices(["a", "b", "é", " ", "\n", "\t", "\r", "#", " ", "😀", "a b c ", "\n \n", "x\n"], k=g.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "\n\n", "a", "a b c a b c", "a a a a", "é é é é", "same line\n" * 40_000, "word" * 600_000, "\x00 \x00"]
    got = text_counts(pa.array(texts))
    assert [list(map(int, r)) for r in zip(*got)] == [brute_counts(t) for t in texts]
    assert [int(c[0]) for c in text_counts(pa.array([None], pa.string()))] == [0] * len(COUNTS)


def test_buckets_hold_their_counts(spark):
    rows = spark.range(100_000).select("id", bucket_of(F.col("id")).alias("b")).withColumn("e", bucket_end(F.col("b")))
    assert rows.where("not (b <= id and id <= e) or (e - b) * 64 > greatest(b, 1)").isEmpty()
    assert rows.select(F.countDistinct("b")).first()[0] < 128 + 64 * 10


@pytest.fixture(scope="module")
def rule_docs(spark):
    g = random.Random(11)
    rows = []
    for i in range(900):
        words = ["".join(g.choices("abcdefgh", k=g.randint(3, 7))) for _ in range(g.randint(55, 90))]
        if i % 30 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), ("en", "de", None)[i % 3], "hot" if i % 2 else f"s{i % 5}"))
    rows += [(1000, None, "en", "hot"), (1001, "", None, None), (1002, "short text", "en", "hot"), (1003, "say it again " * 40, "en", "rare"), (1004, rows[1][1], "en", "rare"), (None, rows[1][1], "de", "hot"), (1, rows[1][1], "de", "hot"), (1005, "b" * 300_000, "de", "hot")]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, kept string, n_words int, rows int").repartition(7)


def test_rules_learn_limits(rule_docs):
    rows = quality_rules(rule_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 908
    assert all(not by[i]["kept"] and "symbols" in by[i]["broken"] for i in range(0, 900, 30))
    assert sum(not by[i]["kept"] for i in range(900) if i % 30) == 0
    for i in (1000, 1001, 1002, 1003, 1005):
        assert by[i]["base_failed"] and not by[i]["kept"]
    assert by[1004]["kept"] and by[None]["kept"]
    again = quality_rules(rule_docs.coalesce(1).orderBy(F.rand(1))).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert quality_rules(rule_docs.where("false")).count() == 0


def test_sketches_merge(rule_docs):
    rows = features(rule_docs)
    parts = [sketch(rows.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == k)) for k in range(3)]
    whole = sketch(rows)
    assert sorted(map(repr, merge(*parts).collect())) == sorted(map(repr, whole.select("lang", "source", "rule", "bucket", "n").collect()))
    learnt = quality_rules(rule_docs, merge(*parts))
    assert sorted(map(repr, learnt.collect())) == sorted(map(repr, quality_rules(rule_docs).collect()))


def test_small_groups_take_merged_limits(rule_docs):
    found = {(r["lang"], r["source"]): r for r in limits(sketch(features(rule_docs)), 100).collect()}
    assert found["en", "rare"]["high_symbols"] == found["en", "s0"]["high_symbols"]  # both are of all "en"
    assert found["en", "rare"]["rows"] == 2
