"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every
operator over ``documents`` or ``pages``."""

import pytest
from pyspark.sql import functions as F

from fieldspark.llm.op1_warc import archive_pages
from fieldspark.llm.op2_exact import drop_copies, exact_groups
from fieldspark.llm.op3_pii import find_personal_data
from fieldspark.llm.op4_licenses import scan_licenses
from fieldspark.llm.op5_minhash import drop_near_copies, near_duplicates
from fieldspark.llm.op6_quality import keep_good, score_quality
from fieldspark.llm.op7_html import extract
from fieldspark.llm.op8_toxicity import score_toxicity
from fieldspark.llm.op9_pieces import encode_documents
from fieldspark.llm.op10_decontaminate import contaminated, drop_contaminated

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
LONG = " ".join(f"{w}{i}" for i in range(8000) for w in ("red", "blue", "green"))
DOCS = [(1, "a b c d e f g"), (2, None), (3, ""), (4, LONG), (4, LONG), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, " ".join(WORDS)), (7, "é" * 50_000), (8, "x\x00y\n\n  z")]
EXTRA = "doc_id long, text string, kept string, _text string, class_id string, seeds string, score string, `Weird name` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", "t", "c", "s", "x", "w") for i, t in DOCS]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, "short one"), (None, " ".join(WORDS)), (1, " ".join(WORDS))], "item_id long, text string")


def test_exact_groups(docs):
    rows = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(docs).collect()}
    assert (1, 5, 3, False) in rows and (5, 5, 3, True) in rows and (None, 5, 3, False) in rows
    assert (2, 3, 2, False) in rows and (3, 3, 2, True) in rows and (4, 4, 2, True) in rows and (7, 7, 1, True) in rows
    left = drop_copies(docs)
    assert left.columns == docs.columns and left.count() == 7


def test_near_duplicates(docs):
    rows = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert rows[1] == (1, True) and rows[5] == (1, False) and rows[None] == (None, True)
    assert rows[2] == (2, True) and rows[3] == (2, False) and rows[4] == (4, True)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == 8


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_scores(docs, labels, score):
    rows = score(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_scores_without_labels(docs, labels, score):
    assert {r["score"] for r in score(docs, labels.where("false")).collect()} == {0.5}
    assert keep_good(docs, labels.where("false")).count() == len(DOCS)


def test_pieces(docs):
    rows = encode_documents(docs).collect()
    assert len(rows) == len(DOCS) and all(r["round_trip"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (2, 3)} == {0}


def test_contaminated(docs, bench):
    rows = contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["tiles"]) for r in rows] == [(6, 1, 1.0, 1)]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(DOCS) - 1


def test_spans_and_licenses(docs):
    assert {r["spans"] for r in find_personal_data(docs).collect()} == {""}
    assert scan_licenses(docs).count() == 0


def test_empty_tables(empty, labels, bench, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        exact_groups(empty), drop_copies(empty), near_duplicates(empty), drop_near_copies(empty), score_quality(empty, labels), score_toxicity(empty, labels), encode_documents(empty),
        contaminated(empty, bench), drop_contaminated(empty, bench), find_personal_data(empty), scan_licenses(empty), archive_pages(pages), extract(pages),
    ):
        assert out.count() == 0


def test_empty_benchmark(docs, bench):
    assert contaminated(docs, bench.where("false")).count() == 0


def test_pages(spark):
    big = "<p>" + "word " * 200_000
    rows = [(1, "u", "x" * 100), (2, "u\r\nv", "x" * 100), (3, None, None), (4, "u", ""), (None, "u", "x" * 100), (5, "u", big), (6, "u", "y" * 99), (7, "u", "y" * 99), (1, "u", "x" * 100)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    out = archive_pages(pages)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out.collect()), key=repr)
    want = [(0, 100, "response", None), (1, 100, "response", None), (1, 100, "response", None), (2, 100, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, len(big), "response", None), (6, 99, "response", None), (7, 99, "response", None)]
    assert got == sorted(want, key=repr)
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    assert texts[3] == ("", 0) and texts[4] == ("", 0) and texts[5][1] == len("word " * 200_000) - 1


def test_extra_columns_do_not_change_results(docs):
    plain = docs.select("doc_id", "text")
    for f in (exact_groups, near_duplicates):
        assert sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(plain).collect()))


def test_repartitioning_does_not_change_results(docs):
    one = docs.coalesce(1).orderBy(F.desc("doc_id"))
    for f in (near_duplicates, exact_groups):
        assert sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(one).collect()))
