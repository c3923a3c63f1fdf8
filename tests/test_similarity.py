"""Composite header similarity and its q-gram index against brute force."""

import random

import pytest

from fieldspark.functions.similarity import composite, lcs, ratio, window_ratio
from fieldspark.sources.headers import SYNONYMS, candidate_names, match_headers_composite


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_lcs_and_ratios():
    g = random.Random(1)
    for _ in range(300):
        a, b = ("".join(g.choices("abc é", k=g.randint(0, 80))) for _ in range(2))
        assert lcs(a, b) == slow_lcs(a, b)
        if a and b:
            assert 0 <= composite(a, b) <= 100 and composite(a, b) == composite(b, a)
    assert ratio("temp", "temp c") == 80 and window_ratio("temp", "aria temp c") == 100
    assert window_ratio("abcd", "xxab") == pytest.approx(200 * 2 / 6)  # cut off at the end


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("temp", "temp", 100.0), ("aria temp", "temp aria", 95.0), ("temp aria esterna", "temp", 90.0), ("esterna media temp", "temp xyz bc", 85.5), ("temperatura aria", "temperatura", 95.0),
        ("umidita relativa", "umidita relative", 100 * 30 / 32), ("", "temp", 0.0), ("a", "a very very long name", 60.0),
    ],
)
def test_scores(a, b, score):
    assert composite(a, b) == pytest.approx(max(score, ratio(a, b)) if a else 0.0)


def names(g, n):
    words = [w for c, syns in SYNONYMS.items() for s in [c, *syns] for w in s.replace("_", " ").replace("%", "").split()] + ["x", "t", "ph", "della", "media"]
    out = set()
    while len(out) < n:
        name = g.choices(words, k=g.randint(1, 4))
        text = " ".join(name)
        for _ in range(g.choice([0, 0, 1, 2])):
            i = g.randrange(len(text) or 1)
            text = text and text[:i] + g.choice(["", "e", "à", text[i] * 2]) + text[i + 1 :]
        text = " ".join(text.split())
        if text:
            out.add(text)
    return sorted(out)


@pytest.mark.parametrize("threshold", [60.0, 78.0, 85.0, 92.0, 100.0])
def test_index_loses_no_pair(spark, threshold):
    g = random.Random(int(threshold))
    heads, known = names(g, 300), names(g, 120)
    frame = [spark.createDataFrame([(x,) for x in v], "name string") for v in (heads, known)]
    pairs = candidate_names(*frame, threshold)
    got = {(r["head"], r["target"]) for r in pairs.collect()}
    want = {(a, b) for a in heads for b in known if composite(a, b) >= threshold}
    assert want <= got and want
    if threshold >= 78:
        assert len(got) < len(heads) * len(known) / 3
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def renamed(spark, headers, required, synonyms=None, threshold=85.0):
    rows = [("f.csv", i, h, h.strip().lower()) for i, h in enumerate(headers)]
    catalog = spark.createDataFrame(rows, "source_file string, pos int, header string, name string")
    return [r["canonical"] for r in match_headers_composite(catalog, required, synonyms or {}, threshold).orderBy("pos").collect()]


def test_words_in_any_order_and_number(spark):
    assert renamed(spark, ["Aria Temp", "Relativa Umidità", "Resa della particella", "altro"], ["temp", "humidity", "yield"], SYNONYMS) == ["temp", "humidity", "yield", None]


def test_one_winner_empty_and_equal_headers(spark):
    got = renamed(spark, ["Temp_C", "Temperatura aria", "temp", "%%", "", "pH", "Temp"], ["temp", "ph"], SYNONYMS)
    assert got == ["temp", None, None, None, None, "ph", None]
    assert renamed(spark, ["q", "q x"], ["q"]) == ["q", None]
