"""Operator 13: quality rules whose limits are learnt per language and source.

1. Per document: words, their code points, symbols, repeated lines, words in repeated windows.
2. Rates in thousandths go into a quantile sketch for each language and source: counts of log-linear
   buckets (``STEPS`` steps between powers of two), so sketches merge by adding counts, in any order,
   with the same result, and a quantile is off by one bucket (1 / STEPS of its value) at most.
3. Limits are read from the sketch: far fences around the middle half, ``FENCE`` times its width away.
   A middle half narrower than the rule's least width (many rates are 0 nearly everywhere) counts as
   that wide. A group of few documents takes the merged sketch of its language, or of all.
4. Documents are joined with the limits of their group: the few groups that hold more than a
   thousandth of all rows each by broadcast, all others by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import run_hashes, ship, slices, table, text_bytes, text_of, window_hashes
from fieldspark.session import cut_lineage

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of a text's words in repeated windows
WINDOW = 3
STEP_BITS = 6
STEPS = 1 << STEP_BITS
FENCE = 3  # times the width of the middle half, from its ends to the limits
LEAST_WIDTH = {"word_length": 250, "symbols": 30, "dup_lines": 120, "repeat_words": 100}  # thousandths
LEAST_GROUP = 200  # documents of a group with limits of its own
HEAVY_GROUPS = 1000  # a group with more than 1 / HEAVY_GROUPS of all rows is joined by broadcast

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the rows."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen_before(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is an equal key earlier in its row, is an equal key anywhere else in its row)."""
    order = np.lexsort((key, row))
    equal = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    before, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:]] = equal
    other[order[1:]] |= equal
    other[order[:-1]] |= equal
    return before, other


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text. n_lines are the lines with a word."""
    data, offsets = text_bytes(texts)
    rows = len(offsets) - 1
    word = ~_SPACE[data]
    chars = _per_row(word & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)
    h, first, _ = run_hashes(data, offsets, ~_SPACE)
    at = np.searchsorted(first, offsets, "left")
    of = np.repeat(np.arange(rows), np.diff(at))
    grams = window_hashes(h, WINDOW)
    inside = np.flatnonzero(of[WINDOW - 1 :] == of[: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    _, twice = _seen_before(of[inside], grams[inside])
    covered = np.zeros(len(h), bool)
    for k in range(WINDOW):
        covered[inside[twice] + k] = True
    line, begin, end = run_hashes(data, offsets, _LINE)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=words[1:])
    some = words[end] > words[begin]
    line_of = np.searchsorted(offsets, begin[some], "right") - 1
    again, _ = _seen_before(line_of, line[some])
    return [np.diff(at), chars, symbols, np.bincount(line_of, minlength=rows), np.bincount(line_of[again], minlength=rows), _per_row(covered, at)]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "_text"):
            counts = [pa.array(c.astype(np.int64)) for c in text_counts(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *counts], names=["doc_id", "lang", "source", *COUNTS])

    narrow = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_of().alias("_text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _rate(part: str, whole: str) -> Column:
    return F.expr(f"1000 * {part} div {whole}")


def rates() -> dict[str, Column]:
    """Thousandths that the limits are for; null where the text has no words."""
    return {
        "word_length": F.when(F.col("n_words") > 0, _rate("word_chars", "n_words")),
        "symbols": F.when(F.col("n_words") > 0, _rate("n_symbols", "n_words")),
        "dup_lines": F.when(F.col("n_lines") > 0, _rate("n_dup_lines", "n_lines")),
        "repeat_words": F.when(F.col("n_words") > 0, _rate("n_repeat_words", "n_words")),
    }


TWO_SIDED = ("word_length",)


def bucket_of(v: Column) -> Column:
    """Least value of the bucket of a count: itself below 2 STEPS, else its leading STEP_BITS + 1 bits."""
    shift = F.greatest(F.length(F.bin(v)) - F.lit(STEP_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def bucket_end(low: Column) -> Column:
    """Greatest value of the bucket that begins at ``low``."""
    shift = F.greatest(F.length(F.bin(low)) - F.lit(STEP_BITS + 1), F.lit(0))
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def sketch(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: quantile sketches of the rates of ``rows`` (see ``features``)."""
    each = F.array(*[F.struct(F.lit(k).alias("rule"), bucket_of(v).alias("bucket")) for k, v in rates().items()])
    return rows.select("lang", "source", F.explode(each).alias("r")).where("r.bucket is not null").groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all rows of several (of batches, say); counts add up."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))


def _limits_of(level: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, total, low, high of merged sketches. A sketch has a bounded number of buckets."""
    sums = level.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    run = sums.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket")))

    q = run.groupBy(*keys, "rule").agg(F.max("total").alias("total"), quantile(25).alias("q1"), bucket_end(quantile(75)).alias("q3"))
    least = F.coalesce(*[F.when(F.col("rule") == k, F.lit(w)) for k, w in LEAST_WIDTH.items()])
    width = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    low = F.when(F.col("rule").isin(*TWO_SIDED), F.col("q1") - width)
    return q.select(*keys, "rule", "total", low.alias("low"), (F.col("q3") + width).alias("high"))


def limits(sketched: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """lang, source, rows, and low_ and high_ of each rule for every language and source of a sketch."""
    fine = _limits_of(sketched, ["lang", "source"])
    by_lang = _limits_of(sketched, ["lang"]).select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.struct("total", "low", "high").alias("_by_lang"))
    by_all = _limits_of(sketched, []).select(F.col("rule").alias("_all_rule"), F.struct("low", "high").alias("_by_all"))
    full = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
    full = full.join(F.broadcast(by_all), F.col("rule") == F.col("_all_rule"))  # a row for each rule

    def chosen(name: str) -> Column:
        return F.when(F.col("total") >= least_group, F.col(name)).when(F.col("_by_lang.total") >= least_group, F.col(f"_by_lang.{name}")).otherwise(F.col(f"_by_all.{name}"))

    full = full.select("lang", "source", "rule", "total", chosen("low").alias("low"), chosen("high").alias("high"))
    each = [F.max(F.when(F.col("rule") == k, F.col(side))).alias(f"{side}_{k}") for k in rates() for side in ("low", "high")]
    return full.groupBy("lang", "source").agg(F.max("total").alias("rows"), *each)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _join_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the limits of their group, without a task that gets a whole frequent group."""
    names = [c for c in found.columns if c not in ("lang", "source")]
    total = found.agg(F.sum("rows")).first()[0] or 0
    heavy = found.where(F.col("rows") * HEAVY_GROUPS > total)  # fewer than HEAVY_GROUPS rows
    light = found.where(F.col("rows") * HEAVY_GROUPS <= total)

    def same(side: DataFrame):
        side = side.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *names)
        return side, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))

    side, on = same(heavy)
    first = rows.join(F.broadcast(side), on, "left").drop("_l", "_s")
    side, on = same(light)
    rest = first.where("rows is null").drop(*names).join(side, on, "left").drop("_l", "_s")
    return first.where("rows is not null").unionByName(rest)


def quality_rules(docs: DataFrame, learnt: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken (the
    names of the learnt limits that a row breaks) for every row.

    ``learnt`` is a sketch to take limits from (``merge`` of several batches, say); by default that of
    ``docs``. Words are runs without white space. Null and empty texts have no words and fail. A null
    language or source is a group like any other. Repeated rows get equal results, very long texts are
    read whole, an empty table gives an empty result, and other columns are not looked at. A group
    that is missing in ``learnt`` has no limits. Lines and windows are compared by 64-bit hashes.
    """
    rows = cut_lineage(features(docs))
    found = cut_lineage(limits(cut_lineage(sketch(rows)) if learnt is None else learnt))
    out = _join_limits(rows, found)
    breaks = [F.when((v < F.col(f"low_{k}")) | (v > F.col(f"high_{k}")), F.lit(k)) for k, v in rates().items()]
    out = out.withColumn("base_failed", base_failed()).withColumn("broken", F.concat_ws(",", *breaks))
    return out.select("doc_id", *[c for c in COUNTS if c != "n_lines"], "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, generate_subscripts(t, 1) AS i, unnest(t) AS word FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS t FROM d)),
wn AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
gn AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM g WHERE gram IS NOT NULL),
rn AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM gn, range(3) x(j) WHERE k > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN wn USING (r) LEFT JOIN rn USING (r) LEFT JOIN ln USING (r)),
rates AS (SELECT r, lang, source, 'word_length' AS rule, 250 AS least, 1000 * word_chars // n_words AS v FROM f WHERE n_words > 0
    UNION ALL SELECT r, lang, source, 'symbols', 30, 1000 * n_symbols // n_words FROM f WHERE n_words > 0
    UNION ALL SELECT r, lang, source, 'dup_lines', 120, 1000 * n_dup_lines // n_lines FROM f WHERE n_lines > 0
    UNION ALL SELECT r, lang, source, 'repeat_words', 100, 1000 * n_repeat_words // n_words FROM f WHERE n_words > 0),
b AS (SELECT *, greatest(length(bin(v)) - 7, 0) AS s, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS low_end FROM rates),
lev AS (SELECT 'fine' AS level, lang, source, rule, least, s, low_end FROM b UNION ALL SELECT 'lang', lang, NULL, rule, least, s, low_end FROM b UNION ALL SELECT 'all', NULL, NULL, rule, least, s, low_end FROM b),
c AS (SELECT level, lang, source, rule, least, low_end, low_end + (1::BIGINT << s) - 1 AS high_end, count(*) AS n FROM lev GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY low_end) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM c),
q AS (SELECT level, lang, source, rule, least, max(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN low_end END) AS q1, min(CASE WHEN upto * 100 >= total * 75 THEN high_end END) AS q3 FROM u GROUP BY ALL),
lim AS (SELECT level, lang, source, rule, total, CASE WHEN rule = 'word_length' THEN q1 - 3 * greatest(q3 - q1, least) END AS low, q3 + 3 * greatest(q3 - q1, least) AS high FROM q),
chosen AS (SELECT x.lang, x.source, x.rule,
    CASE WHEN x.total >= 200 THEN x.low WHEN y.total >= 200 THEN y.low ELSE z.low END AS low, CASE WHEN x.total >= 200 THEN x.high WHEN y.total >= 200 THEN y.high ELSE z.high END AS high
    FROM lim x JOIN lim y ON y.level = 'lang' AND y.lang IS NOT DISTINCT FROM x.lang AND y.rule = x.rule JOIN lim z ON z.level = 'all' AND z.rule = x.rule WHERE x.level = 'fine'),
bad AS (SELECT t.r, string_agg(t.rule, ',' ORDER BY list_position(['word_length', 'symbols', 'dup_lines', 'repeat_words'], t.rule)) AS broken
    FROM rates t JOIN chosen c ON c.lang IS NOT DISTINCT FROM t.lang AND c.source IS NOT DISTINCT FROM t.source AND c.rule = t.rule WHERE t.v < c.low OR t.v > c.high GROUP BY t.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND broken IS NULL AS kept, coalesce(broken, '') AS broken
FROM f LEFT JOIN bad USING (r)
"""


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
