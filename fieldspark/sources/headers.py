"""Header matching: map messy column headers to canonical names (synonyms + similarity).

Our score (the reference's third-party composite scorer is not available):
``norm`` = lower case, every non letter/digit -> space, trimmed; equal ``norm`` -> 100; else the
larger of the Levenshtein ratio ``100 * (1 - distance / longer length)`` and 90 when one
normalised name is a prefix of the other (shorter side at least 3 characters).
Every header is scored against every target name inline (targets are a fixed list of literals,
so this is a projection, not a join); the best target wins, ties to the smaller canonical name.
A canonical name is given to at most one header per file: the highest score, then the first
position; the other headers keep their names.

``match_headers_composite`` scores with ``functions.similarity.composite`` instead, which also knows
swapped, extra and shared words. It is for long lists of names: an inverted index of q-grams finds the
pairs that can reach the threshold (count filter), and only these are scored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldspark.functions.columns import header_normalise
from fieldspark.functions.similarity import FAR_SCALE, PARTIAL_SCALE, SIMILAR_LENGTH, WORDS_SCALE, composite
from fieldspark.session import ship

# --- fixed values (must equal the reference's behaviour) --------------------------------------
DEFAULT_THRESHOLD = 85.0
SYNONYMS = {
    "date": ["data", "data_rilevazione", "data rilevazione", "timestamp", "giorno", "date_recorded"],
    "field_id": ["campo", "appezzamento", "id_campo", "id appezzamento", "lotto", "field", "plot_id"],
    "temp": ["temperatura", "temperature", "temp_c", "t_aria", "air_temp", "temp_aria_c", "temp_aria"],
    "humidity": ["umidità", "umidita", "humidity", "rh", "relative_humidity", "umidità_relativa", "umidita_relativa", "umidita_relativa_%"],
    "ph": ["ph_suolo", "soil_ph", "acidità", "ph_val", "ph_estratto", "ph_estratto_suolo"],
    "yield": ["resa", "produzione", "harvest", "yield_kg", "produzione_totale", "resa_stima_kg", "resa_stimata", "resa_stimata_kg_ha"],
    "rainfall": ["pioggia", "rainfall", "prec", "precipitazioni", "rain_mm"],
}

# own choices: a header that starts with a synonym of so many characters scores this
PREFIX_SCORE = 90.0
PREFIX_MIN_LEN = 3


def _norm_py(s: str) -> str:
    import regex

    return regex.sub(r"[^\p{L}\p{N}]", " ", s.lower()).strip()


def targets(canonical: list[str], synonyms: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(normalised target, canonical) for every canonical name and all its synonyms."""
    out: dict[str, str] = {}
    for c in canonical:
        out.setdefault(_norm_py(c), c)
    for c, syns in synonyms.items():
        for s in syns:
            out.setdefault(_norm_py(s), c)
    return sorted(out.items())


def score_expr(h: Column, t: str) -> Column:
    """Similarity 0..100 of a normalised header column against one normalised target literal."""
    tl = F.lit(t)
    ratio = F.lit(100.0) - F.lit(100.0) * F.levenshtein(h, tl) / F.greatest(F.length(h), F.lit(len(t)))
    shorter = F.least(F.length(h), F.lit(len(t)))
    prefix = (F.startswith(h, tl) | F.startswith(tl, h)) & (shorter >= F.lit(PREFIX_MIN_LEN))
    return F.when(h == tl, F.lit(100.0)).otherwise(F.greatest(ratio, F.when(prefix, F.lit(PREFIX_SCORE)).otherwise(F.lit(0.0))))


def match_headers(
    catalog: DataFrame, canonical: list[str], synonyms: dict[str, list[str]] | None = None, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """(source_file, pos, header, name, canonical, score): ``canonical`` is NULL when the best
    score is below the threshold or another header of the file won that canonical name."""
    syn = SYNONYMS if synonyms is None else synonyms
    tg = targets(canonical, {c: s for c, s in syn.items()})
    canon_sorted = sorted({c for _, c in tg})
    prio = {c: len(canon_sorted) - i for i, c in enumerate(canon_sorted)}  # smaller name, higher priority
    h = header_normalise(F.col("header"))
    cands = F.array(*[F.struct(score_expr(h, t).alias("score"), F.lit(prio[c]).alias("prio"), F.lit(c).alias("canonical")) for t, c in tg])
    best = F.array_max(cands)
    scored = catalog.withColumn("_best", best).select(
        "source_file", "pos", "header", "name",
        F.when(F.length(h) > 0, F.col("_best.canonical")).alias("_cand"),
        F.col("_best.score").alias("score"),
    )
    return _one_winner(scored, threshold)


def _one_winner(scored: DataFrame, threshold: float) -> DataFrame:
    """Of the headers of a file with the same candidate (_cand), the best takes it."""
    w = Window.partitionBy("source_file", "_cand").orderBy(F.col("score").desc(), F.col("pos").asc())
    ranked = scored.withColumn("_r", F.row_number().over(w))
    ok = F.col("_cand").isNotNull() & (F.col("score") >= F.lit(float(threshold))) & (F.col("_r") == 1)
    return ranked.select("source_file", "pos", "header", "name", F.when(ok, F.col("_cand")).alias("canonical"), "score")


# --- composite similarity through a q-gram index ----------------------------------------------
LEAST_BIGRAM_THRESHOLD = 75.0  # up to this a shared pair of letters isn't certain: single letters are indexed


def _sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(name), " +"))), " ")


def _stretches(text: Column, q: int) -> Column:
    n = F.length(text) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def gram_index(names: DataFrame, q: int, lone: str) -> DataFrame:
    """name, len, words_len, kind, gram, k for ``names`` (name): how often a gram stands in the name with
    its ends marked (r), in its sorted words likewise (s), in both without marks (u, v), and its words
    (t). Names of one character have no pair of letters: kind c pairs them with the names that hold the
    character; ``lone`` says whether this side gives the lone names or the others' characters to it."""
    name, words = F.col("name"), _sorted_words(F.col("name"))

    def marked(c: Column) -> Column:
        return F.concat(F.lit("\u0002"), c, F.lit("\u0003")) if q > 1 else c

    each = {"r": _stretches(marked(name), q), "s": _stretches(marked(words), q), "u": _stretches(name, q), "v": _stretches(words, q), "t": F.split(words, " ")}
    if q > 1:
        each["c1" if lone == "c1" else "c2"] = F.when(F.length(name) == 1, F.array(name)).otherwise(F.array().cast("array<string>"))
        each["c2" if lone == "c1" else "c1"] = F.array_distinct(_stretches(name, 1))

    def named(kind: str, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))

    grams = F.concat(*[named(k, v) for k, v in each.items()])
    rows = names.select("name", F.length(name).alias("len"), F.length(words).alias("words_len"), F.explode(grams).alias("g"))
    return rows.groupBy("name", "len", "words_len", "g.kind", "g.gram").agg(F.count(F.lit(1)).alias("k"))


def candidate_names(heads: DataFrame, targets_: DataFrame, threshold: float) -> DataFrame:
    """(head, target) of ``heads`` and ``targets_`` (name, distinct): a superset of the pairs whose
    composite similarity is ``threshold`` or more, found by shared grams.

    d insertions and deletions leave all but 2 d pairs of letters, so a ratio of at least r means
    max(la, lb) + 1 - 2 (1 - r) (la + lb) common ones (with marks), and a best window of the shorter
    name l - 1 - 4 (1 - r) l (without). Of single letters r (la + lb) / 2 and l r / (2 - r) are common.
    """
    q = 2 if threshold > LEAST_BIGRAM_THRESHOLD else 1
    t = float(threshold) / 100
    a = gram_index(heads, q, "c1").select(F.col("name").alias("head"), F.col("len").alias("la"), F.col("words_len").alias("sa"), "kind", "gram", F.col("k").alias("ka"))
    b = gram_index(targets_, q, "c2").select(F.col("name").alias("target"), F.col("len").alias("lb"), F.col("words_len").alias("sb"), "kind", "gram", F.col("k").alias("kb"))
    found = a.join(b, ["kind", "gram"]).groupBy("head", "target", "la", "lb", "sa", "sb", "kind").agg(F.sum(F.least("ka", "kb")).alias("both"))

    def whole(x: str, y: str, least: float) -> Column:
        if least > 1 + 1e-9:
            return F.lit(False)
        sum_, most = F.col(x) + F.col(y), F.greatest(x, y)
        apart = F.floor((1 - least) * sum_ + 1e-6)
        return F.col("both") >= (most + 1 - 2 * apart if q > 1 else least * sum_ / 2 - 1e-6)

    def window(x: str, y: str, least: float) -> Column:
        if least > 1 + 1e-9:
            return F.lit(False)
        short = F.least(x, y)
        return F.col("both") >= (short - 1 - 2 * F.floor((1 - least) * 2 * short + 1e-6) if q > 1 else short * (least / (2 - least)) - 1e-6)

    longer = F.greatest("la", "lb") / F.least("la", "lb")
    near, scale = longer < SIMILAR_LENGTH, PARTIAL_SCALE if t > FAR_SCALE else 1.0
    kind = F.col("kind")
    keep = (
        kind.isin("t", "c1", "c2")
        | ((kind == "r") & whole("la", "lb", t))
        | ((kind == "s") & near & whole("sa", "sb", t / WORDS_SCALE))
        | ((kind == "u") & ~near & window("la", "lb", t / scale))
        | ((kind == "v") & ~near & window("sa", "sb", t / scale / WORDS_SCALE))
    )
    return found.where(keep).select("head", "target").distinct()


@F.pandas_udf(DoubleType())
def _composite(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([composite(x, y) for x, y in zip(a, b)], dtype="float64")


def match_headers_composite(
    catalog: DataFrame, canonical: list[str], synonyms: dict[str, list[str]] | None = None, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """As ``match_headers``, by composite similarity; ``score`` is NULL where no name reaches the
    threshold. Headers are scored once each, whatever number of files has them."""
    spark = catalog.sparkSession
    ship(spark)
    known = spark.createDataFrame(targets(canonical, SYNONYMS if synonyms is None else synonyms), "target string, _cand string").where("target <> ''")
    h = header_normalise(F.col("header"))
    heads = catalog.select(h.alias("name")).where(F.length("name") > 0).distinct()
    pairs = candidate_names(heads, known.select(F.col("target").alias("name")), threshold)
    scored = pairs.withColumn("score", _composite("head", "target")).where(F.col("score") >= float(threshold)).join(known, "target")
    best = scored.groupBy("head").agg(F.min(F.struct((-F.col("score")).alias("neg"), "_cand")).alias("b"))
    best = best.select(F.col("head").alias("_head"), F.col("b._cand").alias("_cand"), (-F.col("b.neg")).alias("score"))
    full = catalog.select("source_file", "pos", "header", "name", h.alias("_h")).join(best, F.col("_h") == F.col("_head"), "left")
    return _one_winner(full.select("source_file", "pos", "header", "name", "_cand", "score"), threshold)
