"""Operator 6: quality by compression. Two zstandard dictionaries, trained on good and on bad
labelled text, compress the windows of a text; the normalised difference of the compressed sizes,
with the ratio of compressed to plain size, becomes a calibrated score."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import ship, table
from fieldspark.llm.labelled import Logistic, labelled_sample, prior_weights, score_documents

FOLDS, HELD_OUT = 3, 1
PER_CLASS = 1600  # labelled texts of each class at most: half for the dictionaries, half for calibration
DICTIONARY_BYTES = 32 << 10
WINDOW = 512
TRAIN_WINDOWS = 8000  # of a class at most
LEVEL = 3


def _windows(raw: bytes) -> list[bytes]:
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def train_dictionary(texts: list[str]) -> bytes | None:
    """Dictionary of the texts' windows, from anywhere in them by hash; None if there is too little text
    to train one."""
    parts = sorted((w for t in texts for w in _windows(t.encode()) if len(w) >= 8), key=lambda w: (zlib.crc32(w), w))[:TRAIN_WINDOWS]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) >= 8 else None
    except zstandard.ZstdError:
        return None


class Sizes:
    """Feature row of a text: difference of the sizes under both dictionaries, shrunk for short texts
    (an empty text has none), and the compression ratio with its square."""

    def __init__(self, good: bytes, bad: bytes):
        self.of = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress for d in (good, bad)]

    def __call__(self, raw: bytes) -> tuple[float, ...]:
        good, bad = self.of
        g = b = 0
        for w in _windows(raw):
            g += len(good(w))
            b += len(bad(w))
        n = len(raw)
        ratio = math.log((g + 16) / (n + 32))
        return (b - g) / (b + g + 64), (b - g) / (n + 64), ratio, ratio * ratio


def fit(docs: DataFrame, labels: DataFrame):
    """(factory of the feature function, calibrated model); (None, None) if a class has too few texts."""
    texts, count = labelled_sample(docs, labels, "quality", PER_CLASS, FOLDS, HELD_OUT)
    good, bad = train_dictionary(texts[1][::2]), train_dictionary(texts[0][::2])
    rest = [(t, y) for y in (0, 1) for t in texts[y][1::2]]
    y = np.array([v for _, v in rest])
    if good is None or bad is None or len(set(y.tolist())) < 2:
        return None, None
    of = Sizes(good, bad)
    x = np.array([of(t.encode()) for t, _ in rest])
    return (lambda: Sizes(good, bad)), Logistic(x, y, prior_weights(y, count))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (see ``score_documents``).

    Null and empty texts get the score of a text without windows, repeated rows get equal scores; a
    null doc_id is in fold 0. With no usable labels every score is 0.5. Very long texts are read
    whole, window by window. Columns beyond doc_id and text are not looked at.
    """
    return score_documents(docs, *fit(docs, labels), FOLDS, HELD_OUT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts that the score rejects; all columns stay."""
    factory, model = fit(docs, labels)
    if model is None:
        return docs
    ship(docs.sparkSession)
    return docs.mapInArrow(_filter(factory, model, docs.columns.index("text")), docs.schema)


def _filter(factory, model, column: int):
    def run(batches):
        of = factory()
        for b in batches:
            raw = b.column(column).fill_null("").cast(pa.binary())
            x = np.array([of(t) for t in raw.to_pylist()]).reshape(b.num_rows, -1)
            yield b.filter(pa.array(model.score(x) >= 0.5)) if b.num_rows else b

    return run


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
