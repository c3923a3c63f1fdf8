"""Operator 8: toxicity by compression distance. Separate zstandard dictionaries, ``PARTS`` of ordinary and
``PARTS`` of toxic labelled text, each from texts of its own, compress every short window of a text. A
window is evidence by the bytes that half of the toxic dictionaries save against the best ordinary one:
what only a few dictionaries happen to hold doesn't count. Calibrated thresholds turn the savings of
all windows into a score."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import table
from fieldspark.llm.labelled import Logistic, labelled_sample, prior_weights, score_documents

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 3000  # labelled texts of each class at most: half for the dictionaries, half for calibration
PARTS = 8  # dictionaries of a class
DICTIONARY_BYTES = 112 << 10  # of a dictionary at most
PIECE_WORDS = 64  # a dictionary takes pieces of so many words by their hash, from anywhere in its texts
WINDOW_WORDS = 8
FIRST = 4  # bytes that the first toxic dictionaries must save against the first ordinary one
THRESHOLDS = (0.5, 1, 1.5, 2, 3, 4, 5)  # bytes that a window must save to count, two features for each
LEVEL = 3
PARAMETERS = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 18, "hash_log": 17, "chain_log": 17}


def distinct_texts(texts: list[str]) -> list[str]:
    """The texts without those of which most sentences stand in an earlier one: a text that is copied
    often would fill the dictionaries of its class."""
    seen: set[str] = set()
    out = []
    for t in texts:
        sentences = {s.strip() for s in re.split(r"[.\n]", t)} - {""}
        if not sentences or 2 * len(sentences & seen) <= len(sentences):
            out.append(t)
        seen |= sentences
    return out


def _spaced(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


def dictionaries(texts: list[str]) -> list[bytes]:
    """Raw dictionaries of the texts, which are dealt out to PARTS of them. One with more text than
    DICTIONARY_BYTES takes the pieces of least hash."""
    out = []
    texts = distinct_texts(texts)
    for part in range(PARTS):
        words = [t.lower().split() for t in texts[part::PARTS]]
        pieces = {_spaced(w[i : i + PIECE_WORDS]) for w in words for i in range(0, len(w), PIECE_WORDS)}
        held, size = [], 0
        for p in sorted(pieces, key=lambda p: (zlib.crc32(p), p)):
            if size + len(p) <= DICTIONARY_BYTES:
                held.append(p)
                size += len(p)
        if size >= 64:
            out.append(b"".join(held))
    return out


class Savings:
    """Feature row of a text from the bytes that its windows save under the toxic dictionaries."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]):
        self.ordinary, self.toxic = ([self._compressor(d) for d in side] for side in (ordinary, toxic))

    @staticmethod
    def _compressor(raw: bytes):
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, **PARAMETERS)
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=p).compress

    def windows(self, raw: bytes) -> list[bytes]:
        words = raw.decode("utf-8", "replace").lower().split()
        return [_spaced(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]

    def saving(self, window: bytes) -> float:
        """Bytes between the shortest ordinary and the median toxic length; 0 if that is less, or if
        the first dictionaries see no difference."""
        plain = len(self.ordinary[0](window))
        first = [len(f(window)) for f in self.toxic[:2]]
        if plain - min(first) < FIRST:
            return 0.0
        plain = min(plain, *(len(f(window)) for f in self.ordinary[1:]))
        toxic = sorted(first + [len(f(window)) for f in self.toxic[2:]])
        n = len(toxic)
        return max(plain - (toxic[(n - 1) // 2] + toxic[n // 2]) / 2, 0.0)

    def __call__(self, raw: bytes) -> tuple[float, ...]:
        saved = np.sort([0.0, 0.0, 0.0, *(self.saving(w) for w in self.windows(raw))])[::-1]
        root = math.sqrt(len(saved) - 2)
        over = [int((saved >= t).sum()) for t in THRESHOLDS]
        return (saved[0], saved[:3].mean(), 2 * math.log(root), saved.sum() / root, *(n / root for n in over), *(math.log1p(n) for n in over))


def fit(docs: DataFrame, labels: DataFrame):
    """(factory of the feature function, calibrated model); (None, None) if a class has too few texts."""
    texts, count = labelled_sample(docs, labels, "toxic", PER_CLASS, FOLDS, HELD_OUT)
    rest = [(t, y) for y in (0, 1) for t in texts[y][1::2]]
    y = np.array([v for _, v in rest])
    if len(set(y.tolist())) < 2:
        return None, None
    pair = dictionaries(texts[0][::2]), dictionaries(texts[1][::2])
    if min(map(len, pair)) < 2:
        return None, None
    of = Savings(*pair)
    x = np.array([of(t.encode()) for t, _ in rest])
    return (lambda: Savings(*pair)), Logistic(x, y, prior_weights(y, count))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (see ``score_documents``).

    Null, empty and white-space texts get the score of a text without windows, repeated rows get
    equal scores; a null doc_id is in fold 0, which is held out. With no usable labels every score
    is 0.5. Very long texts are read whole. Columns beyond doc_id and text are not looked at.
    """
    return score_documents(docs, *fit(docs, labels), FOLDS, HELD_OUT)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
