"""Bounded labelled samples and a small calibrated classifier, for operators 6 and 8."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import fold_of, ship, slices, text_of

SAMPLE_BYTES = 16 << 20  # of all texts of a class at most; texts are taken whole


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, held_out: int, most_bytes: int = SAMPLE_BYTES) -> tuple[dict[int, list[str]], dict[int, int]]:
    """At most ``per_class`` whole texts of each label 0 and 1, by the hash of their ids and as far as
    ``most_bytes`` go, and how many rows carry each label. Ids of the held-out fold are left out of
    both. Rows without id or label don't count; of an id with several labels the greatest counts, of
    an id with several texts the least.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("_y"))
    known = known.where(fold_of("doc_id", folds) != held_out)
    count = {int(r["_y"]): r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts: dict[int, list[str]] = {}
    for y in (0, 1):
        ids = known.where(F.col("_y") == y).orderBy(*order).limit(per_class).select("doc_id")
        found = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("_text").alias("_text"))
        upto = F.sum(F.octet_length("_text").cast("long")).over(Window.orderBy(*order))  # over per_class rows at most
        rows = found.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).select("doc_id", "_text").collect()
        texts[y] = [r["_text"] for r in sorted(rows, key=lambda r: str(r["doc_id"]))]
    return texts, count


class Logistic:
    """Logistic regression with standardised features and a ridge penalty, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(50):
            p = self._sigmoid(z @ self.w)
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ self.w)
            self.w += np.clip(step, -2, 2)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    @staticmethod
    def _sigmoid(a: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(x) @ self.w)


def prior_weights(y: np.ndarray, count: dict[int, int]) -> np.ndarray:
    """Row weights that give each class its share of all labelled rows."""
    total = sum(count.values())
    return np.array([len(y) * count[int(v)] / total / max((y == v).sum(), 1) for v in y])


def score_documents(docs: DataFrame, features: Callable | None, model: Logistic | None, folds: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; without a model each score is 0.5.
    ``features`` makes, within a task, the function that turns texts (bytes) into feature rows."""
    ship(docs.sparkSession)
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        of = features() if features else None
        for b in slices(batches, "_text"):
            raw = b.column(2).cast(pa.binary()).to_pylist()
            score = model.score(np.array([of(t) for t in raw])) if of else np.full(len(raw), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), text_of().alias("_text"))
    return narrow.mapInArrow(run, f"doc_id {key_type}, held_out boolean, score double, predicted int")
