"""Reproducible train/val/test split with exact sizes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_sizes(n: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """``floor(n * train)`` rows for train; of the rest ``floor(rest * val / (val + test))`` for val."""
    r_train, r_val, r_test = ratios
    if not math.isclose(r_train + r_val + r_test, 1.0):
        raise ValueError(f"split ratios must sum to 1, got {ratios}")
    n_train = int(math.floor(r_train * n))
    rest = n - n_train
    n_val = int(math.floor((r_val / (r_val + r_test)) * rest)) if (r_val + r_test) > 0 else 0
    return n_train, n_val, rest - n_val


def split_hash(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


DIGITS = 4  # hexadecimal digits that a counting pass looks at: 65 536 counts come to the driver
FEW = 100_000  # rows of a range of hashes whose whole texts are counted


def hash_boundaries(df: DataFrame, hashed: Column, positions: Callable[[int], list[int]]) -> tuple[int, list[str]]:
    """The number of rows, and the hash texts at the 1-based ``positions`` (a function of that number) of
    the ascending order ('' for position 0).

    Positions are found by counting, so no row moves: the first pass counts rows by their first
    digits, each further one looks at the next digits within the ranges that hold a position. Hashes
    are uniform, so up to some billion rows a second pass already counts the texts themselves.
    """
    h = df.select(hashed.alias("h"))

    def counts(depth: int, ranges: set[str]) -> list:
        rows = h.where(F.substring("h", 1, depth).isin(*ranges)) if depth else h
        return rows.groupBy(F.substring("h", 1, depth + DIGITS).alias("k")).count().orderBy("k").collect()

    found = counts(0, set())
    n = sum(r["count"] for r in found)
    wanted = positions(n)
    at = {p: ("", 0) for p in wanted if p > 0}  # position -> (first digits, rows before that range)
    depth = 0
    while at:
        size: dict[str, int] = {}
        for p, (range_, passed) in at.items():
            for r in found:
                if r["k"].startswith(range_):
                    if passed + r["count"] >= p:
                        at[p] = (r["k"], passed)
                        size[r["k"]] = r["count"]
                        break
                    passed += r["count"]
        depth += DIGITS
        if max(size.values()) <= FEW or depth >= 32:
            break
        found = counts(depth, set(size))
    texts = h.where(F.substring("h", 1, depth).isin(*{k for k, _ in at.values()})).groupBy("h").count().orderBy("h").collect() if at else []
    out: dict[int, str] = {}
    for p, (range_, passed) in at.items():
        for r in texts:
            if r["h"].startswith(range_):
                passed += r["count"]
                if passed >= p:
                    out[p] = r["h"]
                    break
    return n, [out.get(p, "") for p in wanted]


def split_exact(df: DataFrame, key: str, ratios=(0.7, 0.2, 0.1), seed: int = 42, col: str = "split") -> DataFrame:
    """Rows in order of ``md5(seed:key)``; the first ``n_train`` are train, the next ``n_val`` val,
    the rest test. Same sizes as the reference; members differ from NumPy's shuffle by design.
    Each row is labelled by comparing its hash with the hashes at the two boundaries, so no row is
    shuffled. Sizes are exact where keys are unique; rows of one key stay together, in the earlier
    part where a boundary falls among them."""
    split_sizes(0, ratios)  # checks them
    h = split_hash(key, seed)

    def ends(n: int) -> list[int]:
        n_train, n_val, _ = split_sizes(n, ratios)
        return [n_train, n_train + n_val]

    _, (last_train, last_val) = hash_boundaries(df, h, ends)
    hashed = df.withColumn("_split_hash", h)  # a column of its own: hashed once a row
    at = F.col("_split_hash")
    return hashed.withColumn(col, F.when(at <= F.lit(last_train), "train").when(at <= F.lit(last_val), "val").otherwise("test")).drop("_split_hash")


def split_counts(df: DataFrame, col: str = "split") -> DataFrame:
    """(split, n) for train/val/test plus a ``total`` row, their sum (``df`` is counted once)."""
    per = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).select(F.lit("total").alias(col), "n")
    return per.unionByName(total)


def split_by_hash(df: DataFrame, key: str, ratios=(0.7, 0.2, 0.1), seed: int = 42, col: str = "split") -> DataFrame:
    """Streaming-friendly variant: each row's split depends only on ``md5(seed:key)`` read as
    U[0,1) (no count, no ranking); sizes match the ratios in expectation, not exactly."""
    from fieldspark.functions.columns import uniform

    r_train, r_val, r_test = ratios
    if not math.isclose(r_train + r_val + r_test, 1.0):
        raise ValueError(f"split ratios must sum to 1, got {ratios}")
    u = uniform(seed, "split", key)
    label = F.when(u < F.lit(r_train), "train").when(u < F.lit(r_train + r_val), "val").otherwise("test")
    return df.withColumn(col, label)
