"""Exact quantiles by distributed selection (no value set gathered on one task).

Spark's exact ``percentile`` merges every distinct value of a group on one task; at 100 TB that
is unbounded. Here each wanted order statistic is found by narrowing a value bracket:

1. one aggregate gives ``count/min/max`` per target; where a bound is infinite, another counts the
   infinite values, which are the outermost ranks, and bounds the finite ones;
2. one aggregate counts the bracket's values in ``buckets`` equal-width buckets (with per-bucket
   min/max, so the next bracket is exact data values) and keeps the bucket that holds the wanted
   rank; a bracket's bounds fall in different buckets, so each pass shrinks it, until one value is
   left. There is no iteration limit and no size at which the method changes.

Every job reads only the target columns and returns at most ``targets x buckets`` rows.
The interpolation is linear between the order statistics at ``floor(h)`` and ``ceil(h)`` with
``h = (n - 1) * p`` (pandas' default, SQL ``percentile_cont``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass
class _Bracket:
    target: str
    lo: float
    hi: float
    below: int
    inside: int
    ranks: set[int] = field(default_factory=set)
    log_scale: bool = False


def _in_bracket(v: Column, br: _Bracket) -> Column:
    return v.isNotNull() & (v >= F.lit(br.lo)) & (v <= F.lit(br.hi))


def _bucket_expr(v: Column, br: _Bracket, buckets: int) -> Column:
    if br.log_scale and math.asinh(br.lo) < math.asinh(br.hi):
        lo, hi = math.asinh(br.lo), math.asinh(br.hi)
        x = F.asinh(v)
    else:
        lo, hi = br.lo, br.hi
        x = v
    width = hi - lo
    if not math.isfinite(width) or width <= 0:
        lo, hi, x = lo / 2.0, hi / 2.0, x / F.lit(2.0)
        width = hi - lo
    raw = F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(float(buckets)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(buckets - 1)).cast("int")


def order_statistics(
    df: DataFrame,
    values: dict[str, Column],
    ranks: dict[str, set[int]],
    stats: dict[str, tuple[int, float, float]],
    buckets: int = BUCKETS,
) -> dict[tuple[str, int], float]:
    """Values at 0-based ``ranks`` (ascending, nulls excluded) for each target expression. Infinite
    values count as the outermost ranks; a rank that stays unresolved raises."""
    values = {t: v.cast("double") for t, v in values.items()}
    endless = [t for t, rs in ranks.items() if stats[t][0] and rs and not (math.isfinite(stats[t][1]) and math.isfinite(stats[t][2]))]
    outer = _infinite(df, {t: values[t] for t in endless})
    result: dict[tuple[str, int], float] = {}
    active: list[_Bracket] = []
    for t, rs in ranks.items():
        n, mn, mx = stats[t]
        if n == 0 or not rs:
            continue
        below, above, lo, hi = outer.get(t, (0, 0, mn, mx))
        result.update({(t, r): -math.inf for r in rs if r < below})
        result.update({(t, r): math.inf for r in rs if r >= n - above})
        inner = {r for r in rs if below <= r < n - above}
        if inner:
            active.append(_Bracket(t, float(lo), float(hi), below, n - below - above, inner))

    while active:
        to_split: list[_Bracket] = []
        for br in active:
            if br.lo == br.hi or br.inside == 1:
                for r in br.ranks:
                    result[(br.target, r)] = br.lo
            else:
                to_split.append(br)
        active = []
        if to_split:
            items = [
                F.when(
                    _in_bracket(values[br.target], br),
                    F.struct(
                        F.lit(i).alias("i"),
                        _bucket_expr(values[br.target], br, buckets).alias("b"),
                        values[br.target].alias("v"),
                    ),
                )
                for i, br in enumerate(to_split)
            ]
            hist = (
                df.select(F.explode(F.array(*items)).alias("s"))
                .where(F.col("s").isNotNull())
                .groupBy("s.i", "s.b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("mn"), F.max("s.v").alias("mx"))
                .collect()
            )
            per: dict[int, list] = {}
            for r in hist:
                per.setdefault(r["i"], []).append((r["b"], r["n"], r["mn"], r["mx"]))
            for i, br in enumerate(to_split):
                cells = sorted(per.get(i, []))
                new: dict[int, _Bracket] = {}
                for rank in br.ranks:
                    cum = br.below
                    for b, n, mn, mx in cells:
                        if rank < cum + n:
                            nb = new.get(b)
                            if nb is None:
                                poor = n * 8 > br.inside
                                nb = _Bracket(br.target, float(mn), float(mx), cum, n, set(), poor and not br.log_scale)
                                new[b] = nb
                            nb.ranks.add(rank)
                            break
                        cum += n
                active.extend(new.values())
    lost = [(t, r) for t, rs in ranks.items() if stats[t][0] for r in rs if (t, r) not in result]
    if lost:
        raise RuntimeError(f"order statistics not found (do the values change between passes?): {lost[:10]}")
    return result


def _infinite(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[int, int, float | None, float | None]]:
    """(values that are -Inf, values that are Inf, least and greatest finite value) of each target."""
    if not values:
        return {}
    aggs = []
    for i, v in enumerate(values.values()):
        finite = F.when(F.abs(v) != F.lit(math.inf), v)
        aggs += [F.count_if(v == F.lit(-math.inf)).alias(f"b{i}"), F.count_if(v == F.lit(math.inf)).alias(f"a{i}"), F.min(finite).alias(f"mn{i}"), F.max(finite).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    return {t: (row[f"b{i}"], row[f"a{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, t in enumerate(values)}


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: list[float],
    buckets: int = BUCKETS,
    accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of each expression in ``values`` (nulls ignored)."""
    if not values:
        return {}
    aggs = []
    names = list(values)
    for i, t in enumerate(names):
        v = values[t]
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    stats = {t: (row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, t in enumerate(names)}
    return quantiles_with_stats(df, values, probs, stats, buckets, accuracy)


def quantiles_with_stats(
    df: DataFrame,
    values: dict[str, Column],
    probs: list[float],
    stats: dict[str, tuple[int, float, float]],
    buckets: int = BUCKETS,
    accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact by default; with ``accuracy`` the one-pass sketch (rank error <= n / accuracy)."""
    if accuracy:
        live = {t: v for t, v in values.items() if stats[t][0]}
        got = approx_quantiles(df, live, probs, accuracy) if live else {}
        return {t: got.get(t, [None] * len(probs)) for t in values}
    ranks: dict[str, set[int]] = {}
    for t in values:
        n = stats[t][0]
        if n:
            rs = set()
            for p in probs:
                h = (n - 1) * p
                rs.add(int(math.floor(h)))
                rs.add(int(math.ceil(h)))
            ranks[t] = rs
    got = order_statistics(df, values, ranks, stats, buckets)
    out: dict[str, list[float | None]] = {}
    for t in values:
        n = stats[t][0]
        res: list[float | None] = []
        for p in probs:
            if not n:
                res.append(None)
                continue
            h = (n - 1) * p
            lo_r, hi_r = int(math.floor(h)), int(math.ceil(h))
            lo, hi = got[(t, lo_r)], got[(t, hi_r)]
            res.append(interpolate(lo, hi, h - lo_r))
        out[t] = res
    return out


def interpolate(lo: float, hi: float, frac: float) -> float:
    if frac == 0.0 or lo == hi:
        return lo
    return lo + (hi - lo) * frac


def approx_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], accuracy: int = 10000) -> dict[str, list[float | None]]:
    """One-pass sketch alternative (rank error <= n / accuracy)."""
    names = list(values)
    row = df.agg(*[F.percentile_approx(values[t].cast("double"), probs, accuracy).alias(f"q{i}") for i, t in enumerate(names)]).first()
    return {t: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs) for i, t in enumerate(names)}
