"""Order-dependent scans (fill, running sum, global position) without a single-task window.

A window with no ``partitionBy`` (or partitioned by one hot key) puts every row of the group on
one task. Instead the rows are range-partitioned on ``(partition keys, order keys)`` into
contiguous, balanced buckets, each is scanned with an ordinary window, and what a bucket needs
from earlier/later buckets (last value seen, first value ahead, rows before, running sum) is a
carry. Carries are a tree: FAN neighbouring buckets are summed up to one node of the next level until
one node is left (up-sweep), then every node hands its own carry down to its buckets (down-sweep),
so no window at any level sees more than FAN rows of a group.

Kinds of scan output (``specs`` = list of ``(name, kind, expr)``):

* ``last``     last non-null value of ``expr`` at or before the row
* ``first``    first non-null value of ``expr`` at or after the row
* ``sum``      running sum of ``expr`` up to and including the row (nulls skipped)
* ``last_pos`` global 1-based position of the last row at or before where ``expr`` is true
* ``pos``      global 1-based position of the row inside its group (``expr`` ignored)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage

BUCKET = "_b"
PARTITION_BYTES = 128 << 20  # of rows in a range partition (conf fieldspark.scan.partitionBytes)
FAN = 1024  # nodes that one node of the next level sums up (conf fieldspark.scan.fan)
BROADCAST_CARRIES = 100_000  # a carry table of at most so many rows is broadcast, a larger one joined by shuffle


def _conf(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"fieldspark.scan.{name}", str(default)))


def _partitions(df: DataFrame) -> tuple[int, int]:
    """(partitions that the counted bytes need, rows)."""
    wide = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(F.sum(w.cast("long")), F.lit(0)) for w in wide), F.count(F.lit(1)) * 8 * max(len(df.columns) - len(wide), 1))
    total, rows = df.agg(size, F.count(F.lit(1))).first()
    return max(1, -(-total // _conf(df, "partitionBytes", PARTITION_BYTES))), rows


def _sort_cols(cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def bucketize(df: DataFrame, part_cols: list[str], order_cols: list[str], n: int | None = None) -> DataFrame:
    """Range-partition on (part, order) and tag every row with its contiguous bucket id: the partition,
    or with conf ``fieldspark.scan.bucketRows`` stretches of so many rows of one.

    The result is checkpointed: the scan reads it twice (bucket windows and carries) and both reads must
    see the same bucket of every row. Two separate range exchanges would each sample their own
    boundaries; the written table also outlives executors. Number of partitions: by counted bytes.
    """
    parts, rows = (n, None) if n else _partitions(df)
    out = df.repartitionByRange(parts, *_sort_cols(part_cols + order_cols)).withColumn(BUCKET, F.spark_partition_id().cast("long"))
    if stretch := _conf(df, "bucketRows", 0):
        rows = df.count() if rows is None else rows
        w = Window.partitionBy(BUCKET).orderBy(*_sort_cols(part_cols + order_cols))
        out = out.withColumn(BUCKET, F.col(BUCKET) * (rows // stretch + 1) + F.floor((F.row_number().over(w) - 1) / stretch))
    return cut_lineage(out)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[prefix + k])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, "left")
    return out.drop(*[prefix + k for k in keys])


def ordered_scan(
    df: DataFrame,
    part_cols: list[str],
    order_cols: list[str],
    specs: list[tuple[str, str, Column | None]],
    n_buckets: int | None = None,
    bucketed: bool = False,
) -> DataFrame:
    """Add one column per spec; see module doc. ``order_cols`` must make the order total."""
    b = df if bucketed else bucketize(df, part_cols, order_cols, n_buckets)
    keys = part_cols + [BUCKET]
    w = Window.partitionBy(*keys).orderBy(*_sort_cols(order_cols))
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # "first at or after" = "last at or before" in reverse order: a running frame, O(n) per bucket
    # (a CURRENT ROW..UNBOUNDED FOLLOWING frame is re-aggregated per row, O(n^2))
    rev = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order_cols])
    down = rev.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = b.withColumn("_lpos", F.row_number().over(w))
    loc_cols: dict[str, Column] = {}
    for name, kind, e in specs:
        if kind == "last":
            loc_cols[f"_l_{name}"] = F.last(e, True).over(up)
        elif kind == "first":
            loc_cols[f"_l_{name}"] = F.last(e, True).over(down)
        elif kind == "sum":
            loc_cols[f"_l_{name}"] = F.sum(e).over(up)
        elif kind == "last_pos":
            loc_cols[f"_l_{name}"] = F.last(F.when(e, F.col("_lpos")), True).over(up)
        elif kind != "pos":
            raise ValueError(f"unknown scan kind {kind!r}")
    if loc_cols:
        local = local.withColumns(loc_cols)

    # per-bucket carry summary. It is aggregated from the bucketed rows themselves (partial
    # aggregation, no window re-evaluation), ordering rows by a struct of the order keys with
    # NULLs last; only ``last_pos`` needs the in-bucket positions of the windowed frame.
    okey = []
    for c in order_cols:
        okey += [F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(f"_o_{c}")]
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    for name, kind, e in specs:
        if kind == "last":
            aggs.append(F.max(F.when(e.isNotNull(), F.struct(*okey, e.alias("v")))).alias(f"_a_{name}"))
        elif kind == "first":
            aggs.append(F.min(F.when(e.isNotNull(), F.struct(*okey, e.alias("v")))).alias(f"_a_{name}"))
        elif kind == "sum":
            aggs.append(F.sum(e).alias(f"_a_{name}"))
    if any(kind == "last_pos" for _, kind, _ in specs):
        aggs += [F.max(F.when(e, F.col("_lpos"))).alias(f"_a_{name}") for name, kind, e in specs if kind == "last_pos"]
        carry = local.groupBy(*keys).agg(*aggs)
    else:
        carry = b.groupBy(*keys).agg(*aggs)

    carry = _carries(carry, part_cols, [(name, kind) for name, kind, _ in specs])
    if carry.count() <= BROADCAST_CARRIES:
        carry = F.broadcast(carry)
    out = _null_safe_join(local, carry, keys, "_k")
    res: dict[str, Column] = {}
    for name, kind, e in specs:
        lc, cc = F.col(f"_l_{name}"), F.col(f"_k_c_{name}")
        if kind in ("last", "first"):
            res[name] = F.coalesce(lc, cc)
        elif kind == "sum":
            res[name] = F.when(lc.isNull() & cc.isNull(), F.lit(None)).otherwise(
                F.coalesce(lc, F.lit(0)) + F.coalesce(cc, F.lit(0))
            )
        elif kind == "last_pos":
            res[name] = F.coalesce(F.col("_k_prefix") + lc, cc)
        elif kind == "pos":
            res[name] = F.col("_k_prefix") + F.col("_lpos")
    out = out.withColumns(res)
    drop = ["_lpos", "_k_prefix"] + [c for c in out.columns if c.startswith("_l_") or c.startswith("_k_c_")]
    if not bucketed:
        drop.append(BUCKET)
    return out.drop(*drop)


def _carries(nodes: DataFrame, part_cols: list[str], specs: list[tuple[str, str]]) -> DataFrame:
    """part_cols, BUCKET, _prefix (rows before) and _c_<name> of every node (see module doc)."""
    nodes = cut_lineage(nodes.withColumns({f"_a_{n}": F.col(f"_a_{n}.v") for n, k in specs if k in ("last", "first")}))
    fan = _conf(nodes, "fan", FAN)
    top = nodes.agg(F.max(BUCKET)).first()[0] or 0
    local = nodes.withColumn("_up", F.floor(F.col(BUCKET) / fan))
    w = Window.partitionBy(*part_cols, "_up")
    before = w.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    after = w.orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)  # the nodes behind, as a running frame
    local = local.withColumn("_prefix", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    carry: dict[str, Column] = {}
    for n, kind in specs:
        a = F.col(f"_a_{n}") if kind != "pos" else None
        if kind == "last":
            carry[f"_c_{n}"] = F.last(a, True).over(before)
        elif kind == "first":
            carry[f"_c_{n}"] = F.last(a, True).over(after)
        elif kind == "sum":
            carry[f"_c_{n}"] = F.sum(a).over(before)
        elif kind == "last_pos":
            carry[f"_c_{n}"] = F.last(F.col("_prefix") + a, True).over(before)
    local = local.withColumns(carry) if carry else local
    names = ["_prefix", *carry]
    if top < fan:
        return local.select(*part_cols, BUCKET, *names)
    sums = [F.sum("_cnt").alias("_cnt")]
    for n, kind in specs:
        a = F.col(f"_a_{n}") if kind != "pos" else None
        at = F.struct(F.col(BUCKET).alias("b"), (F.col("_prefix") + a if kind == "last_pos" else a).alias("v")) if a is not None else None
        if kind in ("last", "last_pos"):
            sums.append(F.max(F.when(a.isNotNull(), at)).alias(f"_a_{n}"))
        elif kind == "first":
            sums.append(F.min(F.when(a.isNotNull(), at)).alias(f"_a_{n}"))
        elif kind == "sum":
            sums.append(F.sum(a).alias(f"_a_{n}"))
    local = cut_lineage(local)
    upper = local.groupBy(*part_cols, F.col("_up").alias(BUCKET)).agg(*sums)
    upper = upper.withColumns({f"_a_{n}": F.col(f"_a_{n}.v") for n, k in specs if k == "last_pos"})
    upper = _carries(upper, part_cols, specs).withColumnRenamed(BUCKET, "_up")
    out = _null_safe_join(local, upper, [*part_cols, "_up"], "_u")
    res: dict[str, Column] = {"_prefix": F.col("_prefix") + F.col("_u_prefix")}
    for n, kind in specs:
        mine, theirs = F.col(f"_c_{n}"), F.col(f"_u_c_{n}")
        if kind in ("last", "first"):
            res[f"_c_{n}"] = F.coalesce(mine, theirs)
        elif kind == "sum":
            res[f"_c_{n}"] = F.when(mine.isNull(), theirs).otherwise(mine + F.coalesce(theirs, F.lit(0)))
        elif kind == "last_pos":
            res[f"_c_{n}"] = F.coalesce(mine + F.col("_u_prefix"), theirs)
    return out.select(*part_cols, BUCKET, *[res[n].alias(n) for n in names])


def fill_forward_backward(
    df: DataFrame, cols: list[str], part_cols: list[str], order_cols: list[str], n_buckets: int | None = None
) -> DataFrame:
    """``ffill`` then ``bfill`` of each column along the order (inside ``part_cols`` groups)."""
    if not cols:
        return df
    specs = []
    for c in cols:
        specs.append((f"_ff_{c}", "last", F.col(c)))
        specs.append((f"_bf_{c}", "first", F.col(c)))
    out = ordered_scan(df, part_cols, order_cols, specs, n_buckets)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_ff_{c}"), F.col(f"_bf_{c}")) for c in cols})
    return out.drop(*[s[0] for s in specs])


def global_position(
    df: DataFrame, name: str, order_cols: list[str], part_cols: list[str] | None = None, n_buckets: int | None = None
) -> DataFrame:
    """Exact ``row_number`` over the whole table (or per group) without a single-task window."""
    return ordered_scan(df, part_cols or [], order_cols, [(name, "pos", None)], n_buckets)


def running_sum(
    df: DataFrame, name: str, expr: Column, part_cols: list[str], order_cols: list[str], n_buckets: int | None = None
) -> DataFrame:
    return ordered_scan(df, part_cols, order_cols, [(name, "sum", expr)], n_buckets)
