"""Result comparison used by the tests: Spark DataFrame vs DuckDB SQL on the same parquet files."""

from __future__ import annotations

import datetime as _dt
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return round(v, digits) + 0.0
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def compare(spark_df, con, sql: str, digits: int = 6) -> dict:
    """Row count, column names and the multiset of rows (columns sorted by name)."""
    s_cols = spark_df.columns
    s_rows = spark_df.collect()
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    out["columns_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
        out["match"] = False
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_set = sorted((tuple(_norm(r[i], digits) for i in order) for r in s_rows), key=repr)
    d_set = sorted((tuple(_norm(r[d_index[s_cols[i]]], digits) for i in order) for r in d_rows), key=repr)
    out["match"] = s_set == d_set
    if not out["match"]:
        from collections import Counter

        cs, cd = Counter(s_set), Counter(d_set)
        diff_s = list((cs - cd).elements())[:3]
        diff_d = list((cd - cs).elements())[:3]
        out["only_spark"], out["only_oracle"] = diff_s, diff_d
    return out
