"""Run catalogue queries in Spark and their oracle SQL in DuckDB; print per-query match."""
import json, sys, time
sys.path.insert(0, "/root/repo")
from fieldspark.session import get_session
from fieldspark.plans.catalog import QUERIES, ORACLE
from fieldspark.plans.compare import compare, duckdb_connect

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = get_session("local[8]")
con = duckdb_connect(sf)
bad = 0
for n in names:
    t = time.time()
    try:
        df = QUERIES[n](spark, sf)
        if n in ORACLE:
            r = compare(df, con, ORACLE[n])
        else:
            r = {"spark_rows": df.count(), "match": None}
    except Exception as e:  # noqa
        r = {"error": repr(e)[:600], "match": False}
    r["sec"] = round(time.time() - t, 2)
    if r.get("match") is False:
        bad += 1
    print(n, json.dumps(r, default=str)[:1500], flush=True)
print("FAILED", bad)
