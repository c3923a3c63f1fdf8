"""Every catalogue query against its DuckDB oracle on the smallest driver tables."""

import pytest

from fieldspark.plans.catalog import ORACLE, QUERIES
from fieldspark.plans.compare import compare, duckdb_connect


@pytest.fixture(scope="module")
def con(sf001):
    return duckdb_connect(sf001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, sf001, name):
    r = compare(QUERIES[name](spark, sf001), con, ORACLE[name])
    assert r["match"], r


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    keys = df.select("field_id", "day")
    n = df.count()
    assert n > 0 and keys.distinct().count() == n  # one row a key is left
    assert df.where("temp IS NULL OR humidity IS NULL OR crop IS NULL").count() == 0
    assert set(E.queries()) >= set(E.oracle_sql())
