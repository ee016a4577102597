"""Every registered query against its DuckDB statement on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["tenant_id", "total_chunk_count", "new_chunk_count", "skipped_count"]


def test_every_query_has_a_callable_and_most_have_sql():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert {q for q in set(qs) - set(sql) if not q.startswith("op") and q != "pipeline"} == set()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    a, b = rows_of(sdf.columns, srows), rows_of(dcols, drows)
    assert len(a) == len(b)
    assert hashlib.sha256("\n".join(a).encode()).hexdigest() == hashlib.sha256("\n".join(b).encode()).hexdigest()
