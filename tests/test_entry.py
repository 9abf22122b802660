"""Every query of the core runs on the smallest data and keeps a stable schema; a few are checked against SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from clauseflow.plans.oracle import ORACLE
from clauseflow.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        rel = con.sql(ORACLE[name])
        cols = sorted(df.columns)
        assert sorted(rel.columns) == cols
        at = [list(rel.columns).index(c) for c in cols]
        key = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        assert sorted(tuple(key(r[c]) for c in cols) for r in got) == sorted(tuple(key(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
