"""Every registered query on the smallest tables; where there is SQL, with the same rows."""

import os

import duckdb
import pytest

from graphloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v if v is None or isinstance(v, int) else str(v)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr), sorted(columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    found = sql.execute(ORACLE[name])
    assert rows(df.collect(), df.columns) == rows(found.fetchall(), [d[0] for d in found.description])
