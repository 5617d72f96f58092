"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import Row

from tessera.plans import catalogue as queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(tuple(r[c]) if isinstance(r[c], Row) else r[c]) for c in columns]) for r in df.collect())
    done = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in done.fetchall())
    assert got == want
