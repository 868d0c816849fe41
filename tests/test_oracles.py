"""Every registered query against its SQL in DuckDB at the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check_oracles import TABLES, canon

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(canon(r[c]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(canon(r[columns.index(c)]) for c in order) for r in expected), key=repr)
    assert got == want
