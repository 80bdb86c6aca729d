"""The registered SQL of the operators against their queries."""

import os

import duckdb
import pytest

from callscope.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("SQL_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, want.select(", ".join(cols)).fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())
