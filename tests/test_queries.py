import datetime
import os

import duckdb
import pytest

import __spark_entry__
from callscope import plans

SF = "/root/testdata/sf0.001"
ORACLE = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def _rows(rows):
    plain = lambda x: x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert _rows(got) == _rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
