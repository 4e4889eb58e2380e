"""The registered queries of the subpackage that SQL can state, against that SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

from quillgraph.llm import queries as Q

DATA = os.environ.get("SQL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, DATA)
    r = duck.execute(Q.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(x[0] for x in r.description)
    at = [[x[0] for x in r.description].index(n) for n in names]
    mine, theirs = [tuple(x) for x in got.select(names).collect()], [tuple(x[i] for i in at) for x in r.fetchall()]
    assert mine and sorted(mine, key=repr) == sorted(theirs, key=repr)
