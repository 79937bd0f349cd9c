"""Every query of the library against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from lexiloom.plans.queries import QUERIES
from lexiloom.plans.queries_sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    answer = duck.execute(SQL[name])
    place = [[d[0] for d in answer.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in place)) for r in answer.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if "parse_error" in df.columns:
        assert not [r for r in rows if r["parse_error"]]


def test_sql_is_for_known_queries():
    assert set(SQL) <= set(QUERIES)
