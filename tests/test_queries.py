"""Every registered query against its SQL, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from clubledger.workload.check_sql import SQL
from clubledger.workload.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted([[(v is None, str(v)) for v in row] for row in rows])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    expected = sql.sql(SQL[name])
    assert columns == sorted(expected.columns)
    quoted = [f'"{c}"' for c in columns]
    rows = expected.select(*quoted).fetchall()
    assert plain(found.select(*columns).collect()) == plain(rows)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
