"""Every registered query against its SQL twin."""

import duckdb
import pytest

from lodestead.queries import ORACLES, QUERIES
from lodestead.queries.views import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    mine = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    found = duck.execute(ORACLES[name])
    order = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(order) == columns
    assert mine == sorted(repr(tuple(r[order[c]] for c in columns)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 400
    assert set(entry.oracle_sql()) <= set(entry.queries())
