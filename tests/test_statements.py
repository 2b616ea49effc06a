"""Every statement against DuckDB on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from lexalloy.plans import registry
from lexalloy.plans.tables import BASE

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    value = float(value) if isinstance(value, decimal.Decimal) else value
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equals_duckdb(spark, duck, name):
    found = registry.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = duck.execute(registry.oracles()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    rows = sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=repr)
    assert rows == sorted(([plain(r[names.index(c)]) for c in columns] for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracles().keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() >= 0
