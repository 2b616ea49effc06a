"""The operators that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lexalloy.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_vector_links", "quality_base", "secret_base", "url_rules"])
def test_equals_duckdb(spark, name):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, str(DATA))
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
