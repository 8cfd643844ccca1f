"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strataform.plans import catalog

AT = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in sorted(Path(AT).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_as_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, AT)
    cols = sorted(got.columns)
    a = sorted(repr([plain(x) for x in r]) for r in got.select(*cols).collect())
    if name in catalog.ORACLES:
        assert sorted(tables.sql(catalog.ORACLES[name]).columns) == cols
        b = sorted(repr([plain(x) for x in r]) for r in tables.sql(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall())
        assert a == b
