"""Every query of the screening engine against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from helicase import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = [p.stem for p in sorted(DATA.glob("*.parquet"))]
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (bool, int)) else v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in at]) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not TABLES, reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    got = catalog.queries()[name](spark, str(DATA))
    want = tables.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, want.fetchall())
