"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from maskwright.plans.queries import ORACLE, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: str(r)
    want = sorted(([plain(x) for x in r] for r in cursor.fetchall()), key=key)
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=key)
    assert got == want


def test_flagship(spark, sf):
    rows = flagship(spark, sf).limit(5).collect()
    assert len(rows) == 5 and all(r.caption and r.cell_name for r in rows)
