"""Every registered graph query against its SQL twin."""

import duckdb
import pytest

from veldt.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    else:
        assert rows


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
