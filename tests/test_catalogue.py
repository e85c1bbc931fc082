"""Every registered query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from tributary.plans.catalogue import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None else str(v) if isinstance(v, (bool, str)) else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, DIR)
    names = sorted(df.columns)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    key = lambda r: tuple("" if x is None else x for x in r)
    want = sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key) == want
