"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quillmesh import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in plans.SQL:
        assert rows
        return
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert rows == want
