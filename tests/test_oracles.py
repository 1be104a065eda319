"""Every library query against its SQL on the smallest data directory that has rows for it."""

import os

import duckdb
import pytest

from tonearm.plans import library

DATA = os.environ.get("TONEARM_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


LARGER = os.environ.get("TONEARM_TEST_DIR", "/root/testdata/sf0.01")
SEEDED = {"ab_delta", "knn_favorites", "knn_filtered", "knn_taste", "knn_tracks", "ranked_acoustic_only", "ranked_blend"}  # ids from 100


def connect(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def _key(row):
    return repr(tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v + 0.0 if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, name):
    folder = LARGER if name in SEEDED else DATA
    con = connect(folder)
    df = library.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(_key(r) for r in df.select(*cols).collect())
    assert got
    if name in library.ORACLES:
        cur = con.execute(library.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(_key([r[i] for i in at]) for r in cur.fetchall())
