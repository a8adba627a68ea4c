"""Every query of the text package that has SQL against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

from quire.llm import queries

FOLDER = Path(os.environ.get("QUIRE_TEST_TABLES", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in FOLDER.iterdir():
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    cur = duck.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in sorted(names)]) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, str(FOLDER)).count() > 0
