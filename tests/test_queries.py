"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from latticework.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(cols).collect()]
    if name in ORACLE_SQL:
        want = db.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(norm_row(got), key=key) == sorted(norm_row(want), key=key)
    else:
        assert got


def norm_row(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
