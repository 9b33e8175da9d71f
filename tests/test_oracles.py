"""Every query that SQL can express gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from polisgrid.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return ("nan" if math.isnan(v) else v + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(_plain(r[k]) for k in names) for r in df.collect()), key=str)
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    given = [c[0] for c in cur.description]
    assert sorted(given) == names
    assert rows == sorted((tuple(_plain(r[given.index(k)]) for k in names) for r in cur.fetchall()), key=str)
