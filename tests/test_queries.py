"""Every query of the catalogue runs, and agrees with its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from chronicle.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows) if all(None not in r for r in rows) else sorted(map(str, rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in SQL:
        rel = db.sql(SQL[name])
        assert sorted(rel.columns) == columns
        want = [tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()]
        assert shown(got) == shown(want)
    assert len(df.columns) == len(set(df.columns))
