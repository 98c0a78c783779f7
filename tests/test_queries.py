"""Every registered query of the engine against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from tidelog.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    plain = lambda rows: sorted([str(x) for x in r] for r in rows)
    assert plain(got.collect()) == plain([r[i] for i in at] for r in want.fetchall())
