"""Every registered query of the library against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from netspark import more_queries, run_queries  # noqa: F401
from netspark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(at) == sorted(df.columns)
    cols = sorted(at)
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[at[c]] for c in cols) for r in want.fetchall())
