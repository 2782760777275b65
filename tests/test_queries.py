"""Every query that SQL can express equals it on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from normata.plans import registry as R

DATA = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or pd.isna(value) is True:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query(spark, oracle, name):
    got = R.QUERIES[name](spark, DATA).toPandas()
    if name not in R.ORACLE_SQL:
        assert len(got)
        return
    want = oracle.execute(R.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(R.ORACLE_SQL) <= set(R.QUERIES) and R.FLAGSHIP in R.QUERIES
