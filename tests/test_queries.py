"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from noveltide.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    want = con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
