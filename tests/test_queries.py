"""Every query of the catalog against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v if isinstance(v, (int, str)) else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    df = catalog.entry(spark, SF)
    assert df.columns == ["month", "ic", "n"] and df.count() > 0
