"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from ridgeline.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((repr([plain(v) for v in r]) for r in df.select(*columns).collect()))
    if name not in registry.oracle_sql():
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
