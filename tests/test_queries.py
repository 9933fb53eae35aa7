"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from vitrine import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if v != int(v) else str(int(v))
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.SQL:
        assert len(got) or name in ("component_assignment", "greedy_assignment")
        return
    want = duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in got[cols].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in want[cols].itertuples(index=False))
