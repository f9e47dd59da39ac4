"""Every query of the catalog against its SQL on the smallest tables."""

from numbers import Number
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quarryleaf.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, Number) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        con.execute(f"create view {t} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
    assert plain(catalog.QUERIES[name](spark, str(DATA)).toPandas()) == plain(con.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0
