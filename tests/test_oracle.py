"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evalweave.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if not isinstance(v, str) and pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    if name in catalogue.oracle_sql():
        assert rows(got) == rows(con.sql(catalogue.oracle_sql()[name]).df())
