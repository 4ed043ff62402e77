"""Every registered query against its SQL on the smallest tables; queries without SQL must at least run."""

import duckdb
import pandas as pd
import pytest

from lectern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(set(found.columns)) == len(found.columns)
    if name in catalog.ORACLE:
        wanted = duck.sql(catalog.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
