"""Each registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fieldloom.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect(config={"memory_limit": "3GB"})
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sql, name):
    mine, theirs = registry.queries()[name](spark, DIR).toPandas(), sql.execute(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
