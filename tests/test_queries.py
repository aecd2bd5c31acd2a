"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pandas as pd
import pytest

from cytospark.queries import ORACLE, QUERIES

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(float(x)) if not isinstance(x, (bool, str)) and hasattr(x, "__float__") else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
