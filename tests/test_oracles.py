"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pagelake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x) -> str:
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    if isinstance(x, (bool, str)):
        return str(x)
    try:
        return f"{float(x):.6f}"
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
