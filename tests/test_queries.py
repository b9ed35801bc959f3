import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cellgrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    value = None if value is pd.NA else value
    value = value.item() if hasattr(value, "item") else value
    return None if value is None or value != value else round(value, 4) if isinstance(value, float) else value


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 100
