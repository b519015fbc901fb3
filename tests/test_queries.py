"""Every registered query with SQL gives the rows that DuckDB gives."""

import __spark_entry__ as entry
import compare
import duckdb
import pandas as pd
import pytest

from polisgraph import registry

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in compare.TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{BASE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, con, name):
    df = registry.QUERIES[name](spark, BASE)
    rows = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns).astype(object).where(lambda x: x.notna(), None)
    rel = con.sql(registry.ORACLE_SQL[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns).astype(object).where(lambda x: x.notna(), None)
    assert sorted(rows.columns) == sorted(want.columns)
    assert compare.tidy(rows) == compare.tidy(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
