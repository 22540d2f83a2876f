"""Every query with SQL against DuckDB, and the entry points."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from rolegraph.plans import bound, shelf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(bound.QUERIES))
def test_query(spark, db, name):
    assert rows(bound.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(bound.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(shelf.QUERIES))
def test_shelf(spark, db, name):
    assert rows(shelf.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(shelf.SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_what_cannot_be_imported():
    """Without the automaton's package the subpackage can't be imported; the other queries stay."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'lib_counts' in q and 'op1_jaccard_join' not in q and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
