"""Every query with SQL gives the same rows on both engines."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import rows_of, type_notes
from trialscope.fixtures import BASE_TABLES

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """Rows of every query, computed a few queries at a time."""

    def run(name):
        df = QUERIES[name](spark, sf_dir)
        return df.dtypes, rows_of(df.columns, df.collect())

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in sorted(QUERIES)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(rows, con, name):
    dtypes, mine = rows[name].result()
    con.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in con.description}
    theirs = rows_of(list(types), con.fetchall())
    assert sorted(column for column, _ in dtypes) == sorted(types)
    assert type_notes(dtypes, types) == ""
    assert mine == theirs



@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(rows, name):
    _, mine = rows[name].result()
    assert mine


def test_entry(spark):
    assert entry(spark).count() > 0


def test_no_sql_without_query():
    assert set(ORACLES) <= set(QUERIES)
