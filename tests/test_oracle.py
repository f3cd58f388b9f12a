"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF01
from oracle_util import digest, duck_connection

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF01)


def test_every_query_has_an_oracle_or_is_rows_only():
    missing = set(entry.registry()) - set(ORACLE)
    assert missing == set(entry.ROWS_ONLY)
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


@pytest.mark.parametrize("name", entry.ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF01).count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "practiceid"
    assert df.count() == 10
