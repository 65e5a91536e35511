"""Queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from conftest import DATA, rows
from glimmer.llm.queries import queries
from glimmer.llm.sql import oracle_sql

SQL = oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries()[name](spark, DATA)) == rows(duck.sql(SQL[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
