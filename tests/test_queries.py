"""Every query of the engine against DuckDB on the smallest tables."""

import pytest

from conftest import DATA, rows
from glimmer.plans import artifacts, evaluation_oracle, oracle
from glimmer.plans.evaluation import QUERIES

SQL = oracle.oracle_sql() | evaluation_oracle.oracle_sql() | artifacts.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA)) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 32
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
