"""Every core query with SQL gives the SQL's rows."""

import pytest
from oracle import DATA, rows_of, sql_rows

from gramoflow.plans import catalog, changes, problems, problems_sql, scalars, sources  # noqa: F401 - they add to the catalog

QUERIES = problems.queries() | catalog.QUERIES
SQL = problems_sql.oracle_sql() | catalog.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == sql_rows(SQL[name])


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
