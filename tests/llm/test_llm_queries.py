"""Every registered query of the subpackage runs on whole tables, and agrees with its SQL where it has one."""

import pytest
from compare import connect, same

from fluxgrid.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    assert list(got.columns) == list(dict.fromkeys(got.columns))
    if name in SQL:
        same(got, con.execute(SQL[name]).fetchdf())
    else:
        assert len(got) > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
