"""Every query of the library's own operators gives the rows of its SQL."""

import pytest

from fluxframe import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, same_as_sql, name):
    same_as_sql(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name])


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert len(catalog.queries()) == sum(len(m.QUERIES) for m in catalog.MODULES)
