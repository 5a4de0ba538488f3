"""Every query of the library against its SQL on the smallest tables; those without SQL must run and give rows."""

import pytest
from conftest import DATA

from docloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_as_sql(name, same_as_sql):
    assert same_as_sql(catalog.QUERIES[name], catalog.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(name, spark):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_sql_has_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
