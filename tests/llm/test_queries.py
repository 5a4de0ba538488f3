"""The registered queries against their SQL."""

import pytest

from docloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(name, same_as_sql):
    assert same_as_sql(QUERIES[name], ORACLES[name]) > 0


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
