"""Every registered query against its hand-written SQL twin."""

import pytest

from faultline.plans.registry import queries
from faultline.plans.sql import oracle_sql
from tests.compare import connect, differences

QUERIES, STATEMENTS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, STATEMENTS[name]) == []
