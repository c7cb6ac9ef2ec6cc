"""Training-data queries that SQL can express, against it."""

import pytest

from morphlake.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    assert compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], sf_dir) > 0
