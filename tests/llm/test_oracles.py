"""Queries of the subpackage against their DuckDB twins."""

import pytest

from strand.llm import queries
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")
