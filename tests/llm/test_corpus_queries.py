"""The corpus queries against their DuckDB twins on the smallest tables."""

import oracle
import pytest

from postforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    oracle.compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
