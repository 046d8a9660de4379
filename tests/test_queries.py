"""Every engine query against its DuckDB twin on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from postforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    run = catalog.queries()[name]
    if name in catalog.oracle_sql():
        oracle.compare(spark, SF, run, catalog.oracle_sql()[name])
    else:
        assert run(spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
