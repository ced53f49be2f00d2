"""Every named query against its SQL, on the smallest tables."""

import pytest
from oracle_check import compare, duck

from tidemark.plans.registry import load_all

SF_DIR = "/root/testdata/sf0.001"
ENTRIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_equals_sql(spark, con, name):
    verdict, note, _ = compare(spark, con, name, ENTRIES[name], SF_DIR)
    assert verdict in ("ok", "rows-only"), note


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["matches", "ref_total", "overlap"]
