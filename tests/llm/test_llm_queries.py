"""Every query with SQL against it, on the smallest tables."""

import sys

import pytest
from oracle_check import compare, duck

from tidemark.llm.queries import QUERIES, SQL
from tidemark.plans.registry import Entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    verdict, note, _ = compare(
        spark, duck(SF_DIR), name, Entry(QUERIES[name], SQL[name]), SF_DIR
    )
    assert verdict == "ok", note


if __name__ == "__main__":
    from tidemark.session import local_session

    session, folder = local_session("oracle"), f"/root/testdata/sf{sys.argv[1]}"
    for query in sys.argv[2:] or SQL:
        print(query, *compare(session, duck(folder), query, Entry(QUERIES[query], SQL.get(query)), folder))
