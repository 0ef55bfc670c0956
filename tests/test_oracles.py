"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
#: Training-data operators have their own tests; what SQL cannot say of them is held against brute force there.
OPTIONAL = re.compile(r"op\d+_|pipeline$")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [name for name in QUERIES if not OPTIONAL.match(name)])
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(spark, con, SF, QUERIES[name], entry.oracle_sql().get(name))
    assert problem is None, problem


def test_every_query_has_a_twin():
    assert {name for name in entry.oracle_sql() if not OPTIONAL.match(name)} == {name for name in QUERIES if not OPTIONAL.match(name)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
