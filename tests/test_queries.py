"""Every registered query next to its SQL on the smallest tables."""

import pytest

from check import compare, duck
from codeloom.plans.registry import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    q = QUERIES[name]
    _, n, same, note = compare(spark, con, sf, name, q.plan, q.sql)
    assert same is not False, note
    assert n > 0 or name in {"shop_seeds"}


def test_entry_contract(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
