"""Every named query against its SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as contract
import check
from tests.conftest import SMALL
from trapline.plans import queries as _queries


@pytest.fixture(scope="module")
def connection():
    return check.oracle(SMALL)


def test_every_query_has_sql():
    assert set(_queries.QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, folder, connection, name):
    assert check.compare(contract.queries()[name](spark, folder), connection, contract.oracle_sql()[name]) in (
        "",
        "no rows",
    )


def test_entry(spark):
    assert contract.entry(spark).count() > 0
