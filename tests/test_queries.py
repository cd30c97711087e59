"""Every query with a SQL twin gives the same rows."""

import pytest

from tests.oracle import compare, connect
from tidemark.catalog import ORACLE, QUERIES

# model fits of many seconds each; exercised by the driver's run and by the unit tests
SLOW = {"evaluation_tables", "candidate_score", "network_edges", "network_sample", "discriminator_auc", "tstr"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, folder, con, name):
    assert compare(con, spark, folder, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
