"""Every library query against its SQL over the smallest tables."""

import pytest

from pagelattice.plans.catalogue import ORACLES, QUERIES
from tests.compare import database, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    own, other = same(QUERIES[name](spark, SF), con, ORACLES[name])
    assert own == other


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["recent_activity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["storage_by_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan  # column pruning
