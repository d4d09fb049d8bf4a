"""Every query of the catalog against its oracle, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import frames, norm, same  # noqa: E402

from loomspan import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
Q, O = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(O))
def test_oracle(spark, name):
    got, want = frames(spark, SF, name, Q[name], O[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got, want), (norm(got)[:3], norm(want)[:3])


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_rows_only(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_plan(spark):
    """Filters and columns reach the scans; small dimensions are broadcast by their size."""
    plan = Q["macro_mean"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan or "GreaterThanOrEqual(l_quantity" in plan
    assert "l_extendedprice" not in plan.split("Physical Plan")[1]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
