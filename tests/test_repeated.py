"""Rows repeated by ``explode`` are shuffled: Spark knows too small a size of them and would broadcast them."""

import pytest

from registry import load
from tidegrid.fixtures import Fixtures
from tidegrid.operators.sampling import weighted_draws

FOLDER = "/root/testdata/sf0.001"
QUERIES = ("j6_pairs_within", "j7a_isolated_matching", "j10_near_shore", "j13_box_iou", "j15_points_outside_holes")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_repeated_rows_are_not_broadcast(spark, name):
    plan = _plan(load()[name].run(Fixtures(spark, FOLDER)))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_strips_of_draws_are_not_broadcast(spark):
    items = spark.range(7).selectExpr("id", "1D AS w")
    assert "SortMergeJoin [_strip" in _plan(weighted_draws(items, "id", "w", 1000, seed=3))
