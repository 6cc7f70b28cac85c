"""Many holes are dealt to more tasks than Spark's shuffle partitions, with the same result."""

from registry import load
from tidegrid.fixtures import Fixtures
from tidegrid.operators import overlap

FOLDER = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_holes(spark, monkeypatch):
    fx, run = Fixtures(spark, FOLDER), load()["j16_visible_fraction"].run
    usual = run(fx)
    monkeypatch.setattr(overlap, "HOLES_PER_TASK", 100)
    dealt = run(fx)
    tasks = -(-fx.hole.count() // 100)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(image_id#" in dealt._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(dealt.collect()) == sorted(usual.collect()) != []
