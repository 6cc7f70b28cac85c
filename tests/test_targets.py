"""Targets are drawn by blocks: objects are shuffled, their pixels are not."""

from tidegrid.plans import targets as TG

SCHEMA = "scene_id STRING, detect_id BIGINT, x BIGINT, y BIGINT, confidence STRING, is_vessel BIGINT, is_fishing BIGINT, length_px DOUBLE"


def test_objects_at_block_corners_are_drawn_once_and_not_shuffled_by_pixel(spark):
    rows = [("a", 1, 128, 128, "HIGH", 1, 0, 4.0), ("a", 2, 128, 128, "LOW", 0, 255, 9.0), ("a", 3, 299, 0, "HIGH", 0, 1, None)]
    maps = TG.encode_targets(spark.createDataFrame(rows, SCHEMA), 300, 300, 1, fixed_radius=2, labels="point")
    assert "hashpartitioning(scene_id" in (plan := maps._jdf.queryExecution().executedPlan().toString())
    assert "dx" not in plan and "Generate explode(sequence(-" not in plan
    got = {(m["r"], m["c"]): m for m in maps.collect()}
    assert len(got) == 25 + 9 and maps.count() == 34
    assert (got[128, 128]["obj"], got[128, 128]["vsl"], got[128, 128]["fsh"]) == (1.0, 1.0, 0.0)  # HIGH is written last
    assert got[127, 127]["vsl"] == 0.0 and got[127, 127]["obj"] == got[129, 129]["obj"] == got[127, 129]["obj"]
    assert got[0, 299]["fsh"] == 1.0
