"""The detection F1 counts the pairs of the optimal matching, not only those without a rival."""

from types import SimpleNamespace

from registry import load

AT = "scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT"


def test_pairs_with_rivals_count(spark):
    pred = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 20, 2), ("b", 5, 5, 3), ("b", 6, 6, 4)], AT + ", pred_id BIGINT")
    gold = spark.createDataFrame([("a", 0, 5, 1), ("a", 0, -14, 2), ("b", 5, 6, 3), ("b", 900, 900, 4)], AT + ", detect_id BIGINT")
    gold = gold.selectExpr("*", "'HIGH' AS confidence")
    row = load()["a9c_detection_f1"].run(SimpleNamespace(pred=pred, gt=gold)).first()
    assert (row["tp"], row["loc_fscore"]) == (3, 0.75)
