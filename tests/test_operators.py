"""Properties of maps, folds, weights and samples."""

import pytest
from pyspark.sql import functions as F

from registry.samples import _draws
from tidegrid.fixtures import Fixtures
from tidegrid.functions.labels import apply_low_policy
from tidegrid.operators import folds as FO
from tidegrid.operators import heatmap as H
from tidegrid.operators import profile as P
from tidegrid.operators import ranking as R
from tidegrid.operators import sampling as SA
from tidegrid.operators import tiles as T
from tidegrid.operators import weights as W
from tidegrid.sources.tables import resolve_shoreline

FOLDER = "/root/testdata/sf0.001"


def test_plateau_keeps_both_and_diagonal_neighbour_suppresses(spark):
    rows = [("a", 0, 0, 0.7), ("a", 1, 1, 0.9), ("b", 0, 0, 0.8), ("b", 0, 1, 0.8)]
    got = H.local_maxima_sparse(spark.createDataFrame(rows, "scene_id STRING, r BIGINT, c BIGINT, obj DOUBLE"), "obj").collect()
    assert sorted((r["scene_id"], r["r"], r["c"]) for r in got) == [("a", 1, 1), ("b", 0, 0), ("b", 0, 1)]


def test_low_policies_exclude_each_other(spark):
    with pytest.raises(ValueError):
        apply_low_policy(spark.range(1), True, True)


def test_tight_maxima_know_two_kernels(spark):
    with pytest.raises(ValueError):
        H.tight_maxima_dense(spark.range(1), "obj", 7)


def test_merging_constant_tiles_is_constant(spark):
    px = spark.range(30 * 30).selectExpr("'a' AS scene_id", "id DIV 30 AS r", "id % 30 AS c", "5.0D AS v")
    cut = T.cut_tiles(px, 16, 12, "v")
    merged = T.merge_tiles(cut, ["v"], T.pyramid_weight(F.col("y"), F.col("x"), 16, 16))
    assert merged.count() == 900 and merged.filter("abs(v - 5) > 1e-9").isEmpty()


def test_folds_never_split_a_scene(spark):
    gt = Fixtures(spark, FOLDER).gt
    folds = FO.stratified_group_folds(gt, "scene_id", F.lit(0), 2)
    assert folds.count() == gt.select("scene_id").distinct().count() == folds.select("scene_id").distinct().count()


def test_missing_location_is_an_error(spark):
    labels = spark.createDataFrame([("a",), ("b",)], "scene_id STRING")
    places = spark.createDataFrame([("a", "x")], "scene_id STRING, location STRING")
    with pytest.raises(Exception, match="no location for scene b"):
        FO.attach_location(labels, places).collect()


def test_missing_shoreline_is_an_error(spark):
    scenes = spark.createDataFrame([("a",), ("b",)], "scene_id STRING")
    points = spark.createDataFrame([("a", 1.0, 2.0)], "scene_id STRING, pt_row DOUBLE, pt_col DOUBLE")
    with pytest.raises(Exception, match="no shoreline for scene b"):
        resolve_shoreline(scenes, [points]).collect()


def test_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0), (3, 6.0)], "id BIGINT, w DOUBLE")
    counts = {r["id"]: r["count"] for r in SA.weighted_draws(items, "id", "w", 20000, 1).groupBy("id").count().collect()}
    assert sum(counts.values()) == 20000 and 2 not in counts
    for item, share in ((0, 0.1), (1, 0.3), (3, 0.6)):
        assert abs(counts[item] / 20000 - share) < 0.02


def test_draws_do_not_depend_on_partitioning(spark):
    fx = Fixtures(spark, FOLDER)
    first = {tuple(r) for r in _draws(fx).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = {tuple(r) for r in _draws(fx).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again


def test_chunked_rank_is_a_rank(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id * 7919 % 1000 AS v")
    got = R.chunked_rank(df, [F.col("v")], F.floor(F.col("v") / 100), "rank", ["g"])
    want = df.selectExpr("g", "v", "row_number() OVER (PARTITION BY g ORDER BY v) AS rank")
    assert got.select("g", "v", "rank").exceptAll(want.selectExpr("g", "v", "bigint(rank)")).isEmpty()


def _shore_labels(spark, km):
    rows = [(i, "a" if i < 2 else "b", 10 * i, 10 * i, True, False, 50.0, "HIGH", float(k)) for i, k in enumerate(km)]
    kinds = "detect_id BIGINT, scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT, is_vessel BOOLEAN, is_fishing BOOLEAN, vessel_length_m DOUBLE, confidence STRING, distance_from_shore_km DOUBLE"
    return spark.createDataFrame(rows, kinds)


def test_shore_part_counts_where_a_near_row_exists(spark):
    got = {r["detect_id"]: r["weight"] for r in W.per_scene_weight(_shore_labels(spark, [0, 0, 9, 9]), 200, near_shore=True).collect()}
    assert got == {0: 1.5, 1: 1.5, 2: 1.0, 3: 1.0}
    all_near = W.combined_weight(_shore_labels(spark, [0, 0, 0, 0]), 200, near_shore=True)
    all_off = W.combined_weight(_shore_labels(spark, [9, 9, 9, 9]), 200, near_shore=True)
    assert {r["weight"] for r in all_near.collect()} == {2.0} and {r["weight"] for r in all_off.collect()} == {1.0}


def test_zero_length_makes_the_plain_length_score_zero(spark):
    df = spark.createDataFrame([(10.0, 10.0), (5.0, 0.0)], "p DOUBLE, a DOUBLE")
    assert P.plain_length_score(df, F.col("p"), F.col("a"), "s").first()[0] == 0.0


def test_retries_give_every_sample(spark):
    scenes = spark.createDataFrame([("a", 60, 60)], "scene_id STRING, scene_rows BIGINT, scene_cols BIGINT")
    labels = spark.createDataFrame([("a", 1, 30, 30, 0.0)], "scene_id STRING, detect_id BIGINT, detect_scene_row BIGINT, detect_scene_column BIGINT, weight DOUBLE")
    shore = spark.createDataFrame([("a", 1, 50, 50)], "scene_id STRING, point_id BIGINT, pt_row BIGINT, pt_col BIGINT")
    px = spark.range(3600).selectExpr("'a' AS scene_id", "id DIV 60 AS r", "id % 60 AS c", "IF(id DIV 60 < 20, 1.0D, NULL) AS v")
    got = SA.crops_with_signal(scenes, labels, shore, px, "v", 12, 10, 0.9, 1, 0.5, 16)
    assert got.count() == 12 and got.filter("missing > 0.5 OR source = 'object'").isEmpty()
    with pytest.raises(ValueError, match="scene a"):
        SA.crops_with_signal(scenes, labels, shore, px.withColumn("v", F.lit(None).cast("double")), "v", 2, 10, 0.9, 1, 0.5, 16, patience=3)


def test_pasted_boxes_use_any_free_pixel_and_keep_their_distance(spark):
    images = spark.range(300).selectExpr("id AS image_id")
    boxes = images.selectExpr("image_id", "1L AS box_no", "20 AS x1", "20 AS y1", "40 AS x2", "40 AS y2")
    donors = spark.createDataFrame([(1, 5, 7, 1.0)], "donor_id INT, donor_h INT, donor_w INT, weight DOUBLE")
    got = SA.paste_plan(images, boxes, donors, 60, 60, seed=3).collect()
    assert len(got) == 300 and len({(r["x1"] + 3) % 16 for r in got}) == 16
    for r in got:
        cx, cy = r["x1"] + 3, r["y1"] + 2
        assert max(20 - cx, cx - 39, 0) ** 2 + max(20 - cy, cy - 39, 0) ** 2 > 49
        assert r["x1"] > 0 and r["y1"] > 0 and r["x2"] < 60 and r["y2"] < 60
    full = images.selectExpr("image_id", "1L AS box_no", "0 AS x1", "0 AS y1", "60 AS x2", "60 AS y2")
    assert SA.paste_plan(images, full, donors, 60, 60, seed=3, patience=20).isEmpty()
