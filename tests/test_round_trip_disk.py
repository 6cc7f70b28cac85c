"""Drawing, decoding and matching send a row where it is needed, not to all its neighbours, and leave no shuffle files behind."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import heatmap as H
from tidegrid.operators import matching as M
from tidegrid.operators.spatial import close_pairs
from tidegrid.plans import targets as TG
from tidegrid.session import cut_lineage

PIXELS = "scene_id STRING, r BIGINT, c BIGINT, obj DOUBLE, note STRING"


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_when_the_rows_are_written(spark):
    there = _shuffle_files(spark)
    counts = cut_lineage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), free=True)
    until = time.time() + 10
    while (left := _shuffle_files(spark) - there) and time.time() < until:
        time.sleep(0.2)
    assert not left and counts.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_pixels_are_not_told_to_all_their_neighbours(spark):
    px = spark.range(100).selectExpr("'a' AS scene_id", "id * 5 AS r", "id * 7 AS c", "0.5D AS obj", "'x' AS note")
    plan = H.local_maxima_sparse(px, "obj")._jdf.queryExecution().optimizedPlan().toString()
    assert "partial_" not in plan and "Aggregate" not in plan
    assert H.local_maxima_sparse(px, "obj").count() == 100


def test_maxima_across_blocks_and_missing_places(spark):
    side = H.MAXIMA_BLOCK
    rows = [("a", side - 1, side - 1, 0.5, "corner"), ("a", side, side, 0.6, "over"), ("a", side - 1, side, 0.6, "equal"), ("a", -1, 0, 0.3, "below"), ("a", 0, 0, 0.4, "first")]
    rows += [("a", 9, 9, None, "no value"), ("a", 9, 10, 0.1, "by it"), ("b", 1, 1, float("nan"), "nan"), ("b", 1, 2, 9.0, "under it")]
    rows += [("c", None, 5, 0.2, "low"), ("c", None, 6, 0.3, "line"), (None, 0, 0, 0.1, "scene"), ("d", 3, 3, 0.7, "twice"), ("d", 3, 3, 0.7, "twice")]
    got = H.local_maxima_sparse(spark.createDataFrame(rows, PIXELS), "obj")
    assert got.columns == ["scene_id", "r", "c", "obj", "note"]
    assert sorted(x.note for x in got.collect()) == ["by it", "equal", "first", "line", "nan", "over", "scene", "twice"]


def test_labels_are_not_sent_to_nine_cells(spark):
    at = "'a' AS scene_id", "id * 37 % 1499 AS detect_scene_row", "id * 91 % 1511 AS detect_scene_column"
    pred = spark.range(600).selectExpr(*at, "id AS pred_id", "1 AS k", "false AS ps")
    gold = spark.range(600).selectExpr(*at, "id AS detect_id", "false AS low", "false AS gs")
    p, g = M.block_nodes(pred, gold, M.BLOCK_PX, 20, 4, 8)
    assert p.count() == 600 and 600 <= g.count() < 660


@pytest.mark.parametrize("at_once", [3, 2_000_000])
def test_pairs_inside_a_task_are_those_of_all_comparisons(at_once):
    rng = np.random.default_rng(2)
    a, b = ([rng.integers(0, 3, n), rng.integers(-40, 40, n), rng.integers(-40, 40, n)] for n in (90, 70))
    a[1][0], b[2][0] = 10**17, -(10**17)
    i, j, d2 = close_pairs(a, b, 7.5, at_once)
    want = {(x, y): (a[1][x] - b[1][y]) ** 2 + (a[2][x] - b[2][y]) ** 2 for x in range(1, 90) for y in range(1, 70) if a[0][x] == b[0][y]}
    assert sorted(zip(i.tolist(), j.tolist(), d2.tolist())) == sorted((x, y, d) for (x, y), d in want.items() if d <= 7.5**2)
    nothing = [np.zeros(0, dtype=np.int64)] * 3
    assert len(close_pairs(a, nothing, 7.5)[0]) == len(close_pairs(nothing, b, 7.5)[0]) == 0


def test_a_block_is_drawn_in_steps(monkeypatch):
    n, rng = 200, np.random.default_rng(3)
    whole = {k: rng.integers(0, TG.MAP_BLOCK + 4, n) for k in ("oy", "ox")} | {"block_r": np.zeros(n, int), "block_c": np.zeros(n, int), "w_id": np.arange(n), "w_rank": np.ones(n, int)}
    real = {k: rng.random(n) for k in ("vsl", "fsh", "len_log", "w_neg", "w_vsl", "w_fsh", "w_len_log", "w_off_x", "w_off_y")}
    size = {"radius": rng.integers(1, 5, n).astype("int32"), "label_radius": rng.integers(1, 4, n).astype("int32"), "ignored": rng.random(n) < 0.2}
    table = pa.table({"scene_id": ["a"] * n} | whole | real | size)
    at_once = TG._draw_block(400, 400, True, 255.0)(table)
    monkeypatch.setattr(TG, "DRAWN", 64)
    assert at_once.num_rows > n and TG._draw_block(400, 400, True, 255.0)(table).equals(at_once)


@pytest.mark.parametrize("labels", ["circle", "point"])
def test_objects_are_sent_with_what_is_drawn_only(spark, labels):
    schema = "scene_id STRING, detect_id BIGINT, x BIGINT, y BIGINT, confidence STRING, is_vessel BIGINT, is_fishing BIGINT, length_px DOUBLE"
    rows = [("a", 1, 16, 18, "HIGH", 0, 1, 4.0), ("a", 1, 18, 16, "HIGH", 1, 0, 4.0), ("a", 2, 17, 17, "LOW", 255, 255, 9.0)]
    maps = TG.encode_targets(spark.createDataFrame(rows, schema), 64, 64, 16, labels=labels, fixed_radius=1)
    sent = maps._jdf.queryExecution().optimizedPlan().toString()
    assert ("w_len_log" in sent) == (labels == "point") and ("max(len_log" in sent) == (labels == "circle")
    centre = maps.filter("r = 1 AND c = 1").first()
    # of the two with one id the vessel is written last
    assert (centre["off_x"], centre["off_y"]) == (2 / 16, 0.0)
    assert (centre["vsl"], centre["fsh"]) == ((255.0, 255.0) if labels == "circle" else (1.0, 0.0))
