"""Edge cases and properties of the matching and the scores."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import matching as M
from tidegrid.plans import scoring as SC

PRED = "pred_id BIGINT, scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT, objectness_p DOUBLE, is_vessel_p DOUBLE, is_fishing_p DOUBLE, vessel_length_m DOUBLE"
GOLD = "detect_id BIGINT, scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT, confidence STRING, is_vessel BOOLEAN, is_fishing BOOLEAN, vessel_length_m DOUBLE, distance_from_shore_km DOUBLE"


def preds(spark, points, scene="a", p=0.9):
    return spark.createDataFrame([(i, scene, r, c, p, 0.9, 0.1, 450.0) for i, (r, c) in enumerate(points)], PRED)


def golds(spark, points, scene="a", confidence="HIGH", length=600.0, vessel=True):
    return spark.createDataFrame([(i, scene, r, c, confidence, vessel, False, length, 5.0) for i, (r, c) in enumerate(points)], GOLD)


def pairs(df):
    return sorted((r["pred_id"], r["detect_id"]) for r in df.collect())


def test_exact_tolerance_is_assigned_but_not_counted(spark):
    assert pairs(M.match(preds(spark, [(0, 0)]), golds(spark, [(12, 16)]))) == []
    assert pairs(M.match(preds(spark, [(0, 0)]), golds(spark, [(12, 15)]))) == [(0, 0)]


def test_more_pairs_come_before_short_ones(spark):
    assert pairs(M.match(preds(spark, [(0, 0), (0, 20)]), golds(spark, [(0, 5), (0, -14)]))) == [(0, 1), (1, 0)]


def test_low_match_removes_the_detection(spark):
    low = golds(spark, [(0, 0)], confidence="LOW")
    high = golds(spark, [(500, 500)]).withColumn("detect_id", F.lit(7).cast("bigint"))
    scores = SC.official_scores(preds(spark, [(1, 1), (500, 500)]), low.unionByName(high)).first()
    assert scores["loc_fscore"] == 1.0


def test_scene_without_labels_is_not_counted(spark):
    p = preds(spark, [(0, 0)]).unionByName(preds(spark, [(5, 5), (6, 6)], "b").withColumn("pred_id", F.col("pred_id") + 10))
    row = SC.detection_scores(p, golds(spark, [(0, 0)])).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 0, 0)


def test_labels_without_detections(spark):
    row = SC.official_scores(preds(spark, []), golds(spark, [(0, 0)])).first()
    assert row["loc_fscore"] == 0.0 and row["aggregate"] == 0.0


def test_zero_and_long_lengths(spark):
    p = preds(spark, [(0, 0)])
    assert SC.official_scores(p, golds(spark, [(0, 0)], length=0.0)).first()["length_acc"] == 0.0
    assert math.isclose(SC.official_scores(p, golds(spark, [(0, 0)])).first()["length_acc"], 0.9)


def test_unknown_class_counts_for_detection_only(spark):
    row = SC.official_scores(preds(spark, [(0, 0)]), golds(spark, [(0, 0)], vessel=None)).first()
    assert row["loc_fscore"] == 1.0 and row["vessel_fscore"] == 0.0


def test_point_on_the_shoreline_vertex_is_not_near(spark):
    shore = spark.createDataFrame([("a", 0, 0)], "scene_id STRING, pt_row BIGINT, pt_col BIGINT")
    marked = SC.mark_near_shore(preds(spark, [(0, 0), (0, 1), (0, 500)]), shore, 220)
    assert {r["pred_id"]: r["near_shore"] for r in marked.collect()} == {0: False, 1: True, 2: False}


def brute(ps, gs, limit2=400):
    best, cost = 0, 0.0
    n = min(len(ps), len(gs))
    for size in range(n, 0, -1):
        found = None
        for a in itertools.combinations(range(len(ps)), size):
            for b in itertools.permutations(range(len(gs)), size):
                d2 = [(ps[i][0] - gs[j][0]) ** 2 + (ps[i][1] - gs[j][1]) ** 2 for i, j in zip(a, b)]
                if max(d2) <= limit2:
                    total = sum(map(math.sqrt, d2))
                    found = total if found is None else min(found, total)
        if found is not None:
            return size, found
    return best, cost


@pytest.mark.parametrize("sizes", [{}, {"block_px": 30, "edges_per_group": 1}, {"block_px": 30, "edges_per_group": 1, "component_edges": 0}])
def test_small_scenes_with_copies_match_exhaustive_search(spark, sizes):
    """Points repeat, lie across block borders, and are solved in one run over many scenes."""
    rng = random.Random(11)
    p_rows, g_rows, want = [], [], {}
    for s in range(40):
        ps = [(rng.randrange(-5, 60), rng.randrange(-5, 60)) for _ in range(rng.randint(1, 4))]
        gs = [(rng.randrange(-5, 60), rng.randrange(-5, 60)) for _ in range(rng.randint(1, 4))]
        if s % 2:
            ps[-1], gs[-1] = ps[0], gs[0]
        want[f"s{s}"] = brute([(a, b) for a, b in ps], gs, 399.5)
        p_rows += [(s * 100 + i, f"s{s}", r, c, 0.9, 0.9, 0.1, 100.0) for i, (r, c) in enumerate(ps)]
        g_rows += [(s * 100 + i, f"s{s}", r, c, "HIGH", True, False, 100.0, 5.0) for i, (r, c) in enumerate(gs)]
    got = M.match(spark.createDataFrame(p_rows, PRED), spark.createDataFrame(g_rows, GOLD), 200 - 1e-3, **sizes).collect()
    assert len({r["pred_id"] for r in got}) == len(got) == len({r["detect_id"] for r in got})
    for scene, (count, cost) in want.items():
        mine = [r["d2"] for r in got if r["scene_id"] == scene]
        assert len(mine) == count
        assert math.isclose(sum(map(math.sqrt, mine)), cost, abs_tol=1e-6)


TIED = [(r * 10, c * 10) for r in range(5) for c in range(5)]


@pytest.mark.parametrize("sizes", [{"block_px": 20, "edges_per_group": 1}, {"block_px": 20, "edges_per_group": 1, "component_edges": 0}])
def test_all_paths_pick_the_same_pairs_on_tied_lattices(spark, sizes):
    """More detections than labels on a lattice: many optima of equal length, one choice whatever the path."""
    rng = random.Random(4)
    p_rows, g_rows = [], []
    for s in range(12):
        ps, gs = rng.sample(TIED, 14), [(r + 5, c + 5 * (s % 2)) for r, c in rng.sample(TIED, 7)]
        p_rows += [(s * 100 + i, f"s{s}", r, c, 0.9, 0.9, 0.1, 100.0) for i, (r, c) in enumerate(ps)]
        g_rows += [(s * 100 + i, f"s{s}", r, c, "HIGH", True, False, 100.0, 5.0) for i, (r, c) in enumerate(gs)]
    p, g = spark.createDataFrame(p_rows, PRED), spark.createDataFrame(g_rows, GOLD)
    assert pairs(M.match(p, g, **sizes)) == pairs(M.match(p, g))


def test_many_copies_on_one_pixel(spark):
    p = preds(spark, [(3, 3)] * 500 + [(4, 4)] * 3)
    g = golds(spark, [(3, 4)] * 200 + [(10, 10)] * 400)
    got = pairs(M.match(p, g))
    assert len(got) == 503 and len({a for a, _ in got}) == 503 and len({b for _, b in got}) == 503


def test_a_sweep_equals_single_cuts(spark):
    rng = random.Random(5)
    p = spark.createDataFrame(
        [(i, "a", rng.randrange(120), rng.randrange(120), rng.random(), rng.random(), rng.random(), 100.0) for i in range(60)], PRED
    )
    kinds = ["LOW", "MEDIUM", "HIGH"]
    g = spark.createDataFrame(
        [(i, "a", rng.randrange(120), rng.randrange(120), kinds[i % 3], i % 2 == 0, i % 4 == 0, 50.0 + i, i / 10) for i in range(60)], GOLD
    )
    cuts = [0.2, 0.5, 0.8]
    swept = {(r["objectness_threshold"], r["is_vessel_threshold"], r["is_fishing_threshold"]): r["aggregate"] for r in SC.sweep_thresholds(p, g, None, cuts).collect()}
    for cut in cuts:
        for r in SC.official_scores(p.filter(F.col("objectness_p") >= cut), g).collect():
            assert math.isclose(swept[cut, r["is_vessel_threshold"], r["is_fishing_threshold"]], r["aggregate"], abs_tol=1e-12)


def test_connected_parts_closes_long_chains(spark):
    links = spark.range(200).selectExpr("id AS part", "explode(array(id, id + 1)) AS g")
    roots = M.connected_parts(links).collect()
    assert len(roots) == 200 and {r["root"] for r in roots} == {0}


def test_piecewise_solution_equals_the_direct_one(spark):
    """A sweep with LOW labels and a shore: all components through the large-component path, and none."""
    from tidegrid.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    near = F.col("detect_scene_row") % 3 != 0
    pred, gold = fx.pred.withColumn("near_shore", near), fx.gt.withColumn("near_shore", near)
    # crowd the points, so that components grow long
    half = {c: F.floor(F.col(c) / 3).cast("bigint") for c in ("detect_scene_row", "detect_scene_column")}
    pred, gold = pred.withColumns(half), gold.withColumns(half)

    def summary(**sizes):
        rows = M.match_levels(pred, gold, [0.2, 0.7], drop_low=True, shore=True, **sizes)
        cut = rows.withColumn("k", F.explode(F.sequence(F.col("k_from"), F.col("k_to") - 1)))
        cost = F.round(F.sum(F.sqrt("d2")), 3)
        return sorted(map(tuple, cut.groupBy("kind", "k").agg(F.count("*"), cost, F.count_distinct("pred_id"), F.count_distinct("detect_id")).collect()))

    direct = summary()
    assert summary(block_px=100, edges_per_group=1, component_edges=0) == direct
    assert all(row[2] == row[4] == row[5] for row in direct)
