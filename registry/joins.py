"""Joins, matching and sampling plans on boxes."""

from pyspark.sql import functions as F

from registry.core import add
from registry.matching_sql import INTEGER_NEAR, match_ctes
from tidegrid.functions import labels as L
from tidegrid.operators import folds as FO
from tidegrid.operators import matching as M
from tidegrid.operators import overlap as O
from tidegrid.operators import spatial as SP
from tidegrid.operators import tiles as TL
from tidegrid.plans import scoring as SC

C = F.col
SHORE_PX = 60

add(
    "j1_attach_split",
    lambda fx: FO.attach_split(fx.gt, fx.scn).select("detect_id", "scene_id", "fold", "location"),
    "SELECT detect_id, g.scene_id, fold, location FROM gt_fx g JOIN scn_fx s ON g.scene_id = s.scene_id",
)
# scene 's0' has no row among the scenes, so the complete list of locations is derived from the labels
_PLACES_SQL = """SELECT scene_id, CASE WHEN CAST(substr(scene_id, 2) AS BIGINT) % 3 = 0 THEN '19' ELSE concat('L', CAST(CAST(substr(scene_id, 2) AS BIGINT) % 7 AS STRING)) END AS location FROM gt_fx GROUP BY scene_id"""


def places(fx):
    n = F.expr("CAST(substr(scene_id, 2) AS BIGINT)")
    location = F.when(n % 3 == 0, "19").otherwise(F.concat(F.lit("L"), (n % 7).cast("string")))
    return fx.gt.select("scene_id").distinct().withColumn("location", location)


add(
    "j2_attach_location",
    lambda fx: FO.attach_location(fx.gt, places(fx)).select("detect_id", "location"),
    f"SELECT detect_id, location FROM gt_fx g JOIN ({_PLACES_SQL}) p ON g.scene_id = p.scene_id",
)
add(
    "j2b_split_sink",
    lambda fx: FO.attach_location(fx.gt, places(fx), sink_as_scene=True).select("detect_id", "location"),
    f"SELECT detect_id, CASE WHEN location = '19' THEN g.scene_id ELSE location END AS location FROM gt_fx g JOIN ({_PLACES_SQL}) p ON g.scene_id = p.scene_id",
)
add(
    "j3_attach_size",
    lambda fx: FO.attach_size(fx.gt, fx.scn.select("scene_id", "scene_rows", "scene_cols")).select("detect_id", "scene_rows", "scene_cols"),
    "SELECT detect_id, scene_rows, scene_cols FROM gt_fx g JOIN scn_fx s ON g.scene_id = s.scene_id",
)
add(
    "j4_exclude_scenes",
    lambda fx: FO.exclude_scenes(fx.gt, fx.scn.filter("official_split = 'validation'")).select("detect_id", "scene_id"),
    "SELECT detect_id, scene_id FROM gt_fx WHERE scene_id NOT IN (SELECT scene_id FROM scn_fx WHERE official_split = 'validation')",
)
add(
    "j5_restrict_scenes",
    lambda fx: FO.restrict_scenes(fx.gt, fx.scn.filter("official_split = 'train'")).select("detect_id", "scene_id"),
    "SELECT detect_id, scene_id FROM gt_fx WHERE scene_id IN (SELECT scene_id FROM scn_fx WHERE official_split = 'train')",
)


def _points(fx):
    p = fx.pred.select("scene_id", "pred_id", C("detect_scene_row").alias("p_r"), C("detect_scene_column").alias("p_c"))
    g = fx.gt.select("scene_id", "detect_id", C("detect_scene_row").alias("g_r"), C("detect_scene_column").alias("g_c"))
    return p, g


add(
    "j6_pairs_within",
    lambda fx: SP.pairs_within(*_points(fx), 20, ("p_r", "p_c"), ("g_r", "g_c")).select("scene_id", "pred_id", "detect_id", "d2"),
    f"SELECT p.scene_id, pred_id, detect_id, {INTEGER_NEAR} AS d2 FROM pred_fx p JOIN gt_fx g ON p.scene_id = g.scene_id WHERE {INTEGER_NEAR} <= 400",
)
ALL_PRED = "SELECT 0 AS t, scene_id, pred_id, detect_scene_row AS r, detect_scene_column AS c FROM pred_fx"
ALL_GOLD = "SELECT 0 AS t, scene_id, detect_id, detect_scene_row AS r, detect_scene_column AS c FROM gt_fx"
MATCH = "WITH RECURSIVE " + match_ctes("x", ALL_PRED, ALL_GOLD)
add("j7_optimal_matching", lambda fx: M.match(fx.pred, fx.gt), MATCH + " SELECT scene_id, pred_id, detect_id, d2 FROM x_m")
add(
    "j7_small_blocks",
    lambda fx: M.match(fx.pred, fx.gt, block_px=300, edges_per_group=100).groupBy("scene_id").agg(F.count("*").alias("pairs"), F.sum("d2").alias("sum_d2")),
    MATCH + " SELECT scene_id, count(*) AS pairs, CAST(sum(d2) AS BIGINT) AS sum_d2 FROM x_m GROUP BY scene_id",
)
add(
    "j7a_isolated_matching",
    lambda fx: M.isolated_matches(fx.pred, fx.gt),
    f"""WITH e AS (SELECT p.scene_id, pred_id, detect_id, {INTEGER_NEAR} AS d2 FROM pred_fx p JOIN gt_fx g ON p.scene_id = g.scene_id WHERE {INTEGER_NEAR} <= 400)
 SELECT scene_id, pred_id, detect_id, d2 FROM (SELECT *, count(*) OVER (PARTITION BY pred_id) AS n1, count(*) OVER (PARTITION BY detect_id) AS n2 FROM e) WHERE n1 = 1 AND n2 = 1 AND d2 < 400""",
)
LOW_IDS = "SELECT pred_id FROM x_m WHERE detect_id IN (SELECT detect_id FROM gt_fx WHERE confidence = 'LOW')"
add(
    "j8_drop_low_matches",
    lambda fx: M.drop_low_matches(fx.pred, fx.gt).select("pred_id", "scene_id"),
    MATCH + f" SELECT pred_id, scene_id FROM pred_fx WHERE pred_id NOT IN ({LOW_IDS})",
)
add(
    "j9_outcomes",
    lambda fx: M.outcomes(fx.pred, L.keep_confident(fx.gt)).groupBy("scene_id", "outcome").agg(F.count("*").alias("n")),
    "WITH RECURSIVE "
    + match_ctes("y", ALL_PRED, ALL_GOLD + " WHERE confidence <> 'LOW'")
    + """, g AS (SELECT scene_id, detect_id FROM gt_fx WHERE confidence <> 'LOW')
 SELECT scene_id, 'TP' AS outcome, count(*) AS n FROM y_m GROUP BY 1
 UNION ALL SELECT scene_id, 'FP', count(*) FROM pred_fx WHERE scene_id IN (SELECT scene_id FROM g) AND pred_id NOT IN (SELECT pred_id FROM y_m) GROUP BY 1
 UNION ALL SELECT scene_id, 'FN', count(*) FROM g WHERE detect_id NOT IN (SELECT detect_id FROM y_m) GROUP BY 1""",
)
add(
    "j10_near_shore",
    lambda fx: SP.near_any(fx.pred, fx.shore, SHORE_PX, SC.POINT, ("pt_row", "pt_col")).select("pred_id", "scene_id"),
    f"""SELECT pred_id, scene_id FROM pred_fx p WHERE EXISTS (SELECT 1 FROM shore_fx s WHERE s.scene_id = p.scene_id
 AND (detect_scene_row-pt_row)*(detect_scene_row-pt_row)+(detect_scene_column-pt_col)*(detect_scene_column-pt_col) BETWEEN 1 AND {SHORE_PX * SHORE_PX})""",
)
add(
    "j11_crowd_count",
    lambda fx: SP.square_neighbours(fx.gt, 100, SC.POINT).select("detect_id", "neighbours"),
    """SELECT a.detect_id, count(*) AS neighbours FROM gt_fx a JOIN gt_fx b ON a.scene_id = b.scene_id
 AND greatest(abs(a.detect_scene_row-b.detect_scene_row), abs(a.detect_scene_column-b.detect_scene_column)) <= 100 GROUP BY 1""",
)


def _crops(fx):
    """Crops of 300 pixels every 250, so that they overlap."""
    scenes = fx.gt.select("scene_id").distinct().withColumns({"scene_rows": F.lit(1500).cast("bigint"), "scene_cols": F.lit(1520).cast("bigint")})
    return TL.regular_crops(scenes, 300, 250).withColumn("crop_id", C("r0") * 10000 + C("c0"))


CROPS_SQL = """SELECT scene_id, r*10000+c AS crop_id, r AS r0, r+300 AS r1, c AS c0, c+300 AS c1 FROM (SELECT DISTINCT scene_id FROM gt_fx), range(0, 1201, 250) a(r), range(0, 1221, 250) b(c)"""
add(
    "j12_points_in_crops",
    lambda fx: SP.points_in_crops(fx.gt.select("scene_id", "detect_id", *SC.POINT), _crops(fx), 512).select("scene_id", "crop_id", "detect_id", "crop_row", "crop_col"),
    f"""SELECT k.scene_id, crop_id, detect_id, detect_scene_row-r0 AS crop_row, detect_scene_column-c0 AS crop_col FROM ({CROPS_SQL}) k LEFT JOIN gt_fx g
 ON g.scene_id = k.scene_id AND detect_scene_row >= r0 AND detect_scene_row < r1 AND detect_scene_column >= c0 AND detect_scene_column < c1""",
)
IOU_SQL = """SELECT a.image_id, a.box_no, b.box_no AS other_no, inter / CAST((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - inter AS DOUBLE) AS iou
 FROM box_fx a JOIN box_fx b ON a.image_id = b.image_id AND a.box_no < b.box_no,
 LATERAL (SELECT greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) AS inter) i WHERE inter > 0"""
add("j13_box_iou", lambda fx: O.overlapping_pairs(fx.box), f"SELECT image_id, box_no, other_no, round(iou, 6) AS iou FROM ({IOU_SQL})")
add("j14_drop_boxes", lambda fx: O.drop_boxes(fx.box, seed=5, max_objects=3, max_fraction=0.5))
add(
    "j15_points_outside_holes",
    lambda fx: SP.points_outside_holes(fx.box.select("image_id", "box_no", C("x1").alias("x"), C("y1").alias("y")), fx.hole),
    """SELECT image_id, box_no, x1 AS x, y1 AS y FROM box_fx b WHERE NOT EXISTS (SELECT 1 FROM hole_fx h WHERE h.image_id = b.image_id
 AND x1 >= hx1 AND x1 < hx2 AND y1 >= hy1 AND y1 < hy2)""",
)
add(
    "j16_visible_fraction",
    lambda fx: O.hide_under_holes(fx.box.withColumn("label", C("box_no") % 3), fx.hole, "label", 9).select("image_id", "box_no", "label", "visible"),
    """WITH px AS (SELECT DISTINCT image_id, x, y FROM hole_fx, range(0, 100) a(x), range(0, 100) b(y) WHERE x >= hx1 AND x < hx2 AND y >= hy1 AND y < hy2),
 v AS (SELECT b.image_id, b.box_no, 1 - count(px.x) / CAST(any_value((x2-x1)*(y2-y1)) AS DOUBLE) AS visible FROM box_fx b
 LEFT JOIN px ON px.image_id = b.image_id AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY 1, 2)
 SELECT image_id, box_no, CASE WHEN visible < 0.75 THEN 9 ELSE box_no % 3 END AS label, round(visible, 6) AS visible FROM v WHERE visible > 0.5""",
)


def _gather(fx):
    maps = fx.pix.select("scene_id", C("px_row").alias("r"), C("px_col").alias("c"), "heat", "vv_db")
    objects = fx.gt.select("detect_id", "scene_id", (C("detect_scene_row") % 50).alias("r"), (C("detect_scene_column") % 50).alias("c"))
    return objects.join(maps, ["scene_id", "r", "c"]).select("detect_id", "heat", C("vv_db").alias("vv"))


add(
    "j17_gather_at_objects",
    _gather,
    """SELECT detect_id, heat, round(vv_db, 6) AS vv FROM gt_fx g JOIN pix_fx p ON p.scene_id = g.scene_id AND px_row = detect_scene_row % 50 AND px_col = detect_scene_column % 50""",
)


def _threshold_grid(fx):
    """Each scene's mean scores against a grid of class thresholds."""
    values = [F.lit(t / 10) for t in range(11)]
    means = fx.pred.groupBy("scene_id").agg(F.avg("is_vessel_p").alias("v"), F.avg("is_fishing_p").alias("f"))
    grid = means.withColumn("tv", F.explode(F.array(*values))).withColumn("tf", F.explode(F.array(*values)))
    return grid.select("scene_id", "tv", "tf", (C("v") >= C("tv")).alias("vessel"), (C("f") >= C("tf")).alias("fishing"))


add(
    "j18_threshold_grid",
    _threshold_grid,
    """SELECT scene_id, a/10::DOUBLE AS tv, b/10::DOUBLE AS tf, v >= a/10::DOUBLE AS vessel, f >= b/10::DOUBLE AS fishing FROM
 (SELECT scene_id, avg(is_vessel_p) AS v, avg(is_fishing_p) AS f FROM pred_fx GROUP BY 1), range(0,11) x(a), range(0,11) y(b)""",
)
add(
    "j19_crop_targets",
    lambda fx: SP.points_in_crops(L.keep_confident(fx.gt).select("scene_id", "detect_id", *SC.POINT, "is_vessel"), _crops(fx), 512)
    .groupBy("scene_id", "crop_id").agg(F.count("detect_id").alias("objects"), F.count_if("is_vessel").alias("vessels")),
    f"""SELECT k.scene_id, crop_id, count(detect_id) AS objects, count(*) FILTER (is_vessel) AS vessels FROM ({CROPS_SQL}) k LEFT JOIN gt_fx g
 ON g.scene_id = k.scene_id AND confidence <> 'LOW' AND detect_scene_row >= r0 AND detect_scene_row < r1 AND detect_scene_column >= c0 AND detect_scene_column < c1 GROUP BY 1, 2""",
)
add(
    "j20_confirm_labels",
    lambda fx: M.confirm_labels(fx.gt, fx.pred.filter("objectness_p >= 0.5")).select("detect_id", "ignored"),
    "WITH RECURSIVE " + match_ctes("x", ALL_PRED + " WHERE objectness_p >= 0.5", ALL_GOLD) + " SELECT detect_id, detect_id NOT IN (SELECT detect_id FROM x_m) AS ignored FROM gt_fx",
)
add(
    "u1_union",
    lambda fx: L.keep_confident(fx.gt).select("scene_id", C("detect_id").alias("id"), "confidence").unionByName(fx.pred.select("scene_id", C("pred_id").alias("id")), allowMissingColumns=True),
    "SELECT scene_id, detect_id AS id, confidence FROM gt_fx WHERE confidence <> 'LOW' UNION ALL SELECT scene_id, pred_id, NULL FROM pred_fx",
)
add("u2_distinct", lambda fx: fx.gt.select("scene_id", "confidence").distinct(), "SELECT DISTINCT scene_id, confidence FROM gt_fx")
add(
    "u3_membership",
    lambda fx: FO.exclude_scenes(FO.restrict_scenes(fx.shore, fx.gt), fx.scn.filter("official_split = 'test'")).select("point_id", "scene_id"),
    "SELECT point_id, scene_id FROM shore_fx WHERE scene_id IN (SELECT scene_id FROM gt_fx) AND scene_id NOT IN (SELECT scene_id FROM scn_fx WHERE official_split = 'test')",
)
