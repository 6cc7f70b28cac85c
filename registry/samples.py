"""Weighted draws, crops and training samples."""

from pyspark.sql import functions as F

from registry.core import add, normal_sql, pixels
from registry.joins import CROPS_SQL, _crops
from tidegrid.functions import labels as L
from tidegrid.operators import sampling as SA
from tidegrid.operators import weights as W
from tidegrid.operators.matching import match
from tidegrid.plans import targets as TG
from tidegrid.plans.scoring import POINT
from tidegrid.session import cut_lineage

C = F.col


def _draws(fx):
    weighted = W.balanced_weight(fx.gt.select("detect_id", "confidence"), "confidence", "weight")
    return SA.weighted_draws(weighted, "detect_id", "weight", 5000, seed=11)


add("t5_weighted_draws", _draws)
add(
    "t6_clipped_normal",
    lambda fx: fx.gt.select("detect_id", SA.capped_normal(-64.0, 64.0, F.lit(3), C("detect_id")).alias("jitter")),
    f"SELECT detect_id, round(least(greatest(sqrt(128::DOUBLE) * {normal_sql('3', 'detect_id')}, -64), 64),6) AS jitter FROM gt_fx",
)
SIZE = 1600


def sized(df):
    return df.withColumns({"scene_rows": F.lit(SIZE).cast("bigint"), "scene_cols": F.lit(SIZE).cast("bigint")})


add(
    "t7_crop_around_object",
    lambda fx: SA.crop_around(sized(fx.gt), C("detect_scene_row"), C("detect_scene_column"), 256, 256, C("detect_id") % 65 - 32, C("detect_id") % 33 - 16).select(
        "detect_id", "r0", "r1", "c0", "c1"
    ),
    f"""SELECT detect_id, r0, least({SIZE}, r0+256) AS r1, c0, least({SIZE}, c0+256) AS c1 FROM (SELECT detect_id, greatest(0, detect_scene_row + detect_id%65-32 - 128) AS r0,
 greatest(0, detect_scene_column + detect_id%33-16 - 128) AS c0 FROM gt_fx)""",
)


def _mixed(fx):
    scenes = sized(fx.gt.select("scene_id").distinct())
    weighted = W.balanced_weight(fx.gt, "confidence", "weight")
    return SA.mixed_crops(scenes, weighted, fx.shore, 64, 256, 0.6, seed=5)


add("t8_mixed_crops", _mixed)


def _retry(fx):
    """Twenty 12x12 crops of each pixel scene with at most 60% missing pixels; half of the pixels count as missing."""
    px = pixels(fx).withColumn("vv", F.when(C("heat") < 0.5, C("vv")))
    scenes = px.select("scene_id").distinct().withColumns({"scene_rows": F.lit(50).cast("bigint"), "scene_cols": F.lit(50).cast("bigint")})
    points = px.select("scene_id", (C("r") * 50 + C("c")).alias("point_id"), C("r").alias("pt_row"), C("c").alias("pt_col"))
    labels = px.select("scene_id", (C("r") * 50 + C("c")).alias("detect_id"), C("r").alias("detect_scene_row"), C("c").alias("detect_scene_column"), C("heat").alias("weight"))
    return SA.crops_with_signal(scenes, labels, points, px, "vv", 20, 12, 0.5, seed=9, most_missing=0.6, cell=16)


add("t9_retry_until_signal", _retry)


def _paste(fx):
    donors = fx.box.groupBy("box_no").agg(F.count("*").alias("n")).select(
        C("box_no").alias("donor_id"), (C("box_no") + 3).alias("donor_h"), (C("box_no") + 5).alias("donor_w"), (1.0 / C("n")).alias("weight")
    )
    return SA.paste_plan(fx.box.select("image_id").distinct(), fx.box, donors, 160, 160, seed=2)


add("t10_paste_plan", _paste)


def _samples(fx):
    scenes = fx.gt.select("scene_id").distinct().withColumn("folder", F.when(C("scene_id") > "s1", "train").otherwise("validation"))
    return SA.training_samples(_crops(fx), fx.gt, scenes, 512)


add(
    "t11_training_samples",
    lambda fx: _samples(fx).select("scene_id", "crop_id", "detect_id", "crop_row", "crop_col", "vessel_code", "fishing_code", "length_px", "sample_weight"),
    f"""SELECT k.scene_id, crop_id, detect_id, detect_scene_row-r0 AS crop_row, detect_scene_column-c0 AS crop_col,
 CASE WHEN detect_id IS NOT NULL THEN coalesce(CAST(is_vessel AS BIGINT),255) END AS vessel_code, CASE WHEN detect_id IS NOT NULL THEN coalesce(CAST(is_fishing AS BIGINT),255) END AS fishing_code,
 CASE WHEN detect_id IS NOT NULL THEN round(coalesce(vessel_length_m,0)/10,6) END AS length_px, CASE WHEN k.scene_id > 's1' THEN 0.25::DOUBLE ELSE 1 END AS sample_weight FROM ({CROPS_SQL}) k LEFT JOIN gt_fx g
 ON g.scene_id = k.scene_id AND detect_scene_row >= r0 AND detect_scene_row < r1 AND detect_scene_column >= c0 AND detect_scene_column < c1""",
)
add(
    "t11_sample_lists",
    lambda fx: SA.sample_lists(_samples(fx)).select("scene_id", "crop_id", F.size("objects").cast("bigint").alias("objects"), F.aggregate("objects", F.lit(0).cast("bigint"), lambda a, o: a + o["crop_row"]).alias("sum_row")),
    f"""SELECT k.scene_id, crop_id, count(detect_id) AS objects, CAST(coalesce(sum(detect_scene_row-r0),0) AS BIGINT) AS sum_row FROM ({CROPS_SQL}) k LEFT JOIN gt_fx g
 ON g.scene_id = k.scene_id AND detect_scene_row >= r0 AND detect_scene_row < r1 AND detect_scene_column >= c0 AND detect_scene_column < c1 GROUP BY 1, 2""",
)


def _round_trip(fx):
    """Objects drawn as targets and decoded again, at every stride, matched to themselves."""
    objects = fx.gt.select(
        "scene_id", "detect_id", C("detect_scene_column").alias("x"), C("detect_scene_row").alias("y"), "confidence",
        L.unknown_to_code(C("is_vessel")).alias("is_vessel"), L.unknown_to_code(C("is_fishing")).alias("is_fishing"), L.length_to_pixels(C("vessel_length_m")).alias("length_px"),
    )
    result = None
    for stride in (2, 4, 8, 16):
        maps = TG.encode_targets(objects, 1504, 1520, stride, fixed_radius=2)
        found = TG.detections(TG.decode_maps(maps, stride, 2048, floor=0.9), 0.9)
        place = C("detect_scene_row") * 100000 + C("detect_scene_column")
        found = found.withColumn("pred_id", place + F.expr("CAST(substr(scene_id, 2) AS BIGINT)") * 1000000000000)
        # written before they are matched: what drew and decoded them is done with
        found = cut_lineage(found.select("scene_id", "pred_id", *POINT), free=True)
        pairs = match(found, fx.gt)
        row = pairs.agg(F.count("*").alias("tp")).withColumn("stride", F.lit(stride))
        result = row if result is None else result.unionByName(row)
    return result


add("d3_round_trip", _round_trip)
