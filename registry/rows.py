"""Filters, projections and scalar functions."""

from pyspark.sql import functions as F

from registry.core import PIXELS_SQL, add, normal_sql, pixels
from tidegrid.functions import boxes as B
from tidegrid.functions import geometry as G
from tidegrid.functions import labels as L
from tidegrid.functions import scalars as S
from tidegrid.operators import overlap as O
from tidegrid.operators import patches as PA
from tidegrid.operators import thresholds as T
from tidegrid.sources.rasters import tiles_from_pixels

C = F.col

add(
    "p1_apply_thresholds",
    lambda fx: T.apply_thresholds(fx.pred, 0.5, 0.338, 0.35).select("pred_id", "scene_id", "is_vessel", "is_fishing"),
    "SELECT pred_id, scene_id, is_vessel_p >= 0.338 AS is_vessel, is_fishing_p >= 0.35 AS is_fishing FROM pred_fx WHERE objectness_p >= 0.5",
)
add(
    "p2_coupled_thresholds",
    lambda fx: T.apply_coupled_thresholds(fx.pred, 0.55, 0.45, 0.4).select("pred_id", "is_vessel", "is_fishing"),
    "SELECT pred_id, is_vessel_p >= 0.45 OR is_fishing_p >= 0.4 AS is_vessel, is_vessel_p >= 0.45 AND is_fishing_p >= 0.4 AS is_fishing FROM pred_fx WHERE objectness_p >= 0.55",
)
add("p3_keep_confident", lambda fx: L.keep_confident(fx.gt), "SELECT * FROM gt_fx WHERE confidence IN ('HIGH','MEDIUM')")
add(
    "p4_blank_low",
    lambda fx: L.apply_low_policy(fx.gt, blank=True),
    """SELECT detect_id, scene_id, detect_scene_row, detect_scene_column, confidence,
 CASE WHEN confidence <> 'LOW' THEN is_vessel END AS is_vessel, CASE WHEN confidence <> 'LOW' THEN is_fishing END AS is_fishing,
 CASE WHEN confidence <> 'LOW' THEN vessel_length_m END AS vessel_length_m, distance_from_shore_km FROM gt_fx""",
)
add(
    "p5_drop_geometry",
    lambda fx: L.drop_geometry(
        fx.gt.withColumns({c: C("detect_scene_row") * 1.0 for c in L.GEO_AND_BOX_COLUMNS})
    ),
    "SELECT * FROM gt_fx",
)
add(
    "p6_score_floor",
    lambda fx: T.floor_scores(fx.pred, 0.3).select("pred_id", "objectness_p"),
    "SELECT pred_id, objectness_p FROM pred_fx WHERE objectness_p >= 0.3",
)
add(
    "p7_three_class",
    lambda fx: fx.gt.select("detect_id", L.three_class(C("is_vessel"), C("is_fishing")).alias("label")),
    """SELECT detect_id, CAST(CASE WHEN is_fishing THEN 2 WHEN is_fishing IS NOT NULL OR coalesce(is_vessel, false) THEN 1 ELSE 0 END AS BIGINT) AS label FROM gt_fx""",
)
add(
    "p8_decode_three_class",
    lambda fx: fx.gt.select("detect_id", L.three_class(C("is_vessel"), C("is_fishing")).alias("label")).select(
        "detect_id", L.three_class_vessel(C("label")).alias("vessel"), L.three_class_fishing(C("label")).alias("fishing")
    ),
    """SELECT detect_id, is_fishing IS NOT NULL OR coalesce(is_vessel, false) AS vessel, coalesce(is_fishing, false) AS fishing FROM gt_fx""",
)
add(
    "p9_four_class",
    lambda fx: fx.gt.select("detect_id", L.four_class(C("is_vessel"), C("is_fishing")).alias("kind")),
    """SELECT detect_id, CAST(CASE WHEN is_fishing IS NOT NULL THEN CASE WHEN is_fishing THEN 3 ELSE 2 END
 WHEN is_vessel IS NULL THEN 0 WHEN is_vessel THEN 2 ELSE 1 END AS BIGINT) AS kind FROM gt_fx""",
)
add(
    "p10_lengths",
    lambda fx: fx.gt.select("detect_id", L.length_to_pixels(C("vessel_length_m")).alias("px")).withColumn(
        "metres", L.length_to_metres(C("px"))
    ),
    "SELECT detect_id, round(coalesce(vessel_length_m, 0) / 10, 6) AS px, round(coalesce(vessel_length_m, 0), 6) AS metres FROM gt_fx",
)
add(
    "p11_near_shore_flags",
    lambda fx: fx.gt.select(
        "detect_id",
        L.near_shore_target(C("distance_from_shore_km")).alias("target_flag"),
        L.near_shore_balance(C("distance_from_shore_km")).alias("balance_flag"),
    ),
    "SELECT detect_id, distance_from_shore_km <= 2 AS target_flag, distance_from_shore_km < 2 AS balance_flag FROM gt_fx",
)
add(
    "p12_unknown_codes",
    lambda fx: fx.gt.select("detect_id", L.unknown_to_code(C("is_vessel")).alias("code")).withColumn(
        "back", L.code_to_unknown(C("code"))
    ),
    "SELECT detect_id, coalesce(CAST(is_vessel AS BIGINT), 255) AS code, CAST(is_vessel AS BIGINT) AS back FROM gt_fx",
)
add(
    "p13_folder_weight",
    lambda fx: fx.scn.select("scene_key", L.folder_weight(C("official_split")).alias("weight")),
    "SELECT scene_key, CAST(CASE official_split WHEN 'train' THEN 0.25 WHEN 'validation' THEN 1.0 WHEN 'test' THEN 0.1 END AS DOUBLE) AS weight FROM scn_fx",
)
add(
    "p14_captions",
    lambda fx: T.apply_thresholds(fx.pred, None, 0.338, 0.35).select(
        "pred_id",
        L.caption(C("is_vessel"), C("is_fishing"), C("is_vessel_p"), C("is_fishing_p"), C("objectness_p")).alias("title"),
        L.colour_class(C("is_vessel"), C("is_fishing")).alias("colour"),
    ),
    """SELECT pred_id, concat(' ', CASE WHEN is_vessel_p >= 0.338 THEN 'V' ELSE 'P' END, printf('%.2f', is_vessel_p),
 ' ', CASE WHEN is_fishing_p >= 0.35 THEN '/F' ELSE '' END, printf('%.2f', is_fishing_p), printf(' %.2f', objectness_p)) AS title,
 CASE WHEN is_vessel_p < 0.338 THEN 'pink' WHEN is_fishing_p >= 0.35 THEN 'orange' ELSE 'mint' END AS colour FROM pred_fx""",
)
add(
    "p15_missing_to_zero",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.null_to_zero(C("vv")).alias("vv")),
    f"SELECT scene_id, r, c, round(coalesce(vv, 0), 6) AS vv FROM ({PIXELS_SQL})",
)
add(
    "p16_skip_empty_tiles",
    lambda fx: PA.drop_empty(tiles_from_pixels(pixels(fx), 4, {"vv": F.when(C("heat") < 0.004, C("vv"))})).select(
        "scene_id", C("tile_row").cast("bigint").alias("r0"), C("tile_col").cast("bigint").alias("c0")
    ),
    f"""SELECT scene_id, CAST(floor(r/4) AS BIGINT)*4 AS r0, CAST(floor(c/4) AS BIGINT)*4 AS c0
 FROM (SELECT scene_id, r, c, CASE WHEN heat < 0.004 THEN coalesce(vv, 0) ELSE 0 END AS v FROM ({PIXELS_SQL})) GROUP BY 1,2,3 HAVING bool_or(v <> 0)""",
)
add(
    "p17_drop_blank_crops",
    lambda fx: PA.drop_blank(tiles_from_pixels(pixels(fx), 4, {"vv": F.when(C("heat") < 0.25, C("vv"))})).select(
        "scene_id", C("tile_row").cast("bigint").alias("r0"), C("tile_col").cast("bigint").alias("c0"), "missing"
    ),
    f"""SELECT scene_id, CAST(floor(r/4) AS BIGINT)*4 AS r0, CAST(floor(c/4) AS BIGINT)*4 AS c0,
 round(avg(CASE WHEN heat < 0.25 AND vv IS NOT NULL THEN 0.0 ELSE 1.0 END), 6) AS missing FROM ({PIXELS_SQL}) GROUP BY 1,2,3
 HAVING avg(CASE WHEN heat < 0.25 AND vv IS NOT NULL THEN 0.0 ELSE 1.0 END) <= 0.8""",
)
add(
    "p18_crop_to_scene",
    lambda fx: fx.pred.select("pred_id", (C("detect_scene_row") % 256).alias("in_row"), (C("detect_scene_column") % 256).alias("in_col"),
        (C("detect_scene_row") - C("detect_scene_row") % 256).alias("row0"), (C("detect_scene_column") - C("detect_scene_column") % 256).alias("col0"))
    .select("pred_id", (C("in_row") + C("row0")).alias("row"), (C("in_col") + C("col0")).alias("col")),
    "SELECT pred_id, detect_scene_row AS row, detect_scene_column AS col FROM pred_fx",
)
add(
    "p19_cap_lengths",
    lambda fx: fx.gt.select("detect_id", L.cap_length(C("vessel_length_m")).alias("capped")),
    "SELECT detect_id, CASE WHEN vessel_length_m > 500 THEN 500 ELSE vessel_length_m END AS capped FROM gt_fx",
)


def _box_columns(box, names=("a", "b", "c", "d")):
    return [v.cast("double").alias(n) for v, n in zip(box, names)]


def window():
    return B.Box(*[F.lit(v) for v in (8, 8, 56, 60)])


add(
    "p20_clamp_boxes",
    lambda fx: fx.box.select("image_id", "box_no", *_box_columns(B.clamp(B.box_of(), window()))),
    """SELECT image_id, box_no, CAST(least(greatest(x1,8),56) AS DOUBLE) AS a, CAST(least(greatest(y1,8),60) AS DOUBLE) AS b,
 CAST(least(greatest(x2,8),56) AS DOUBLE) AS c, CAST(least(greatest(y2,8),60) AS DOUBLE) AS d FROM box_fx""",
)
add(
    "p21_boxes_inside",
    lambda fx: fx.box.filter(B.inside(B.box_of(), window())),
    "SELECT * FROM box_fx WHERE x1 >= 8 AND y1 >= 8 AND x2 <= 56 AND y2 <= 60",
)
add(
    "p22_box_orders",
    lambda fx: fx.box.select(
        "image_id",
        "box_no",
        *_box_columns(B.to_centre(B.box_of())),
        *_box_columns(B.to_corners(B.to_centre(B.box_of())), ("e", "f", "g", "h")),
    ),
    """SELECT image_id, box_no, (x1+x2)/2.0::DOUBLE AS a, (y1+y2)/2.0::DOUBLE AS b, CAST(x2-x1 AS DOUBLE) AS c, CAST(y2-y1 AS DOUBLE) AS d,
 CAST(x1 AS DOUBLE) AS e, CAST(y1 AS DOUBLE) AS f, CAST(x2 AS DOUBLE) AS g, CAST(y2 AS DOUBLE) AS h FROM box_fx""",
)
add(
    "p23_box_area",
    lambda fx: fx.box.select("image_id", "box_no", B.area(B.box_of()).alias("area")),
    "SELECT image_id, box_no, (x2-x1)*(y2-y1) AS area FROM box_fx",
)
add(
    "p23b_scene_prefix",
    lambda fx: fx.gt.filter(C("scene_id").startswith("s1")).select("detect_id", "scene_id"),
    "SELECT detect_id, scene_id FROM gt_fx WHERE starts_with(scene_id, 's1')",
)
add(
    "p24_one_hot",
    lambda fx: fx.gt.select("detect_id", B.one_hot(L.three_class(C("is_vessel"), C("is_fishing")) - 1, 3).alias("h")).select(
        "detect_id", *[C("h")[i].alias(f"h{i}") for i in range(3)]
    ),
    """SELECT detect_id, CAST(k <= 0 AS BIGINT) AS h0, CAST(k = 1 AS BIGINT) AS h1, CAST(k = 2 AS BIGINT) AS h2 FROM
 (SELECT detect_id, CASE WHEN is_fishing THEN 1 WHEN is_fishing IS NOT NULL OR coalesce(is_vessel,false) THEN 0 ELSE -1 END AS k FROM gt_fx)""",
)

# --- scalar functions ---------------------------------------------------------

add(
    "f1_sigmoid_normalise",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.sigmoid_normalise(C("vv")).alias("x"), S.sigmoid_normalise(C("vv"), -5).alias("y")),
    f"SELECT scene_id, r, c, round(1/(1+exp(-(vv+20)*0.18)),6) AS x, round(1/(1+exp(-(vv+5)*0.18)),6) AS y FROM ({PIXELS_SQL})",
)
add(
    "f2_cube_root",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.cube_root_normalise(C("vv")).alias("x")),
    f"SELECT scene_id, r, c, round(cbrt(vv),6) AS x FROM ({PIXELS_SQL})",
)
add(
    "f3_linear_normalise",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.linear_normalise(C("vv"), 6.81594445, 1.62833557).alias("x"), S.linear_normalise(C("vv"), 0, 50).alias("y")),
    f"SELECT scene_id, r, c, round((vv-6.81594445::DOUBLE)/1.62833557::DOUBLE,6) AS x, round(vv/50,6) AS y FROM ({PIXELS_SQL})",
)
add(
    "f4_log_space",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.in_log_space(lambda v: v * 2.0)(C("heat")).alias("x")),
    "SELECT scene_id, px_row AS r, px_col AS c, round(log10(power(10, heat)*2),6) AS x FROM pix_fx",
)
add(
    "f5_brightness_contrast",
    lambda fx: pixels(fx).select(
        "scene_id", "r", "c", S.brightness_contrast(C("heat"), 1.1, 0.05).alias("x"), S.brightness_contrast(C("vv"), 0.9, -0.1, False).alias("y")
    ),
    f"SELECT scene_id, r, c, round(log10(power(10, heat)*1.1+0.05),6) AS x, round(vv*0.9-0.1,6) AS y FROM ({PIXELS_SQL})",
)
add(
    "f6_gauss_noise",
    lambda fx: pixels(fx).select(
        "scene_id", "r", "c", S.gauss_noise(C("vv"), 0.0, 0.5, F.lit(7), C("scene_id"), C("r"), C("c")).alias("x")
    ),
    f"SELECT scene_id, r, c, round(vv + sqrt(0.5::DOUBLE) * {normal_sql('7', 'scene_id', 'r', 'c')},6) AS x FROM ({PIXELS_SQL})",
)
add(
    "f7_geometric_moves",
    lambda fx: pixels(fx).select(
        "scene_id",
        "r",
        "c",
        *[v.alias(f"{m}_{n}") for m in ("fliplr", "flipud", "transpose", "rot90") for v, n in zip(G.move_pixel(m, C("r"), C("c"), F.lit(50), F.lit(50)), "rc")],
        *[v.alias(f"k_{n}") for v, n in zip(G.move_keypoint("fliplr", C("c"), C("r"), F.lit(50), F.lit(50)), "xy")],
    ),
    f"""SELECT scene_id, r, c, r AS fliplr_r, 49-c AS fliplr_c, 49-r AS flipud_r, c AS flipud_c, c AS transpose_r, r AS transpose_c,
 49-c AS rot90_r, r AS rot90_c, 49-c AS k_x, r AS k_y FROM ({PIXELS_SQL})""",
)


def _permutation(spark):
    """3x3 tiles of 512 pixels moved one place on."""
    ids = spark.range(9).select(F.floor(C("id") / 3).alias("old_tr"), (C("id") % 3).alias("old_tc"), ((C("id") + 1) % 9).alias("n"))
    return ids.select("old_tr", "old_tc", F.floor(C("n") / 3).alias("new_tr"), (C("n") % 3).alias("new_tc"))


add(
    "f8_grid_shuffle",
    lambda fx: G.shuffle_tiles(
        fx.gt.select("detect_id", C("detect_scene_column").alias("x"), C("detect_scene_row").alias("y")), _permutation(fx.spark), 512, 512
    ),
    """SELECT detect_id, CAST(x % 512 + ((t+1)%9%3)*512 AS BIGINT) AS x, CAST(y % 512 + ((t+1)%9//3)*512 AS BIGINT) AS y FROM
 (SELECT detect_id, detect_scene_column AS x, detect_scene_row AS y, (detect_scene_row//512)*3 + detect_scene_column//512 AS t FROM gt_fx)""",
)
add(
    "f9_gaussian",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.gaussian_value(C("r") - 25, C("c") - 25, F.lit(2.5)).alias("g")),
    f"""SELECT scene_id, r, c, round(CASE WHEN g < 2.220446049250313e-16 THEN 0 ELSE g END, 6) AS g FROM
 (SELECT scene_id, r, c, exp(-((r-25)*(r-25)+(c-25)*(c-25))/12.5::DOUBLE) AS g FROM ({PIXELS_SQL}))""",
)
add(
    "f10_disk_and_point",
    lambda fx: pixels(fx).select(
        "scene_id", "r", "c", S.disk_value(C("r") - 25, C("c") - 25, F.lit(6), C("heat")).alias("d"), S.point_value(C("r") - 25, C("c") - 25).alias("p")
    ),
    f"""SELECT scene_id, r, c, round(CASE WHEN (r-25)*(r-25)+(c-25)*(c-25) <= 36 THEN heat ELSE 0 END, 6) AS d,
 CAST(CASE WHEN greatest(abs(r-25),abs(c-25)) > 1 THEN 0 WHEN abs(r-25)+abs(c-25) = 0 THEN 1.0 WHEN abs(r-25)+abs(c-25) = 1 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS p FROM ({PIXELS_SQL})""",
)
add(
    "f11_gaussian_radius",
    lambda fx: fx.box.select("image_id", "box_no", S.gaussian_radius(C("y2") - C("y1"), C("x2") - C("x1")).alias("radius")),
    """SELECT image_id, box_no, CAST(greatest(1, ceil(least((s+sqrt(s*s-4*(a*0.3/1.7)))/2, (2*s+sqrt(4*s*s-16*(0.3*a)))/2,
 (-1.4*s+sqrt(1.96*s*s+4*2.8*0.3*a))/2))) AS BIGINT) AS radius FROM
 (SELECT image_id, box_no, CAST(x2-x1+y2-y1 AS DOUBLE) AS s, CAST((x2-x1)*(y2-y1) AS DOUBLE) AS a FROM box_fx)""",
)
add(
    "f12_bisector_radius",
    lambda fx: fx.box.select("image_id", "box_no", S.aspect_angle((C("x2") - C("x1")).cast("double"), (C("y2") - C("y1")).cast("double")).alias("phi"),
        S.bisector_radius((C("x2") - C("x1")).cast("double"), (C("y2") - C("y1")).cast("double")).alias("radius")),
    """SELECT image_id, box_no, round(phi, 6) AS phi, CAST(greatest(1, ceil(-(b+sqrt(b*b-4*a*(w*h/3)))/(2*a))) AS BIGINT) AS radius FROM
 (SELECT *, sin(radians(phi))*cos(radians(phi)) AS a, -(w*sin(radians(phi))+h*cos(radians(phi))) AS b FROM
 (SELECT image_id, box_no, CAST(x2-x1 AS DOUBLE) AS w, CAST(y2-y1 AS DOUBLE) AS h,
 CASE WHEN x2-x1 > y2-y1 THEN 90-45.0*(y2-y1)/CAST(x2-x1 AS DOUBLE) ELSE 45.0*(x2-x1)/CAST(y2-y1 AS DOUBLE) END AS phi FROM box_fx))""",
)


def _oval(fx):
    sizes = fx.box.select((C("x2") - C("x1")).alias("w"), (C("y2") - C("y1")).alias("h")).groupBy("w", "h").agg(F.count("*").alias("n"))
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), C("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), C("w") - 1)))
    grid = grid.withColumn("v", S.oval_gaussian_value(C("x"), C("y"), C("w"), C("h"), 0.5))
    return grid.groupBy("w", "h", "n").agg(F.sum("v").alias("mass"), F.count_if(C("v") > 0).alias("area"))


add(
    "f13_oval_gaussian",
    _oval,
    """WITH z AS (SELECT x2-x1 AS w, y2-y1 AS h, count(*) AS n FROM box_fx GROUP BY 1,2),
 g AS (SELECT w, h, n, exp(-((x-w//2)*(x-w//2)/(2*power(w/12.0::DOUBLE,2)) + (y-h//2)*(y-h//2)/(2*power(h/12.0::DOUBLE,2)))) AS v
 FROM z, range(0, 200) a(x), range(0, 200) b(y) WHERE x < w AND y < h)
 SELECT w, h, n, round(sum(CASE WHEN v < 1.1920928955078125e-07 THEN 0 ELSE v END), 6) AS mass, count(*) FILTER (v >= 1.1920928955078125e-07) AS area FROM g GROUP BY 1,2,3""",
)
add(
    "f14_mesh",
    lambda fx: fx.scn.withColumn("y", F.explode(F.sequence(F.lit(0), C("scene_rows") % 7))).withColumn("x", F.explode(F.sequence(F.lit(0), C("scene_cols") % 5))).select(
        "scene_id", (C("y") * (C("scene_cols") % 5 + 1) + C("x")).alias("i"), "x", "y"
    ),
    """SELECT scene_id, y*(scene_cols%5+1)+x AS i, x, y FROM scn_fx, range(0,7) a(y), range(0,5) b(x) WHERE y <= scene_rows%7 AND x <= scene_cols%5""",
)
add(
    "f15_entropy",
    lambda fx: fx.pred.select(
        "pred_id",
        S.binary_entropy(C("objectness_p") * 8 - 4).alias("binary_h"),
        S.class_entropy(F.array("objectness_p", "is_vessel_p", "is_fishing_p")).alias("class_h"),
    ),
    """SELECT pred_id, round(-(p*ln(p)+(1-p)*ln(1-p)),6) AS binary_h, round(-(a/z*ln(a/z)+b/z*ln(b/z)+c/z*ln(c/z)),6) AS class_h FROM
 (SELECT *, a+b+c AS z FROM (SELECT pred_id, 1/(1+exp(-(objectness_p*8-4))) AS p, exp(objectness_p) AS a, exp(is_vessel_p) AS b, exp(is_fishing_p) AS c FROM pred_fx))""",
)
add(
    "f16_range_rescale",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.range_rescale(C("vv"), F.lit(-60.0), F.lit(40.0)).alias("x")),
    f"SELECT scene_id, r, c, round(coalesce((vv+60)/100*255, 0),6) AS x FROM ({PIXELS_SQL})",
)
add(
    "f17_band_math",
    lambda fx: pixels(fx).select("scene_id", "r", "c", S.band_difference(C("vv"), C("heat")).alias("d"), S.band_mean(C("vv"), C("heat")).alias("m")),
    f"SELECT scene_id, r, c, round(vv-heat,6) AS d, round((vv+heat)/2,6) AS m FROM ({PIXELS_SQL})",
)
add(
    "a45_median_box_size",
    lambda fx: O.median_box_size(fx.box),
    "SELECT image_id, round(median(sqrt((x2-x1)*(y2-y1))),6) AS median_size FROM box_fx GROUP BY image_id",
)
