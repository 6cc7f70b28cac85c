"""Sources and sinks: each query writes its format to the shared folder and reads it back."""

from pyspark.sql import functions as F

from registry.core import PIXELS_SQL, add, pixels
from tidegrid.session import new_folder
from tidegrid.sources import rasters as R
from tidegrid.sources import sinks as K
from tidegrid.sources import tables as S

C = F.col


def _csv(fx, df, name):
    path = new_folder(fx.spark, name)
    df.write.option("header", True).csv(path)
    return path


def _labels(fx):
    empty = F.lit(None).cast("double")
    wide = fx.gt.select(
        "detect_id", "scene_id", empty.alias("detect_lat"), empty.alias("detect_lon"), "detect_scene_row", "detect_scene_column",
        empty.alias("top"), empty.alias("left"), empty.alias("bottom"), empty.alias("right"),
        "is_vessel", "is_fishing", "vessel_length_m", "confidence", "distance_from_shore_km",
    )
    labels = S.read_labels(fx.spark, _csv(fx, wide, "labels"), "train")
    return labels.drop("detect_lat", "detect_lon", "top", "left", "bottom", "right")


add("s1_read_labels", _labels, "SELECT *, 'train' AS folder FROM gt_fx")
add(
    "s2_read_scene_sizes",
    lambda fx: fx.gt.select("detect_id", "scene_id").join(
        S.read_scene_sizes(
            fx.spark, _csv(fx, fx.scn.select("scene_id", C("scene_rows").alias("rows"), C("scene_cols").alias("cols"), C("official_split").alias("split")), "sizes")
        ),
        "scene_id",
    ),
    "SELECT detect_id, g.scene_id, scene_rows AS rows, scene_cols AS cols, official_split AS split FROM gt_fx g JOIN scn_fx s ON g.scene_id = s.scene_id",
)


def _split(fx):
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    counts = ("scenes_count_in_train", "scenes_count_in_valid", "scenes_count_in_test", "scenes_count_in_train_and_valid",
              "platform_instances", "vessel_instances", "fishing_instances", "unknown_vessel", "unknown_fishing")
    wide = fx.scn.select(
        "scene_id", "location", "official_split", *[zero.alias(n) for n in counts], C("official_split").alias("recommended_split"), "fold",
        none.alias("average_platform_instances"), none.alias("average_vessel_instances"), none.alias("average_fishing_instances"),
    )
    return S.read_scene_split(fx.spark, _csv(fx, wide, "split")).select("scene_id", "location", "official_split", "recommended_split", "fold")


add("s3_read_scene_split", _split, "SELECT scene_id, location, official_split, official_split AS recommended_split, fold FROM scn_fx")
DETECTIONS_SQL = """SELECT vessel_length_m, detect_scene_row, detect_scene_column, scene_id, objectness_p, is_vessel_p, is_fishing_p,
 CAST(0.3 AS DOUBLE) AS objectness_threshold FROM pred_fx"""
_COLUMNS = ("vessel_length_m", "detect_scene_row", "detect_scene_column", "scene_id", "objectness_p", "is_vessel_p", "is_fishing_p")


def _detections(fx):
    return fx.pred.select(*_COLUMNS, F.lit(0.3).alias("objectness_threshold"))


add("s4_read_detections", lambda fx: S.read_detections(fx.spark, _csv(fx, _detections(fx), "detections")), DETECTIONS_SQL)


def _shoreline(fx):
    """Two point sources; the first knows every third scene, one of them as empty."""
    number = F.expr("CAST(substr(scene_id, 2) AS BIGINT)")
    points = fx.shore.select("scene_id", "point_id", "pt_row", "pt_col")
    first = points.filter(number % 3 == 0)
    first = first.withColumns({c: F.when(number % 2 == 0, C(c)) for c in ("pt_row", "pt_col")})
    second = points.withColumn("pt_row", C("pt_row") + 5000)
    return S.resolve_shoreline(points, [first, second])


add(
    "s5_resolve_shoreline",
    _shoreline,
    """SELECT scene_id, point_id, pt_row + CASE WHEN n % 3 = 0 THEN 0 ELSE 5000 END AS pt_row, pt_col FROM
 (SELECT *, CAST(substr(scene_id, 2) AS BIGINT) AS n FROM shore_fx) WHERE NOT (n % 3 = 0 AND n % 2 <> 0)""",
)
TILE = 16


def _tiles(fx, **channels):
    return R.tiles_from_pixels(fx.pix.select("scene_id", C("px_row").alias("r"), C("px_col").alias("c"), "vv_db", "heat"), TILE, channels)


def _window(fx):
    path = new_folder(fx.spark, "tiles")
    R.write_tiles(_tiles(fx, vv=C("vv_db"), vh=C("heat")), path)
    return R.pixels_of(R.window(R.read_tiles(fx.spark, path), TILE, 7, 41, 3, 38))


add(
    "s6_read_window",
    _window,
    """SELECT scene_id, 'vv' AS channel, px_row AS r, px_col AS c, round(vv_db, 6) AS v FROM pix_fx WHERE px_row >= 7 AND px_row < 41 AND px_col >= 3 AND px_col < 38
 UNION ALL SELECT scene_id, 'vh', px_row, px_col, round(heat, 6) FROM pix_fx WHERE px_row >= 7 AND px_row < 41 AND px_col >= 3 AND px_col < 38""",
)


def _aligned(fx):
    return R.align_channels(_tiles(fx, vv=C("vv_db"), vh=C("heat")), ["vv", "vh"])


def _place(df):
    return df.withColumns({"r": C("tile_row") + F.floor(C("i") / C("w")), "c": C("tile_col") + C("i") % C("w")})


add(
    "s7_align_channels",
    lambda fx: _place(_aligned(fx).select("scene_id", "tile_row", "tile_col", "w", F.posexplode(F.arrays_zip("vv", "vh")).alias("i", "z"))).select(
        "scene_id", "r", "c", C("z.vv").alias("vv"), C("z.vh").alias("vh")
    ),
    f"SELECT scene_id, r, c, round(vv, 6) AS vv, round(heat, 6) AS vh FROM ({PIXELS_SQL})",
)
add(
    "s8_stack_channels",
    lambda fx: _place(
        R.stack_channels(_aligned(fx), ["vh", "vv", "vh"]).select("scene_id", "tile_row", "tile_col", "w", F.posexplode("stacked").alias("i", "z"))
    ).select("scene_id", "r", "c", *[C("z")[i].alias(f"ch{i}") for i in range(3)]),
    f"SELECT scene_id, r, c, round(heat, 6) AS ch0, round(vv, 6) AS ch1, round(heat, 6) AS ch2 FROM ({PIXELS_SQL})",
)
add(
    "s9_test_scene_paths",
    lambda fx: S.scene_paths(fx.scn, "data/full", "test").select("scene_id", "scene_path"),
    "SELECT scene_id, concat('data/full/test/', scene_id) AS scene_path FROM scn_fx WHERE official_split = 'test'",
)
add(
    "s10_parse_paths",
    lambda fx: S.parse_split_names(
        S.parse_paths(S.scene_paths(fx.scn, "data/full"), "scene_path").withColumn("name", F.concat_ws("_", "official_split", F.concat("scene_id", F.lit(".png")))),
        "name",
    ).select("scene_id", "scene_of_path", "folder_of_path", "split_of_name", "scene_of_name"),
    "SELECT scene_id, scene_id AS scene_of_path, official_split AS folder_of_path, official_split AS split_of_name, scene_id AS scene_of_name FROM scn_fx",
)


def _per_scene(fx):
    path = new_folder(fx.spark, "per-scene")
    K.write_per_scene(_detections(fx), path)
    return K.read_per_scene(fx.spark, path)


add("s11_write_per_scene", _per_scene, DETECTIONS_SQL)


def _summary(fx):
    path = new_folder(fx.spark, "summary")
    K.write_summary(fx.pred.groupBy("scene_id").agg(F.count("*").alias("n"), F.avg("objectness_p").alias("mean_p")), path)
    return fx.spark.read.parquet(path)


add("s12_write_summary", _summary, "SELECT scene_id, count(*) AS n, round(avg(objectness_p), 6) AS mean_p FROM pred_fx GROUP BY scene_id")
TRIPLES = ((0.3, 0.338, 0.35), (0.5, 0.4, 0.4), (0.55, 0.45, 0.4))


def _threshold_tables(fx):
    path = new_folder(fx.spark, "thresholds")
    K.write_threshold_tables(fx.pred.withColumn("objectness_threshold", F.lit(0.3)), TRIPLES, path)
    schema = ("pred_id BIGINT, scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT, vessel_length_m DOUBLE, "
              "is_vessel BOOLEAN, is_fishing BOOLEAN, obj_t DOUBLE, vsl_t DOUBLE, fsh_t DOUBLE")
    return fx.spark.read.schema(schema).option("header", True).csv(path)


add(
    "s13_threshold_tables",
    _threshold_tables,
    """SELECT pred_id, scene_id, detect_scene_row, detect_scene_column, vessel_length_m, is_vessel_p >= v AS is_vessel, is_fishing_p >= f AS is_fishing,
 o AS obj_t, v AS vsl_t, f AS fsh_t FROM pred_fx, (VALUES (0.3::DOUBLE, 0.338::DOUBLE, 0.35::DOUBLE), (0.5, 0.4, 0.4), (0.55, 0.45, 0.4)) t(o, v, f) WHERE objectness_p >= o""",
)


def _maps(fx):
    path = new_folder(fx.spark, "maps")
    m = pixels(fx).select("scene_id", "r", "c", C("heat").alias("obj"), (1 - C("heat")).alias("vsl"), C("vv").alias("fsh"),
                          F.lit(0.0).alias("len_log"), F.lit(0.5).alias("off_x"), F.lit(0.25).alias("off_y"))
    K.write_maps(m, path)
    return K.read_maps(fx.spark, path)


add(
    "s14_save_maps",
    _maps,
    f"""SELECT scene_id, r, c, heat AS obj, round(1-heat, 6) AS vsl, round(vv, 6) AS fsh, CAST(0 AS DOUBLE) AS len_log, CAST(0.5 AS DOUBLE) AS off_x, CAST(0.25 AS DOUBLE) AS off_y FROM ({PIXELS_SQL})""",
)
add(
    "s15_pending_scenes",
    lambda fx: K.pending_scenes(fx.scn.select("scene_id", "location"), fx.pred.select("scene_id").distinct()),
    "SELECT scene_id, location FROM scn_fx WHERE scene_id NOT IN (SELECT scene_id FROM pred_fx)",
)


def _coarse(fx, *values):
    return pixels(fx).select("scene_id", C("r").alias("ar"), C("c").alias("ac"), *values)


def _fine(fx):
    return fx.gt.select("detect_id", "scene_id", C("detect_scene_row").alias("r"), C("detect_scene_column").alias("c"))


add(
    "s16_upsample",
    lambda fx: R.upsample_bilinear(
        R.upsample_nearest(_fine(fx), _coarse(fx, C("heat").alias("nearest")), 50, ["nearest"]), _coarse(fx, C("vv").alias("bilinear")), 50, ["bilinear"]
    ).select("detect_id", "nearest", "bilinear"),
    f"""WITH px AS ({PIXELS_SQL}), f AS (SELECT detect_id, scene_id, detect_scene_row AS r, detect_scene_column AS c, detect_scene_row//50 AS ar, detect_scene_column//50 AS ac FROM gt_fx),
 w AS (SELECT f.detect_id, abs(1-dr-(f.r/50.0::DOUBLE-ar))*abs(1-dc-(f.c/50.0::DOUBLE-ac)) AS w, vv, CASE WHEN dr = 0 AND dc = 0 THEN heat END AS h FROM f CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) d(dr, dc)
 LEFT JOIN px ON px.scene_id = f.scene_id AND px.r = ar+dr AND px.c = ac+dc)
 SELECT detect_id, max(h) AS nearest, round(CASE WHEN sum(w) FILTER (vv IS NOT NULL) <> 0 THEN sum(w*vv)/sum(w) FILTER (vv IS NOT NULL) END, 6) AS bilinear FROM w GROUP BY detect_id""",
)


def _surface(fx):
    code = F.floor(C("heat") * 1000).cast("bigint") % 7
    layers = pixels(fx).select("scene_id", C("r").alias("ar"), C("c").alias("ac"), *[v.alias(n) for n, v in R.surface_classes(code).items()])
    return R.upsample_nearest(_fine(fx), layers, 50, ["water", "land", "ice"]).select("detect_id", "water", "land", "ice")


add(
    "s17_surface_classes",
    _surface,
    """SELECT detect_id, CAST(k = 0 AS DOUBLE) AS water, CAST(k IN (1,5) AS DOUBLE) AS land, CAST(k IN (2,6) AS DOUBLE) AS ice FROM gt_fx g LEFT JOIN
 (SELECT scene_id, px_row, px_col, CAST(floor(heat*1000) AS BIGINT) % 7 AS k FROM pix_fx) p ON p.scene_id = g.scene_id AND p.px_row = detect_scene_row//50 AND p.px_col = detect_scene_column//50""",
)
