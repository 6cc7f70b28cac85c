"""Fixed schemas of the file formats the engine reads and writes."""

LABELS = (
    "detect_id BIGINT, scene_id STRING, detect_lat DOUBLE, detect_lon DOUBLE, "
    "detect_scene_row BIGINT, detect_scene_column BIGINT, top DOUBLE, `left` DOUBLE, bottom DOUBLE, `right` DOUBLE, "
    "is_vessel BOOLEAN, is_fishing BOOLEAN, vessel_length_m DOUBLE, confidence STRING, distance_from_shore_km DOUBLE"
)

DETECTIONS = (
    "vessel_length_m DOUBLE, detect_scene_row BIGINT, detect_scene_column BIGINT, scene_id STRING, "
    "objectness_p DOUBLE, is_vessel_p DOUBLE, is_fishing_p DOUBLE, objectness_threshold DOUBLE"
)

SCENE_SIZES = "scene_id STRING, rows INT, cols INT, split STRING"

SCENE_SPLIT = (
    "scene_id STRING, location STRING, official_split STRING, scenes_count_in_train BIGINT, "
    "scenes_count_in_valid BIGINT, scenes_count_in_test BIGINT, scenes_count_in_train_and_valid BIGINT, "
    "platform_instances BIGINT, vessel_instances BIGINT, fishing_instances BIGINT, unknown_vessel BIGINT, "
    "unknown_fishing BIGINT, recommended_split STRING, fold INT, average_platform_instances DOUBLE, "
    "average_vessel_instances DOUBLE, average_fishing_instances DOUBLE"
)

SHORELINE = "scene_id STRING, contour_id INT, seq INT, pt_row DOUBLE, pt_col DOUBLE"

TILES = "scene_id STRING, channel STRING, tile_row INT, tile_col INT, h INT, w INT, pixels ARRAY<FLOAT>"

MAPS = (
    "scene_id STRING, r BIGINT, c BIGINT, obj DOUBLE, vsl DOUBLE, fsh DOUBLE, len_log DOUBLE, "
    "off_x DOUBLE, off_y DOUBLE"
)
