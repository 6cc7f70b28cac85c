"""Profiles, histograms, weights and folds."""

from pyspark.sql import functions as F

from registry.core import PIXELS_SQL, add, pixels
from registry.joins import _PLACES_SQL, places
from tidegrid.functions import labels as L
from tidegrid.operators import folds as FO
from tidegrid.operators import profile as P
from tidegrid.operators import weights as W
from tidegrid.sources import rasters as R

C = F.col


def _scored(fx):
    """Labels with the scores of the detection derived from the same row."""
    return fx.gt.join(fx.pred.select(C("pred_id").alias("detect_id"), "is_vessel_p", "is_fishing_p", C("vessel_length_m").alias("p_length")), "detect_id")


SCORED_SQL = "SELECT g.*, is_vessel_p, is_fishing_p, p.vessel_length_m AS p_length FROM gt_fx g JOIN pred_fx p ON p.pred_id = g.detect_id"

add(
    "a14_raster_stats",
    lambda fx: P.raster_stats(pixels(fx), ["vv", "heat"]),
    f"""SELECT scene_id, max(r)+1 AS rows, max(c)+1 AS cols, round(min(vv),6) AS vv_min, round(max(vv),6) AS vv_max, round(avg(vv),6) AS vv_mean, round(stddev_pop(vv),6) AS vv_std,
 min(heat) AS heat_min, max(heat) AS heat_max, round(avg(heat),6) AS heat_mean, round(stddev_pop(heat),6) AS heat_std FROM ({PIXELS_SQL}) GROUP BY scene_id""",
)
add(
    "a14_tile_stats",
    lambda fx: P.tile_stats(
        R.tiles_from_pixels(fx.pix.select("scene_id", C("px_row").alias("r"), C("px_col").alias("c"), "vv_db", "heat"), 16, {"vv": C("vv_db"), "vh": C("heat")})
        .withColumn("pixels", R.clean_pixels(C("pixels")))
    ),
    f"""SELECT scene_id, 'vv' AS channel, max(r)+1 AS rows, max(c)+1 AS cols, round(min(vv),6) AS min, round(max(vv),6) AS max, round(avg(vv),6) AS mean, round(stddev_pop(vv),6) AS std FROM ({PIXELS_SQL}) GROUP BY 1
 UNION ALL SELECT scene_id, 'vh', max(r)+1, max(c)+1, min(heat), max(heat), round(avg(heat),6), round(stddev_pop(heat),6) FROM ({PIXELS_SQL}) GROUP BY 1""",
)


def _sizes(fx):
    a = pixels(fx).groupBy("scene_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    b = pixels(fx).filter("vv IS NOT NULL").groupBy("scene_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    return P.size_mismatches(a.unionByName(b))


add(
    "a14_size_mismatches",
    _sizes,
    f"""SELECT scene_id FROM (SELECT scene_id, max(r) AS a, max(c) AS b, max(r) FILTER (vv IS NOT NULL) AS d, max(c) FILTER (vv IS NOT NULL) AS e FROM ({PIXELS_SQL}) GROUP BY 1) WHERE a <> d OR b <> e""",
)
add(
    "a15_channel_stats",
    lambda fx: P.tile_channel_stats(R.tiles_from_pixels(pixels(fx), 16, {"vv": C("vv"), "vh": C("heat")})),
    f"""SELECT 'vv' AS channel, round(avg(vv),6) AS mean, round(stddev_pop(vv),6) AS std FROM ({PIXELS_SQL}) UNION ALL SELECT 'vh', round(avg(heat),6), round(stddev_pop(heat),6) FROM ({PIXELS_SQL})""",
)
COUNTS_SQL = """SELECT location, count(*) FILTER (official_split='train') AS scenes_count_in_train, count(*) FILTER (official_split='validation') AS scenes_count_in_valid,
 count(*) FILTER (official_split='test') AS scenes_count_in_test, count(*) FILTER (official_split IN ('train','validation')) AS scenes_count_in_train_and_valid FROM scn_fx GROUP BY location"""
add(
    "a16_location_counts",
    lambda fx: P.attach_location_counts(fx.scn.select("scene_key", "location", "official_split")),
    f"SELECT scene_key, official_split, k.* FROM scn_fx s JOIN ({COUNTS_SQL}) k ON k.location = s.location",
)
LABELS_SQL = """SELECT scene_id, count(*) FILTER (NOT is_vessel) AS platform_instances, count(*) FILTER (is_vessel) AS vessel_instances, count(*) FILTER (is_fishing) AS fishing_instances,
 count(*) FILTER (is_vessel IS NULL) AS unknown_vessel, count(*) FILTER (is_vessel IS NOT NULL AND is_fishing IS NULL) AS unknown_fishing FROM gt_fx GROUP BY scene_id"""
add("a17_labels_per_scene", lambda fx: P.labels_per_scene(fx.gt), LABELS_SQL)
add(
    "a18_recommend_split",
    lambda fx: P.recommend_split(P.attach_location_counts(fx.scn.select("scene_key", "official_split", F.concat_ws("-", "location", (C("scene_key") % 29).cast("string")).alias("location")))).select(
        "scene_key", "recommended_split"
    ),
    """WITH s AS (SELECT scene_key, official_split, concat(location, '-', CAST(scene_key % 29 AS STRING)) AS location FROM scn_fx),
 k AS (SELECT location, count(*) FILTER (official_split='train') AS a, count(*) FILTER (official_split='validation') AS b, count(*) FILTER (official_split='test') AS c FROM s GROUP BY 1)
 SELECT scene_key, CASE WHEN (b = 1 AND official_split = 'validation') OR (a = 1 AND b = 0 AND c = 0 AND official_split = 'train') THEN 'holdout' ELSE official_split END AS recommended_split
 FROM s JOIN k ON k.location = s.location""",
)
add(
    "a19_location_averages",
    lambda fx: P.location_averages(P.labels_per_scene(fx.gt).join(places(fx), "scene_id")).select(
        "scene_id", "location", *[f"average_{n}_instances" for n in ("platform", "vessel", "fishing")]
    ),
    f"""SELECT scene_id, location, round(avg(platform_instances) OVER w,6) AS average_platform_instances, round(avg(vessel_instances) OVER w,6) AS average_vessel_instances,
 round(avg(fishing_instances) OVER w,6) AS average_fishing_instances FROM ({LABELS_SQL}) a JOIN ({_PLACES_SQL}) p USING (scene_id) WINDOW w AS (PARTITION BY location)""",
)
add(
    "a20_class_balance",
    lambda fx: P.class_balance(fx.gt.join(fx.scn.select("scene_id", "official_split"), "scene_id"), "official_split"),
    """SELECT official_split, count(*) FILTER (NOT is_vessel) AS non_vessel, count(*) FILTER (is_vessel) AS vessel, count(*) FILTER (NOT is_fishing) AS non_fishing, count(*) FILTER (is_fishing) AS fishing,
 count(*) FILTER (distance_from_shore_km >= 2) AS offshore, count(*) FILTER (distance_from_shore_km < 2) AS near_shore, count(*) FILTER (distance_from_shore_km < 2 AND is_vessel) AS near_shore_vessel,
 count(*) FILTER (distance_from_shore_km < 2 AND is_fishing) AS near_shore_fishing FROM gt_fx g JOIN scn_fx s ON g.scene_id = s.scene_id GROUP BY 1""",
)
add(
    "a21_value_counts",
    lambda fx: P.value_counts(FO.attach_split(fx.gt, fx.scn), "fold"),
    """SELECT fold, field, value, count(*) AS n FROM (SELECT fold, unnest(['confidence','near_shore','is_vessel','is_fishing']) AS field,
 unnest([confidence, CAST(distance_from_shore_km <= 2 AS STRING), CAST(is_vessel AS STRING), CAST(is_fishing AS STRING)]) AS value FROM gt_fx g JOIN scn_fx s ON g.scene_id = s.scene_id) GROUP BY 1,2,3""",
)
add(
    "a22_objects_per_scene",
    lambda fx: P.objects_per_scene_stats(fx.gt),
    "SELECT min(n) AS n_min, round(avg(n),6) AS n_mean, round(stddev_pop(n),6) AS n_std, max(n) AS n_max FROM (SELECT count(*) AS n FROM gt_fx GROUP BY scene_id)",
)


def _lengths(fx):
    known = fx.gt.filter("vessel_length_m > 0")
    plain = P.histogram(known, C("vessel_length_m"), 256).withColumn("scale", F.lit("metres"))
    return plain.unionByName(P.histogram(known, F.log("vessel_length_m"), 256).withColumn("scale", F.lit("log")))


add(
    "a23_length_histogram",
    _lengths,
    """WITH v AS (SELECT vessel_length_m AS x, 'metres' AS scale FROM gt_fx WHERE vessel_length_m > 0 UNION ALL SELECT ln(vessel_length_m), 'log' FROM gt_fx WHERE vessel_length_m > 0),
 e AS (SELECT scale, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1)
 SELECT v.scale, CAST(least(floor((x-lo)/(hi-lo)*256), 255) AS BIGINT) AS bin, count(*) AS n FROM v JOIN e ON e.scale = v.scale GROUP BY 1,2""",
)
add(
    "a24_score_histogram",
    lambda fx: P.fixed_histogram(_scored(fx).filter("is_vessel IS NOT NULL"), C("is_vessel_p"), 0.0, 1.0, 64, ["is_vessel"]),
    f"SELECT is_vessel, CAST(least(floor(is_vessel_p/0.015625), 63) AS BIGINT) AS bin, count(*) AS n FROM ({SCORED_SQL}) WHERE is_vessel IS NOT NULL GROUP BY 1,2",
)


def _auc_sql(score, label):
    return f"""(SELECT sum(CASE WHEN y THEN below + 0.5*same END) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) FROM
 (SELECT {label} AS y, coalesce(sum(CASE WHEN {label} THEN 0 ELSE 1 END) OVER (ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
  - sum(CASE WHEN {label} THEN 0 ELSE 1 END) OVER (PARTITION BY s) AS below, sum(CASE WHEN {label} THEN 0 ELSE 1 END) OVER (PARTITION BY s) AS same
  FROM (SELECT {label}, CASE WHEN detect_id % 11 = 0 THEN 0.5 ELSE {score} END AS s FROM sc WHERE {label} IS NOT NULL)))"""


def _aucs(fx):
    scored = _scored(fx).withColumns({n: F.when(C("detect_id") % 11 != 0, C(n)) for n in ("is_vessel_p", "is_fishing_p")})
    v = P.auc(scored, C("is_vessel_p"), C("is_vessel"), "value").withColumn("name", F.lit("vessel"))
    return v.unionByName(P.auc(scored, C("is_fishing_p"), C("is_fishing"), "value").withColumn("name", F.lit("fishing")))


add(
    "a25_roc_auc",
    _aucs,
    f"""WITH sc AS ({SCORED_SQL}) SELECT 'fishing' AS name, round(CAST({_auc_sql('is_fishing_p', 'is_fishing')} AS DOUBLE), 6) AS value
 UNION ALL SELECT 'vessel', round(CAST({_auc_sql('is_vessel_p', 'is_vessel')} AS DOUBLE), 6)""",
)
add(
    "a26_plain_length_score",
    lambda fx: P.plain_length_score(_scored(fx).withColumn("p_length", C("vessel_length_m") + (C("detect_id") % 9)), C("p_length"), C("vessel_length_m"), "length_score"),
    f"SELECT round(1-least(1, avg(abs((vessel_length_m+detect_id%9)-vessel_length_m)/vessel_length_m)),6) AS length_score FROM ({SCORED_SQL})",
)
add(
    "a44_distinct_counts",
    lambda fx: fx.gt.join(places(fx), "scene_id").agg(
        F.count_distinct("scene_id").alias("scenes"), F.count_distinct("location").alias("locations"), F.count_distinct(L.four_class(C("is_vessel"), C("is_fishing"))).alias("kinds")
    ),
    f"""SELECT count(DISTINCT g.scene_id) AS scenes, count(DISTINCT location) AS locations,
 count(DISTINCT CASE WHEN is_fishing IS NOT NULL THEN CASE WHEN is_fishing THEN 3 ELSE 2 END WHEN is_vessel IS NULL THEN 0 WHEN is_vessel THEN 2 ELSE 1 END) AS kinds
 FROM gt_fx g JOIN ({_PLACES_SQL}) p ON p.scene_id = g.scene_id""",
)

# --- weights -------------------------------------------------------------------
FOUR = "CASE WHEN is_fishing IS NOT NULL THEN CASE WHEN is_fishing THEN 3 ELSE 2 END WHEN is_vessel IS NULL THEN 0 WHEN is_vessel THEN 2 ELSE 1 END"
add(
    "a27_balanced_weight",
    lambda fx: W.balanced_weight(fx.gt.select("detect_id", "confidence"), "confidence", "weight").select("detect_id", "weight"),
    """SELECT detect_id, round(count(*) OVER () / CAST((SELECT count(DISTINCT confidence) FROM gt_fx) * count(*) OVER (PARTITION BY confidence) AS DOUBLE), 6) AS weight FROM gt_fx""",
)
add(
    "a28_known_balanced_weight",
    lambda fx: W.known_balanced_weight(fx.gt.select("detect_id", L.unknown_to_code(C("is_fishing")).alias("code")), "code", "weight").select("detect_id", "weight"),
    """SELECT detect_id, round(CASE WHEN is_fishing IS NULL THEN 0 ELSE count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY is_fishing)) END, 6) AS weight FROM gt_fx""",
)
CLASS_SQL = f"""SELECT label, (1/CAST(greatest(n,1) AS DOUBLE)) / sum(1/CAST(greatest(n,1) AS DOUBLE)) OVER () AS class_weight FROM
 (SELECT label, count(k) AS n FROM range(0, 5) r(label) LEFT JOIN (SELECT {FOUR} AS k FROM gt_fx) ON k = label GROUP BY 1)"""


def _typed(fx):
    return fx.gt.select("detect_id", "scene_id", L.four_class(C("is_vessel"), C("is_fishing")).alias("kind"))


add("a29_class_weights", lambda fx: W.class_weights(_typed(fx), "kind", 5), f"SELECT label, round(class_weight, 6) AS class_weight FROM ({CLASS_SQL})")
add(
    "a30_image_weights",
    lambda fx: W.image_weights(_typed(fx), "scene_id", "kind", 5),
    f"SELECT scene_id, round(sum(class_weight),6) AS image_weight FROM (SELECT scene_id, {FOUR} AS k FROM gt_fx) JOIN ({CLASS_SQL}) ON k = label GROUP BY 1",
)
add(
    "a31_bounded_balancing",
    lambda fx: W.bounded_balancing_weight(_typed(fx), "kind", "weight", 1000, 230, 240, True).select("detect_id", "weight"),
    f"""SELECT detect_id, round(CASE WHEN e > 240 THEN 240*n/1000/m WHEN e < 230 THEN 230*n/1000/m ELSE w END, 6) AS weight FROM (SELECT *, w*m*1000/n AS e FROM
 (SELECT *, sqrt(n/(k*m)) AS w FROM (SELECT detect_id, CAST(count(*) OVER () AS DOUBLE) AS n, CAST(count(*) OVER (PARTITION BY kind) AS DOUBLE) AS m,
 (SELECT count(DISTINCT {FOUR}) FROM gt_fx) AS k FROM (SELECT detect_id, {FOUR} AS kind FROM gt_fx))))""",
)
add(
    "a32_combined_weight",
    lambda fx: W.combined_weight(fx.gt.join(places(fx), "scene_id"), 200, True, True, True, True, True, True, True).select("detect_id", "weight"),
    f"""WITH b AS (SELECT g.*, location, {FOUR} AS kind, distance_from_shore_km < 2 AS near FROM gt_fx g JOIN ({_PLACES_SQL}) p ON p.scene_id = g.scene_id),
 k AS (SELECT CAST(count(DISTINCT location) AS DOUBLE) AS kl, CAST(count(DISTINCT scene_id) AS DOUBLE) AS ks, CAST(count(DISTINCT kind) AS DOUBLE) AS kk, CAST(count(DISTINCT near) AS DOUBLE) AS kn FROM b),
 c AS (SELECT a.detect_id, count(*) AS near_n FROM gt_fx a JOIN gt_fx b ON a.scene_id = b.scene_id
  AND greatest(abs(a.detect_scene_row-b.detect_scene_row), abs(a.detect_scene_column-b.detect_scene_column)) <= 100 GROUP BY 1)
 SELECT b.detect_id, round((1 + n/(kl*count(*) OVER (PARTITION BY location)) + 1.0::DOUBLE/near_n + n/(ks*count(*) OVER (PARTITION BY scene_id))
 + CASE WHEN is_vessel IS NULL THEN 0 ELSE n/(2.0::DOUBLE*count(*) OVER (PARTITION BY is_vessel)) END + CASE WHEN is_fishing IS NULL THEN 0 ELSE n/(2.0::DOUBLE*count(*) OVER (PARTITION BY is_fishing)) END
 + n/(kk*count(*) OVER (PARTITION BY kind)) + CASE WHEN kn > 1 OR near THEN n/(kn*count(*) OVER (PARTITION BY near)) ELSE 0 END) / (6 + CASE WHEN kn > 1 OR near THEN 1 ELSE 0 END), 6) AS weight
 FROM b JOIN c ON c.detect_id = b.detect_id, k, (SELECT count(*) AS n FROM gt_fx)""",
)
add(
    "a33_per_scene_weight",
    lambda fx: W.per_scene_weight(fx.gt, 200, True, True, True).select("detect_id", "weight"),
    f"""WITH b AS (SELECT *, {FOUR} AS kind, distance_from_shore_km <= 2 AS near FROM gt_fx),
 k AS (SELECT scene_id, count(*) AS n, CAST(count(DISTINCT kind) AS DOUBLE) AS kk, CAST(count(DISTINCT near) AS DOUBLE) AS kn FROM b GROUP BY 1),
 c AS (SELECT a.detect_id, 1/CAST(count(*) AS DOUBLE) AS inv FROM gt_fx a JOIN gt_fx b ON a.scene_id = b.scene_id
  AND greatest(abs(a.detect_scene_row-b.detect_scene_row), abs(a.detect_scene_column-b.detect_scene_column)) <= 100 GROUP BY 1)
 SELECT b.detect_id, round((1 + CASE WHEN kn > 1 OR near THEN 1/(kn*count(*) OVER (PARTITION BY b.scene_id, near)) ELSE 0 END + inv / sum(inv) OVER (PARTITION BY b.scene_id)
 + n/(kk*count(*) OVER (PARTITION BY b.scene_id, kind))) / (2 + CASE WHEN kn > 1 OR near THEN 1 ELSE 0 END), 6) AS weight FROM b JOIN k ON k.scene_id = b.scene_id JOIN c ON c.detect_id = b.detect_id""",
)
add(
    "a33_scene_pick_weight",
    lambda fx: W.scene_pick_weight(fx.scn.select("scene_key", "location", C("official_split").alias("folder")), True, True).select("scene_key", "weight"),
    """SELECT scene_key, round(sqrt(n/(kl*count(*) OVER (PARTITION BY location)) * n/(kf*count(*) OVER (PARTITION BY official_split))), 6) AS weight FROM scn_fx,
 (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT location) AS kl, count(DISTINCT official_split) AS kf FROM scn_fx)""",
)

# --- folds ---------------------------------------------------------------------


def fold_sql(source, stratum, folds):
    """Scene -> fold of the snake rule; ``source`` is a FROM clause with scene_id."""
    return f"""SELECT scene_id, CASE WHEN place < {folds} THEN place ELSE {2 * folds - 1} - place END AS fold FROM (SELECT scene_id, (row_number() OVER (PARTITION BY s ORDER BY big DESC, h, scene_id) - 1) % {2 * folds} AS place FROM
 (SELECT scene_id, s, floor(log2(sum(n) OVER (PARTITION BY scene_id))) AS big, md5(scene_id) AS h, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, s) AS first
 FROM (SELECT scene_id, {stratum} AS s, count(*) AS n FROM {source} GROUP BY 1, 2)) WHERE first = 1)"""


SHORE_STRATUM = "CASE WHEN distance_from_shore_km < 2 THEN 1 ELSE 0 END"


def _halves(fx):
    """Scenes with even numbers act as training data, odd ones as validation data."""
    n = F.expr("CAST(substr(scene_id, 2) AS BIGINT)")
    return fx.gt.filter(n % 2 == 0), fx.gt.filter(n % 2 == 1)


HALVES_SQL = f"""pl AS ({_PLACES_SQL}), tr AS (SELECT * FROM gt_fx WHERE CAST(substr(scene_id, 2) AS BIGINT) % 2 = 0), va AS (SELECT * FROM gt_fx WHERE CAST(substr(scene_id, 2) AS BIGINT) % 2 = 1),
 ho AS (SELECT location, min(tr.scene_id) AS scene_id FROM tr JOIN pl ON pl.scene_id = tr.scene_id GROUP BY 1)"""


def _parts(split):
    parts = [getattr(split, n).select(F.lit(n).alias("part"), "scene_id", "detect_id") for n in ("train", "valid", "holdout")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part", "scene_id").agg(F.count("*").alias("n"))


add(
    "k1_precomputed_split",
    lambda fx: _parts(FO.precomputed_split(fx.gt, fx.scn, 1)),
    """SELECT CASE WHEN fold = -1 THEN 'holdout' WHEN fold = 1 THEN 'valid' ELSE 'train' END AS part, g.scene_id, count(*) AS n FROM gt_fx g JOIN scn_fx s ON s.scene_id = g.scene_id GROUP BY 1, 2""",
)
add(
    "k2_validation_split",
    lambda fx: _parts(FO.split_by_name("valid_only", *_halves(fx), places(fx), 1, 4)),
    f"""WITH {HALVES_SQL}, f AS ({fold_sql('va', SHORE_STRATUM, 4)})
 SELECT CASE WHEN fold = 1 THEN 'valid' ELSE 'train' END AS part, va.scene_id, count(*) AS n FROM va JOIN f ON f.scene_id = va.scene_id GROUP BY 1, 2
 UNION ALL SELECT 'holdout', scene_id, count(*) FROM tr WHERE scene_id IN (SELECT scene_id FROM ho) GROUP BY 2""",
)
add(
    "k3_validation_holdout_split",
    lambda fx: _parts(FO.split_by_name("valid_only_with_holdout", *_halves(fx), places(fx), 1, 4)),
    f"""WITH {HALVES_SQL}, f AS ({fold_sql('va', SHORE_STRATUM, 5)})
 SELECT CASE WHEN fold = 1 THEN 'valid' WHEN fold = 4 THEN 'holdout' ELSE 'train' END AS part, va.scene_id, count(*) AS n FROM va JOIN f ON f.scene_id = va.scene_id GROUP BY 1, 2""",
)
add(
    "k4_full_split",
    lambda fx: _parts(FO.split_by_name("full", *_halves(fx), places(fx), 1, 4)),
    f"""WITH {HALVES_SQL}, f AS ({fold_sql('va', SHORE_STRATUM, 4)}), ex AS (SELECT * FROM tr WHERE scene_id NOT IN (SELECT scene_id FROM ho)),
 fe AS ({fold_sql('ex', 'coalesce(CAST(is_fishing AS BIGINT), 2)', 4)})
 SELECT CASE WHEN fold = 1 THEN 'valid' ELSE 'train' END AS part, va.scene_id, count(*) AS n FROM va JOIN f ON f.scene_id = va.scene_id GROUP BY 1, 2
 UNION ALL SELECT 'train', ex.scene_id, count(*) FROM ex JOIN fe ON fe.scene_id = ex.scene_id WHERE fold <> 1 GROUP BY 2
 UNION ALL SELECT 'holdout', scene_id, count(*) FROM tr WHERE scene_id IN (SELECT scene_id FROM ho) GROUP BY 2""",
)
add(
    "k5_tiny_split",
    lambda fx: _parts(FO.tiny_split(*_halves(fx), ("s0", "s2", "s8"), ("s1", "s5"))),
    """SELECT p AS part, scene_id, count(*) AS n FROM gt_fx JOIN (VALUES ('train','s0'),('train','s2'),('train','s8'),('valid','s1'),('valid','s5'),('holdout','s1'),('holdout','s5')) v(p, s) ON s = scene_id GROUP BY 1,2""",
)
add(
    "k6_stratified_group_folds",
    lambda fx: FO.stratified_group_folds(fx.gt, "scene_id", L.near_shore_balance(C("distance_from_shore_km")).cast("int"), 4),
    fold_sql("gt_fx", SHORE_STRATUM, 4),
)
add(
    "n5_first_scene_per_location",
    lambda fx: FO.first_scene_per_location(fx.scn),
    "SELECT location, min(scene_id) AS scene_id FROM scn_fx GROUP BY location",
)
add(
    "o3_sort_by_count",
    lambda fx: P.attach_location_counts(fx.scn.select("scene_key", "location", "official_split")).orderBy("scenes_count_in_train_and_valid", "scene_key"),
    f"SELECT scene_key, official_split, k.* FROM scn_fx s JOIN ({COUNTS_SQL}) k ON k.location = s.location ORDER BY scenes_count_in_train_and_valid, scene_key",
)
