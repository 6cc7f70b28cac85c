"""Heatmaps, decoding, tiles and merging."""

from pyspark.sql import functions as F

from registry.core import PIXELS_SQL, add, pixels
from tidegrid.functions import labels as L
from tidegrid.functions import scalars as S
from tidegrid.operators import heatmap as H
from tidegrid.operators import patches as PA
from tidegrid.operators import tiles as T
from tidegrid.operators.ranking import top_k
from tidegrid.plans import detection as DE
from tidegrid.plans import targets as TG
from tidegrid.sources.rasters import align_channels, pixels_of, tiles_from_pixels

C = F.col


def heat(fx):
    return pixels(fx).select("scene_id", "r", "c", C("heat").alias("obj"))


def patches(fx, side, **channels):
    """The pixel table as patches, a channel for each column."""
    return tiles_from_pixels(pixels(fx), side, channels or {"obj": C("heat")})


def flat(tiles, name):
    return pixels_of(tiles).select("scene_id", "r", "c", C("v").alias(name))


def around(half, value="heat"):
    """Largest value in the square around a pixel, in SQL."""
    return f"""(SELECT max(q.{value}) FROM px q WHERE q.scene_id = p.scene_id AND abs(q.r-p.r) <= {half} AND abs(q.c-p.c) <= {half})"""


PX = f"WITH px AS ({PIXELS_SQL})"
# the square maximum as a join, which the other engine runs faster than a subquery per row
SQUARE3 = """sq AS (SELECT p.scene_id, p.r, p.c, max(q.heat) AS m FROM px p JOIN (VALUES (-1),(0),(1)) a(dr) ON true JOIN (VALUES (-1),(0),(1)) b(dc) ON true
 JOIN px q ON q.scene_id = p.scene_id AND q.r = p.r+dr AND q.c = p.c+dc GROUP BY 1,2,3)"""
add(
    "n1_local_maxima",
    lambda fx: flat(PA.suppress(patches(fx, 16), 16, 3), "obj"),
    f"""{PX}, {SQUARE3} SELECT p.scene_id, p.r, p.c, CASE WHEN heat = m THEN heat ELSE 0 END AS obj FROM px p JOIN sq ON sq.scene_id = p.scene_id AND sq.r = p.r AND sq.c = p.c""",
)
add(
    "n2_sparse_maxima",
    lambda fx: H.local_maxima_sparse(heat(fx).filter("obj >= 0.3"), "obj", 3),
    f"""WITH px AS (SELECT * FROM ({PIXELS_SQL}) WHERE heat >= 0.3), {SQUARE3} SELECT p.scene_id, p.r, p.c, heat AS obj FROM px p JOIN sq ON sq.scene_id = p.scene_id AND sq.r = p.r AND sq.c = p.c WHERE heat = m""",
)


def plus_sql(k):
    h = k // 2
    return f"""max(heat) OVER (PARTITION BY scene_id, r ORDER BY c RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS hm{k},
 max(heat) OVER (PARTITION BY scene_id, c ORDER BY r RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS vm{k}"""


def _tight(fx):
    three = flat(PA.suppress(patches(fx, 16), 16, 3, tight=True), "tight3")
    five = flat(PA.suppress(patches(fx, 16), 16, 5, tight=True), "tight5")
    return three.join(five, ["scene_id", "r", "c"])


add(
    "n3_tight_maxima",
    _tight,
    f"""{PX}, {SQUARE3}, w AS (SELECT *, {plus_sql(3)}, {plus_sql(5)} FROM px)
 SELECT p.scene_id, p.r, p.c, CASE WHEN heat = hm3 AND heat = vm3 THEN heat ELSE 0 END AS tight3, CASE WHEN heat = hm5 AND heat = vm5 AND heat = m THEN heat ELSE 0 END AS tight5
 FROM w p JOIN sq ON sq.scene_id = p.scene_id AND sq.r = p.r AND sq.c = p.c""",
)
add(
    "n4_top_k_pixels",
    lambda fx: top_k(heat(fx), 100, ["scene_id"], [F.desc("obj"), C("r"), C("c")], "place").withColumn("flat", C("r") * 50 + C("c")),
    f"""SELECT * FROM (SELECT scene_id, r, c, heat AS obj, row_number() OVER (PARTITION BY scene_id ORDER BY heat DESC, r, c) AS place, r*50+c AS flat FROM ({PIXELS_SQL})) WHERE place <= 100""",
)
add(
    "n6_drawing_order",
    lambda fx: fx.gt.select("scene_id", "detect_id", "confidence", L.length_to_pixels(C("vessel_length_m")).alias("length_px")).select(
        "detect_id", TG.drawing_order().alias("o")
    ).select("detect_id", C("o.rank").alias("rank"), C("o.neg").alias("neg")),
    """SELECT detect_id, CAST(CASE confidence WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS BIGINT) AS rank, round(-coalesce(vessel_length_m,0)/10, 6) + 0 AS neg FROM gt_fx""",
)
add(
    "n7_adaptive_limit",
    lambda fx: TG.adaptive_limit(fx.gt.groupBy("scene_id").agg(F.count("*").alias("n"))),
    "SELECT CAST(least(2048, greatest(128, 2*max(n))) AS BIGINT) AS max_objects FROM (SELECT count(*) AS n FROM gt_fx GROUP BY scene_id)",
)
SIDE = 160


def objects(fx):
    """Labels brought into a small square, as objects to draw."""
    return fx.gt.select(
        "scene_id",
        "detect_id",
        (C("detect_scene_column") % SIDE).alias("x"),
        (C("detect_scene_row") % SIDE).alias("y"),
        "confidence",
        L.unknown_to_code(C("is_vessel")).alias("is_vessel"),
        L.unknown_to_code(C("is_fishing")).alias("is_fishing"),
        (L.length_to_pixels(C("vessel_length_m")) / 8).alias("length_px"),
    )


OBJECTS_SQL = f"""SELECT scene_id, detect_id, detect_scene_column % {SIDE} AS x, detect_scene_row % {SIDE} AS y, confidence, coalesce(CAST(is_vessel AS BIGINT),255) AS is_vessel,
 coalesce(CAST(is_fishing AS BIGINT),255) AS is_fishing, coalesce(vessel_length_m,0)/80 AS length_px FROM gt_fx"""


def placed(fx):
    return TG.place_objects(objects(fx), 2)


PLACED_SQL = f"SELECT *, x//2 AS ox, y//2 AS oy, CAST(greatest(2, ceil(length_px/2*0.5)) AS BIGINT) AS radius FROM ({OBJECTS_SQL})"


def drawn_sql(value, reach, name, where="true"):
    half = SIDE // 2
    return f"""SELECT scene_id, oy+dy AS r, ox+dx AS c, max({value}) AS {name} FROM ({PLACED_SQL}) o, range(-12, 13) a(dy), range(-12, 13) b(dx)
 WHERE greatest(abs(dx), abs(dy)) <= {reach} AND {where} AND oy+dy >= 0 AND oy+dy < {half} AND ox+dx >= 0 AND ox+dx < {half} GROUP BY 1,2,3"""


def rounded_sql(sql, name):
    return f"SELECT scene_id, r, c, round(CAST({name} AS DOUBLE), 6) AS {name} FROM ({sql})"


GAUSS = "exp(-(dx*dx+dy*dy)/(2*power((2*radius+1)/6.0::DOUBLE, 2)))"
add(
    "a40_splat_gaussian",
    lambda fx: H.splat_gaussian(placed(fx), SIDE // 2, SIDE // 2),
    rounded_sql(drawn_sql(GAUSS, "radius", "obj", f"{GAUSS} >= 2.220446049250313e-16"), "obj"),
)
add(
    "a40_splat_points",
    lambda fx: H.splat_points(placed(fx), SIDE // 2, SIDE // 2),
    rounded_sql(drawn_sql("CASE abs(dx)+abs(dy) WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.5 END", "1", "obj"), "obj"),
)
add(
    "a41_splat_disk",
    lambda fx: H.splat_disk(placed(fx).withColumn("value", C("is_vessel").cast("double")), "value", SIDE // 2, SIDE // 2),
    rounded_sql(drawn_sql("is_vessel", "radius", "value", "dx*dx+dy*dy <= radius*radius"), "value"),
)
add(
    "a43_splat_square_gaussian",
    lambda fx: H.splat_square_gaussian(placed(fx).withColumn("sigma", C("radius") % 3 + 1), SIDE // 2, SIDE // 2),
    rounded_sql(drawn_sql("exp(-(dx*dx+dy*dy)/CAST((radius%3+1)*(radius%3+1) AS DOUBLE))", "3*(radius%3+1)", "obj"), "obj"),
)


def encoded(fx, stride=2, **kw):
    return TG.encode_targets(objects(fx), SIDE, SIDE, stride, **kw)


RANKED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY scene_id, oy, ox ORDER BY CASE confidence WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END DESC, -length_px DESC, detect_id DESC) AS last FROM ({PLACED_SQL})"""
OFFSETS_SQL = f"SELECT scene_id, oy AS r, ox AS c, x/2.0::DOUBLE-ox AS off_x, y/2.0::DOUBLE-oy AS off_y FROM ({RANKED_SQL}) WHERE last = 1"
DISK = "dx*dx+dy*dy <= radius*radius"
ENCODED_SQL = f"""SELECT h.scene_id, h.r, h.c, obj, coalesce(vsl,0) AS vsl, coalesce(fsh,0) AS fsh, coalesce(len_log,0) AS len_log, coalesce(off_x,0) AS off_x, coalesce(off_y,0) AS off_y
 FROM ({drawn_sql(f"CASE WHEN {GAUSS} < 2.220446049250313e-16 THEN 0 ELSE {GAUSS} END", "radius", "obj")}) h
 LEFT JOIN ({drawn_sql("CAST(is_vessel AS DOUBLE)", "radius", "vsl", DISK)}) v USING (scene_id, r, c)
 LEFT JOIN ({drawn_sql("CAST(is_fishing AS DOUBLE)", "radius", "fsh", DISK)}) f USING (scene_id, r, c)
 LEFT JOIN ({drawn_sql("ln(length_px+1)", "radius", "len_log", DISK)}) l USING (scene_id, r, c)
 LEFT JOIN ({OFFSETS_SQL}) o USING (scene_id, r, c)"""
add(
    "a42_offsets",
    lambda fx: encoded(fx, fixed_radius=2).select("scene_id", "r", "c", "off_x", "off_y").filter("off_x > 0 OR off_y > 0"),
    f"SELECT scene_id, r, c, off_x, off_y FROM ({OFFSETS_SQL}) WHERE off_x > 0 OR off_y > 0",
)
add(
    "d3_encode_targets",
    encoded,
    f"SELECT scene_id, r, c, round(obj,6) AS obj, vsl, fsh, round(len_log,6) AS len_log, off_x, off_y FROM ({ENCODED_SQL})",
)
add(
    "d3_encode_point_labels",
    lambda fx: encoded(fx, labels="point", ignore_low=True, fixed_radius=3).groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.sum("obj").alias("heat"), F.sum("vsl").alias("vsl"), F.sum("fsh").alias("fsh"), F.sum("len_log").alias("len_log")
    ),
    f"""WITH o AS ({RANKED_SQL}), d AS (SELECT scene_id, oy+dy AS r, ox+dx AS c, max(CASE WHEN confidence = 'LOW' THEN CASE WHEN dx*dx+dy*dy <= 9 THEN 255 ELSE 0 END ELSE exp(-(dx*dx+dy*dy)/(2*power(7/6.0::DOUBLE, 2))) END) AS obj,
 max(CASE WHEN dx=0 AND dy=0 AND last=1 THEN is_vessel END) AS vsl, max(CASE WHEN dx=0 AND dy=0 AND last=1 THEN is_fishing END) AS fsh, max(CASE WHEN dx=0 AND dy=0 AND last=1 THEN ln(length_px+1) END) AS len_log
 FROM o, range(-3,4) a(dy), range(-3,4) b(dx) WHERE oy+dy >= 0 AND oy+dy < 80 AND ox+dx >= 0 AND ox+dx < 80 GROUP BY 1,2,3)
 SELECT scene_id, count(*) AS pixels, round(sum(obj),6) AS heat, CAST(coalesce(sum(vsl),0) AS DOUBLE) AS vsl, CAST(coalesce(sum(fsh),0) AS DOUBLE) AS fsh, round(coalesce(sum(len_log),0),6) AS len_log FROM d WHERE obj > 0 OR vsl > 0 OR fsh > 0 OR len_log > 0 GROUP BY 1""",
)


def maps(fx):
    """Six map columns from the pixel table."""
    return pixels(fx).select(
        "scene_id", "r", "c", C("heat").alias("obj"), (1 - C("heat")).alias("vsl"), S.sigmoid_normalise(C("vv")).alias("fsh"),
        (C("heat") * 3 - 0.5).alias("len_log"), (C("heat") / 2).alias("off_x"), (C("heat") / 4).alias("off_y"),
    )


DECODED_SQL = f"""SELECT scene_id, (c+heat/2)*2 AS x, (r+heat/4)*2 AS y, exp(greatest(heat*3-0.5,0))-1 AS length_px, heat AS objectness_p, 1-heat AS is_vessel_p, coalesce(1/(1+exp(-(vv+20)*0.18)),0) AS is_fishing_p FROM
 (SELECT p.*, row_number() OVER (PARTITION BY p.scene_id ORDER BY heat DESC, p.r, p.c) AS n FROM px p JOIN sq ON sq.scene_id = p.scene_id AND sq.r = p.r AND sq.c = p.c WHERE heat = m) WHERE n <= 200"""
FLOORED = f"WITH px AS (SELECT * FROM ({PIXELS_SQL}) WHERE heat >= 0.3), {SQUARE3}"
add(
    "d1_decode_maps",
    lambda fx: TG.decode_maps(maps(fx), 2, 200),
    f"""{FLOORED} SELECT scene_id, round(x,6) AS x, round(y,6) AS y, round(length_px,6) AS length_px, objectness_p, round(is_vessel_p,6) AS is_vessel_p, round(is_fishing_p,6) AS is_fishing_p FROM ({DECODED_SQL})""",
)
add(
    "d2_detections",
    lambda fx: TG.detections(TG.decode_maps(maps(fx), 2, 200), row0=F.lit(100), col0=F.lit(50)),
    f"""{FLOORED} SELECT round(length_px*10,6) AS vessel_length_m, CAST(trunc(y+100) AS BIGINT) AS detect_scene_row, CAST(trunc(x+50) AS BIGINT) AS detect_scene_column, scene_id, objectness_p, round(is_vessel_p,6) AS is_vessel_p,
 round(is_fishing_p,6) AS is_fishing_p, CAST(0.3 AS DOUBLE) AS objectness_threshold FROM ({DECODED_SQL})""",
)
add(
    "p18b_crop_detections",
    lambda fx: TG.detections(TG.decode_maps(maps(fx), 1, 50, offsets=False), row0=C("x") * 0 + 7, col0=F.lit(9)).unionByName(
        TG.detections(TG.decode_maps(maps(fx), 4, 50, kernel=3, offsets=False))
    ).select("scene_id", "detect_scene_row", "detect_scene_column"),
    f"""{FLOORED}, k AS (SELECT p.*, row_number() OVER (PARTITION BY p.scene_id ORDER BY heat DESC, p.r, p.c) AS n FROM px p JOIN sq ON sq.scene_id = p.scene_id AND sq.r = p.r AND sq.c = p.c WHERE heat = m)
 SELECT scene_id, r+7 AS detect_scene_row, c+9 AS detect_scene_column FROM k WHERE n <= 50 UNION ALL SELECT scene_id, r*4+2, c*4+2 FROM k WHERE n <= 50""",
)
add(
    "d4_log_lengths",
    lambda fx: objects(fx).select("detect_id", S.length_to_log(C("length_px")).alias("log_length"), S.log_to_length(S.length_to_log(C("length_px"))).alias("back")),
    "SELECT detect_id, round(ln(coalesce(vessel_length_m,0)/80+1),6) AS log_length, round(coalesce(vessel_length_m,0)/80,6) AS back FROM gt_fx",
)

def placed_pixels(tiles, name, keys=("r0", "c0", "y", "x")):
    """Pixels of tiles with the place of their tile and their place inside."""
    one = tiles.select("scene_id", C("tile_row").cast("bigint").alias(keys[0]), C("tile_col").cast("bigint").alias(keys[1]), "w", F.posexplode("pixels").alias("i", name))
    y, x = F.floor(C("i") / C("w")).cast("bigint"), (C("i") % C("w")).cast("bigint")
    return one.select("scene_id", keys[0], keys[1], y.alias(keys[2]), x.alias(keys[3]), name)


# --- tiles ----------------------------------------------------------------------
add(
    "t1_regular_crops",
    lambda fx: T.regular_crops(fx.scn, 256, 256),
    """SELECT scene_id, r*256 AS r0, r*256+256 AS r1, c*256 AS c0, c*256+256 AS c1 FROM scn_fx, range(0,10) a(r), range(0,10) b(c) WHERE r*256+256 <= scene_rows AND c*256+256 <= scene_cols""",
)
add(
    "t2_overlapping_tiles",
    lambda fx: T.overlapping_tiles(fx.scn, 512, 384),
    """SELECT scene_id, pr AS pad_rows, pc AS pad_cols, r*384 AS r0, c*384 AS c0 FROM (SELECT scene_id, CAST(ceil(scene_rows/512)*512 AS BIGINT) AS pr, CAST(ceil(scene_cols/512)*512 AS BIGINT) AS pc FROM scn_fx), range(0,10) a(r), range(0,10) b(c) WHERE r*384+512 <= pr AND c*384+512 <= pc""",
)
add(
    "t3_cut_tiles",
    lambda fx: T.prediction_cut(placed_pixels(PA.cut_tiles(patches(fx, 20), 16, 12), "heat"), 16, 4).drop("pred_size"),
    f"""SELECT scene_id, i*12 AS r0, j*12 AS c0, r-i*12 AS y, c-j*12 AS x, heat, i*3 AS pred_r0, j*3 AS pred_c0 FROM ({PIXELS_SQL}), range(0,5) a(i), range(0,5) b(j) WHERE r >= i*12 AND r < i*12+16 AND c >= j*12 AND c < j*12+16""",
)
add(
    "t4_chips",
    lambda fx: placed_pixels(PA.regrid(patches(fx, 20), 8), "heat", ("r0", "c0", "in_row", "in_col")).select(
        "scene_id", F.expr("r0 div 8").alias("chip_row"), F.expr("c0 div 8").alias("chip_col"), "in_row", "in_col", "heat"
    ),
    f"SELECT scene_id, r//8 AS chip_row, c//8 AS chip_col, r%8 AS in_row, c%8 AS in_col, heat FROM ({PIXELS_SQL})",
)


def _merged(fx):
    cut = PA.cut_tiles(patches(fx, 16), 16, 12)
    seen = cut.withColumn("pixels", F.transform("pixels", lambda v: v + (C("tile_row") + C("tile_col")) / 1000))
    return flat(PA.merge(seen, 16, 12), "obj")


def _edge(v):
    return f"sqrt(power(least({v}+0.5, 16-({v}+0.5)),2)+0.25)"


add(
    "a34_merge_tiles",
    _merged,
    f"""WITH t AS (SELECT scene_id, r, c, heat+(i*12+j*12)/1000.0::DOUBLE AS v, r-i*12 AS y, c-j*12 AS x FROM ({PIXELS_SQL}), range(0,5) a(i), range(0,5) b(j) WHERE r >= i*12 AND r < i*12+16 AND c >= j*12 AND c < j*12+16),
 w AS (SELECT *, least({_edge('y')}, {_edge('x')}) AS e, sqrt(power(y+0.5-8,2)+power(x+0.5-8,2)) AS d FROM t) SELECT scene_id, r, c, round(sum(v*e/(e+d))/sum(e/(e+d)),6) AS obj FROM w GROUP BY 1,2,3""",
)


def _models(fx):
    """Three models whose maps are cut into tiles of different sizes."""
    parts = None
    for m in range(3):
        t = patches(fx, 10 + 6 * m, obj=C("heat") * (m + 1) - m)
        parts = t if parts is None else parts.unionByName(t)
    return parts


add(
    "a35_ensemble",
    lambda fx: flat(PA.ensemble(_models(fx), 16, "after_model"), "obj").join(
        flat(PA.ensemble(_models(fx), 16, "after_ensemble"), "late"), ["scene_id", "r", "c"]
    ),
    f"""SELECT scene_id, r, c, round((1/(1+exp(-heat))+1/(1+exp(-(heat*2-1)))+1/(1+exp(-(heat*3-2))))/3,6) AS obj, round(1/(1+exp(-(heat+heat*2-1+heat*3-2)/3)),6) AS late FROM ({PIXELS_SQL})""",
)


def _same_grid(fx):
    parts = None
    for m in range(3):
        t = tiles_from_pixels(pixels(fx), 16, {"obj": C("heat") * (m + 1) - m}).withColumn("model", F.lit(m))
        parts = t if parts is None else parts.unionByName(t)
    return pixels_of(T.average_same_grid(parts, ["scene_id", "channel", "tile_row", "tile_col", "h", "w"])).select("scene_id", "r", "c", C("v").alias("obj"))


add(
    "a35_ensemble_same_grid",
    _same_grid,
    f"SELECT scene_id, r, c, round((heat+heat*2-1+heat*3-2)/3,6) AS obj FROM ({PIXELS_SQL})",
)


def _variants(fx):
    """Maps of moved inputs: those of the k-th move are higher by k."""
    from tidegrid.functions.geometry import MODE_MOVES

    moves = MODE_MOVES["d4"]
    moved = PA.move_variants(patches(fx, 16), moves, 50, 50, 16)
    number = F.array_position(F.array(*[F.lit(m) for m in moves]), C("variant")) - 1
    return moved.withColumn("pixels", F.transform("pixels", lambda v: v + number))


add(
    "a36_undo_variants",
    # scenes smaller than the map have pixels that no map gives
    lambda fx: flat(PA.undo_variants(_variants(fx), 50, 50, 16), "obj").filter("obj IS NOT NULL"),
    f"SELECT scene_id, r, c, round(heat+3.5,6) AS obj FROM ({PIXELS_SQL})",
)


def _scales(fx):
    base = pixels(fx).select("scene_id", "r", "c", C("heat").alias("size"))
    parts = None
    for offset in (0, -10):
        small = [F.floor(C(x) * (50 + offset) / 50).cast("bigint").alias(x) for x in ("r", "c")]
        part = base.groupBy("scene_id", *small).agg(F.max("size").alias("size"))
        part = tiles_from_pixels(part, 16, {"size": C("size")}).withColumn("scale_offset", F.lit(offset))
        parts = part if parts is None else parts.unionByName(part)
    return flat(PA.undo_scales(parts.withColumns({"scene_rows": F.lit(50), "scene_cols": F.lit(50)}), 16), "size")


add(
    "a37_undo_scales",
    _scales,
    f"""{PX}, sm AS (SELECT scene_id, r*40//50 AS r, c*40//50 AS c, max(heat) AS heat FROM px GROUP BY 1,2,3), s AS (SELECT scene_id, r, c, heat AS v FROM px UNION ALL SELECT k.scene_id, tr, tc, heat*50/40.0::DOUBLE FROM (SELECT DISTINCT scene_id FROM px) k, range(0,50) a(tr), range(0,50) b(tc)
 JOIN sm ON sm.r = tr*40//50 AND sm.c = tc*40//50 WHERE sm.scene_id = k.scene_id) SELECT scene_id, r, c, round(avg(v),6) AS size FROM s GROUP BY 1,2,3""",
)
add(
    "a38_overview",
    lambda fx: flat(PA.overview(patches(fx, 16)), "heat"),
    f"SELECT scene_id, r//4 AS r, c//4 AS c, round(avg(heat),6) AS heat FROM ({PIXELS_SQL}) GROUP BY 1,2,3",
)
add(
    "a39_grey_composite",
    lambda fx: flat(PA.grey_composite(align_channels(patches(fx, 16, vv=C("vv"), vh=C("heat")), ["vv", "vh"]), "vv", "vh"), "grey").withColumn("grey", C("grey").cast("bigint")),
    f"""SELECT scene_id, r, c, CAST(round(coalesce((m-min(m) OVER w)/(max(m) OVER w-min(m) OVER w)*255,0)) AS BIGINT) AS grey FROM (SELECT *, (vv+heat)/2 AS m FROM ({PIXELS_SQL})) WINDOW w AS (PARTITION BY scene_id)""",
)


def _user_model(batches):
    """Stands where a network would be: a batch of tiles in, a batch of maps out."""
    import numpy as np

    for pdf in batches:
        pdf["pixels"] = [np.nan_to_num(np.asarray(p, dtype=float)) * 2.0 for p in pdf["pixels"]]
        yield pdf[["scene_id", "channel", "tile_row", "tile_col", "h", "w", "pixels"]]


def _scored_tiles(fx):
    tiles = tiles_from_pixels(pixels(fx), 16, {"vv": C("vv")}).select("scene_id", "channel", "tile_row", "tile_col", "h", "w", "pixels")
    schema = "scene_id STRING, channel STRING, tile_row INT, tile_col INT, h INT, w INT, pixels ARRAY<DOUBLE>"
    return pixels_of(T.score_tiles(tiles, _user_model, schema)).select("scene_id", "r", "c", "v")


add("t3_user_model", _scored_tiles, f"SELECT scene_id, r, c, round(coalesce(vv,0)*2,6) AS v FROM ({PIXELS_SQL})")


# --- decoding with a limit for each scene, and the whole way from scenes to detections ---


def _limits(fx):
    """Few enough objects a scene that the limit counts."""
    return TG.limits_per_scene(fx.gt, 40, 150).withColumn("max_objects", F.expr("max_objects - CAST(substr(scene_id, 2) AS BIGINT) % 60"))


add(
    "d1_limit_per_scene",
    lambda fx: TG.decode_maps(maps(fx), 2, _limits(fx)),
    f"""{FLOORED}, k AS (SELECT scene_id, least(150, greatest(40, 2*count(*))) - CAST(substr(scene_id, 2) AS BIGINT) % 60 AS most FROM gt_fx GROUP BY 1)
 SELECT scene_id, round(x,6) AS x, round(y,6) AS y, round(length_px,6) AS length_px, objectness_p, round(is_vessel_p,6) AS is_vessel_p, round(is_fishing_p,6) AS is_fishing_p
 FROM ({DECODED_SQL.replace(" WHERE n <= 200", "").replace("SELECT scene_id,", "SELECT n, scene_id,", 1)}) JOIN k USING (scene_id) WHERE n <= most""",
)


def _model(share):
    """Stands where a network would be: maps from the two bands of a tile."""

    def run(bands):
        vv, vh = bands["vv"], bands["vh"]
        return {"obj": vh * share, "vsl": 1 - vh, "fsh": vv, "len_log": vh * 3 - 0.5, "off_x": vh * 1.5, "off_y": vh * 0.75}

    return run


def _scenes_to_detections(fx):
    tiles = tiles_from_pixels(pixels(fx), 20, {"vv": C("vv"), "vh": C("heat")})
    normalise = {"vv": S.sigmoid_normalise, "vh": lambda v: v}
    found = DE.detect_scenes(tiles, normalise, [_model(1.0), _model(0.9)], 16, 12, ("none", "fliplr", "rot90"), max_objects=TG.limits_per_scene(fx.gt))
    return found.select("scene_id", "detect_scene_row", "detect_scene_column", "vessel_length_m", "objectness_p", "is_vessel_p", "is_fishing_p")


add(
    "scenes_to_detections",
    _scenes_to_detections,
    f"""{PX}, {SQUARE3} SELECT p.scene_id, CAST(floor(p.r+heat*0.75) AS BIGINT) AS detect_scene_row, CAST(floor(p.c+heat*1.5) AS BIGINT) AS detect_scene_column,
 round((exp(greatest(heat*3-0.5,0))-1)*10,6) AS vessel_length_m, round(heat*0.95,6) AS objectness_p, round(1-heat,6) AS is_vessel_p, round(coalesce(1/(1+exp(-(vv+20)*0.18)),0),6) AS is_fishing_p
 FROM px p JOIN sq ON sq.scene_id = p.scene_id AND sq.r = p.r AND sq.c = p.c WHERE heat = m AND heat*0.95 >= 0.3 AND p.scene_id IN (SELECT scene_id FROM gt_fx)""",
)
