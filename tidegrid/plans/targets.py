"""Objects to target maps, and maps back to detections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.constants import IGNORE_LABEL, PIX_TO_M, SCORE_FLOOR
from tidegrid.functions.labels import confidence_rank
from tidegrid.functions.scalars import DOUBLE_EPS, length_to_log, log_to_length, null_to_zero, sigmoid
from tidegrid.operators.heatmap import PIXEL, local_maxima_sparse
from tidegrid.operators.ranking import top_k, top_k_by
from tidegrid.operators.spatial import cell_of


def drawing_order(id_column: str = "detect_id") -> Column:
    """LOW, MEDIUM, HIGH, each from long to short; the last writer is the largest."""
    return F.struct(
        confidence_rank(F.col("confidence")).alias("rank"), (-F.col("length_px")).alias("neg"), F.col(id_column).alias("id")
    )


def place_objects(objects: DataFrame, stride: int, fixed_radius: int | None = None, labels_radius: int | None = None) -> DataFrame:
    """Centre pixel on the output grid (``oy, ox``), sub-pixel rest, and radii.

    ``objects`` hold ``x, y`` in pixels and ``length_px``.
    """
    sx, sy = F.col("x") / F.lit(float(stride)), F.col("y") / F.lit(float(stride))
    by_length = F.greatest(F.lit(2), F.ceil(F.col("length_px") / F.lit(float(stride)) * 0.5)).cast("int")
    radius = F.lit(fixed_radius) if fixed_radius else by_length
    return objects.withColumns(
        {
            "ox": sx.cast("bigint"),
            "oy": sy.cast("bigint"),
            "off_x": sx - sx.cast("bigint"),
            "off_y": sy - sy.cast("bigint"),
            "radius": radius.cast("int"),
            "label_radius": (F.lit(labels_radius) if labels_radius else radius).cast("int"),
        }
    )


def encode_targets(
    objects: DataFrame,
    height: int,
    width: int,
    stride: int,
    labels: str = "circle",
    fixed_radius: int | None = None,
    labels_radius: int | None = None,
    ignore_value: int = IGNORE_LABEL,
    ignore_low: bool = False,
) -> DataFrame:
    """Target maps of the objects of each scene, as their non-empty pixels.

    ``objects`` hold ``scene_id, detect_id, x, y, confidence, is_vessel, is_fishing``
    (codes 0, 1, 255) and ``length_px``.  Objects of one centre and size are put together,
    with the last writer among them, and go to the blocks of the map they reach; a block
    draws its own pixels.  What is shuffled are objects, not their pixels, and a block is
    bounded by its pixels however many objects lie on it.
    """
    if labels not in ("circle", "point"):
        raise ValueError(f"labels must be 'circle' or 'point', not {labels!r}")
    circle, rows, cols = labels == "circle", height // stride, width // stride
    values = {
        "vsl": F.col("is_vessel").cast("double"),
        "fsh": F.col("is_fishing").cast("double"),
        "len_log": length_to_log(F.col("length_px")).cast("double"),
    }
    placed = place_objects(objects, stride, fixed_radius, labels_radius).withColumns(values)
    ignored = F.coalesce(F.col("confidence") == "LOW", F.lit(False)) if ignore_low else F.lit(False)
    # circles show the largest values, points those of the last writer; of one id, classes decide who that is
    drawn, last_drawn = (list(values), []) if circle else ([], list(values))
    written = F.struct(drawing_order().alias("o"), *(last_drawn or ("vsl", "fsh")), "off_x", "off_y")
    kinds = placed.groupBy("scene_id", "oy", "ox", "radius", "label_radius", ignored.alias("ignored")).agg(
        F.max(written).alias("w"), *[F.max(n).alias(n) for n in drawn]
    )
    last = {"w_rank": F.coalesce("w.o.rank", F.lit(-1)), "w_neg": F.col("w.o.neg").cast("double"), "w_id": F.col("w.o.id").cast("bigint")}
    last |= {"w_" + n: F.col("w." + n) for n in (*last_drawn, "off_x", "off_y")}
    kinds = kinds.withColumns(last).drop("w")
    reach = F.greatest("radius", "label_radius") if circle else F.col("radius")
    for axis, centre, size in (("block_r", "oy", rows), ("block_c", "ox", cols)):
        lo, hi = F.greatest(F.col(centre) - reach, F.lit(0)), F.least(F.col(centre) + reach, F.lit(size - 1))
        reached = F.when(lo <= hi, F.sequence(cell_of(lo, MAP_BLOCK), cell_of(hi, MAP_BLOCK)))
        kinds = kinds.withColumn(axis, F.explode(reached))
    draw = _draw_block(rows, cols, circle, float(ignore_value))
    return kinds.groupBy("scene_id", "block_r", "block_c").applyInArrow(
        draw, "scene_id STRING, r BIGINT, c BIGINT, obj DOUBLE, vsl DOUBLE, fsh DOUBLE, len_log DOUBLE, off_x DOUBLE, off_y DOUBLE"
    )


# side of the blocks of a map that are drawn by one task
MAP_BLOCK = 256
# pixels a block draws at once
DRAWN = 1 << 20


def _draw_block(rows: int, cols: int, circle: bool, ignore_value: float):
    """Draw the objects that reach one block; where they overlap the largest value wins."""

    def offsets(reach: int) -> tuple[np.ndarray, np.ndarray]:
        dy, dx = np.mgrid[-reach : reach + 1, -reach : reach + 1]
        return dy.ravel(), dx.ravel()

    def draw(table: pa.Table) -> pa.Table:
        nothing = -np.inf  # below every value, and NULL where no value came
        by = {n: table[n].to_numpy() for n in ("oy", "ox", "radius", "label_radius", "ignored", "w_rank", "w_id")}
        value = {n: table[n].fill_null(nothing).to_numpy() for n in table.column_names if pa.types.is_float64(table[n].type)}
        r0, c0 = table["block_r"][0].as_py() * MAP_BLOCK, table["block_c"][0].as_py() * MAP_BLOCK
        h, w = min(MAP_BLOCK, rows - r0), min(MAP_BLOCK, cols - c0)
        classes, every = ("vsl", "fsh", "len_log"), ("obj", "vsl", "fsh", "len_log", "off_x", "off_y")
        grid = {n: np.full(h * w, nothing) for n in every}
        sizes, kind = np.unique(np.stack([by["radius"], by["label_radius"], by["ignored"]]), axis=1, return_inverse=True)
        for i, (radius, label_radius, ignored) in enumerate(sizes.T.tolist()):
            of = np.flatnonzero(kind.ravel() == i)
            dy, dx = offsets(max(radius, label_radius) if circle else radius)
            d2 = dy * dy + dx * dx
            if ignored:
                heat = np.where(d2 <= radius * radius, ignore_value, 0.0)
            else:
                sigma = (radius * 2 + 1) / 6.0
                heat = np.exp(-d2 / (2.0 * sigma * sigma))
                heat[(heat < DOUBLE_EPS) | (np.maximum(np.abs(dy), np.abs(dx)) > radius)] = 0.0
            for some in np.array_split(of, -(-len(of) * len(d2) // DRAWN)):
                r, c = by["oy"][some, None] + dy - r0, by["ox"][some, None] + dx - c0
                inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
                at = (r * w + c)[inside]
                np.maximum.at(grid["obj"], at, np.broadcast_to(heat, inside.shape)[inside])
                for n in classes:
                    drawn = np.where(d2 <= label_radius * label_radius, value[n][some, None], 0.0)[inside] if circle else 0.0
                    np.maximum.at(grid[n], at, drawn)
        touched = grid["obj"] > nothing
        for n in ("off_x", "off_y"):
            grid[n][touched] = 0.0
        order = np.lexsort((by["w_id"], value["w_neg"], by["w_rank"], by["ox"], by["oy"]))
        y, x = by["oy"][order], by["ox"][order]
        end = np.r_[(np.diff(y) != 0) | (np.diff(x) != 0), True]
        end &= (y >= r0) & (y < r0 + h) & (x >= c0) & (x < c0 + w)
        at = (y[end] - r0) * w + x[end] - c0
        for n in ("off_x", "off_y") if circle else (*classes, "off_x", "off_y"):
            grid[n][at] = np.maximum(grid[n][at], value["w_" + n][order[end]])
        some = np.flatnonzero((grid["obj"] > 0) | (grid["vsl"] > 0) | (grid["fsh"] > 0) | (grid["len_log"] > 0))
        scene = pa.repeat(table["scene_id"][0], len(some))
        arrays = [scene.cast(pa.string()), pa.array(some // w + r0, pa.int64()), pa.array(some % w + c0, pa.int64())]
        arrays += [pa.array(grid[n][some], pa.float64(), mask=np.isneginf(grid[n][some])) for n in every]
        return pa.table(arrays, names=[*PIXEL, *every])

    return draw


def decode_maps(
    maps: DataFrame,
    stride: int = 1,
    max_objects: int | DataFrame = 2048,
    floor: float = SCORE_FLOOR,
    kernel: int = 3,
    activation: bool = False,
    offsets: bool = True,
) -> DataFrame:
    """Maps to objects: local maxima above the floor, the best ``max_objects`` per scene.

    ``max_objects`` is a number for all scenes or a table ``scene_id, max_objects`` (see ``limits_per_scene``).
    The floor comes first: a pixel that suppresses another one is itself above it.  All
    maps share a row per pixel, so reading them at the maxima costs nothing.
    """

    def score(name: str) -> Column:
        raw = sigmoid(F.col(name)) if activation else F.col(name)
        return null_to_zero(raw)

    scored = maps.withColumns({n: score(n) for n in ("obj", "vsl", "fsh")}).filter(F.col("obj") >= floor)
    peaks = local_maxima_sparse(scored, "obj", kernel)
    best = best_peaks(peaks, max_objects)
    if offsets:
        shift_x, shift_y = F.coalesce("off_x", F.lit(0.0)), F.coalesce("off_y", F.lit(0.0))
    else:
        shift_x = shift_y = F.lit(0.0 if stride == 1 else 0.5)
    return best.select(
        "scene_id",
        ((F.col("c") + shift_x) * stride).alias("x"),
        ((F.col("r") + shift_y) * stride).alias("y"),
        log_to_length(F.col("len_log")).alias("length_px"),
        F.col("obj").alias("objectness_p"),
        F.col("vsl").alias("is_vessel_p"),
        F.col("fsh").alias("is_fishing_p"),
    )


def best_peaks(peaks: DataFrame, max_objects: int | DataFrame) -> DataFrame:
    """The highest peaks (``obj``) of each scene; equal ones by row and column."""
    place = [F.col("r"), F.col("c")]
    if isinstance(max_objects, DataFrame):
        return top_k_by(peaks, max_objects, "scene_id", "max_objects", "obj", place)
    return top_k(peaks, max_objects, ["scene_id"], [F.desc("obj"), *place])


def detections(objects: DataFrame, floor: float = SCORE_FLOOR, row0: Column | None = None, col0: Column | None = None) -> DataFrame:
    """Detection rows: whole pixels (towards zero), metres, and the floor used; crops add their origin."""
    row0, col0 = (F.lit(0) if v is None else v for v in (row0, col0))
    return objects.filter(F.col("objectness_p") >= floor).select(
        (F.col("length_px") * PIX_TO_M).alias("vessel_length_m"),
        (F.col("y") + row0).cast("bigint").alias("detect_scene_row"),
        (F.col("x") + col0).cast("bigint").alias("detect_scene_column"),
        "scene_id",
        "objectness_p",
        "is_vessel_p",
        "is_fishing_p",
        F.lit(float(floor)).alias("objectness_threshold"),
    )


def adaptive_limit(counts: DataFrame) -> DataFrame:
    """Number of objects to decode: twice the largest label count, within 128 .. 2048."""
    most = F.coalesce(F.max("n"), F.lit(0))
    return counts.agg(F.least(F.lit(2048), F.greatest(F.lit(128), most * 2)).cast("bigint").alias("max_objects"))


def limits_per_scene(labels: DataFrame, least: int = 128, most: int = 2048) -> DataFrame:
    """``scene_id, max_objects``: twice the labels of each scene, within ``least .. most``."""
    counts = labels.groupBy("scene_id").agg(F.count("*").alias("n"))
    return counts.select("scene_id", F.least(F.lit(most), F.greatest(F.lit(least), F.col("n") * 2)).cast("bigint").alias("max_objects"))
