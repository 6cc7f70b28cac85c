"""From scenes to detections in one plan: normalise, cut, score with models and flips, merge, suppress, decode."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.constants import NODATA, SCORE_FLOOR
from tidegrid.functions.geometry import INVERSE_MOVE
from tidegrid.functions.scalars import log_to_length, null_to_zero
from tidegrid.operators import patches as P
from tidegrid.plans.targets import best_peaks, detections
from tidegrid.sources.rasters import TILE_KEYS, align_channels, clean_pixels

Model = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
ACTIVATED = ("obj", "vsl", "fsh")


def normalised(tiles: DataFrame, normalise: Mapping[str, Callable[[Column], Column]], nodata: float = NODATA) -> DataFrame:
    """Tiles of the channels named, each pixel through its channel's function; missing pixels become 0."""
    wanted = tiles.filter(F.col("channel").isin(*normalise)).withColumn("pixels", clean_pixels(F.col("pixels"), nodata))
    def each(function: Callable[[Column], Column]) -> Column:
        return F.transform("pixels", lambda v: null_to_zero(function(v)))

    pixels = None
    for channel, function in normalise.items():
        own = each(function)
        here = F.col("channel") == channel
        pixels = F.when(here, own) if pixels is None else pixels.when(here, own)
    return wanted.withColumn("pixels", pixels)


def score_maps(aligned: DataFrame, channels: Sequence[str], models: Sequence[Model], variants: Sequence[str] = ("none",), activation: bool = False) -> DataFrame:
    """Maps of every tile, as tile rows with a channel for each map.

    A model gets a tile's channels as arrays and returns maps of the same size.  Flipped and rotated variants of the tile
    are scored, turned back and averaged in the task that holds the tile, as are the models; nothing is shuffled.
    """

    def one(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        h, w = next(iter(arrays.values())).shape
        for model in models:
            for variant in variants:
                # turning back by the inverse is the move itself
                moved = {c: P.turn_back(INVERSE_MOVE[variant], a, 0, 0, *moved_size(variant, h, w))[0] for c, a in arrays.items()}
                for name, out in model(moved).items():
                    back = P.turn_back(variant, out, 0, 0, h, w)[0]
                    back = 1.0 / (1.0 + np.exp(-back)) if activation and name in ACTIVATED else back
                    total[name] = total.get(name, 0.0) + back
        return {name: t / (len(models) * len(variants)) for name, t in total.items()}

    def run(batches):
        for batch in batches:
            def made():
                keys = list(zip(*(batch.column(n).to_pylist() for n in TILE_KEYS)))
                columns = [P.grids(batch, c) for c in channels]
                for (scene, r0, c0, h, w), *arrays in zip(keys, *columns):
                    for name, out in one(dict(zip(channels, arrays))).items():
                        yield scene, name, r0, c0, h, w, out

            yield from P.in_batches(made(), P.PATCH)

    return aligned.select(*TILE_KEYS, *channels).mapInArrow(run, P.PATCH)


def moved_size(variant: str, h: int, w: int) -> tuple[int, int]:
    return (w, h) if variant in P.TURNS_SIDEWAYS else (h, w)


def decode_patches(maps: DataFrame, side: int, max_objects: int | DataFrame = 2048, floor: float = SCORE_FLOOR, kernel: int = 3, stride: int = 1) -> DataFrame:
    """Patches of all maps to objects: maxima of ``obj`` above the floor, the other maps read at their pixels.

    Only maxima become rows; they look the other maps up in their own patch.
    """
    peaks = P.suppress(maps.filter("channel = 'obj'"), side, kernel)
    peaks = peaks.select("scene_id", "tile_row", "tile_col", "w", F.posexplode("pixels").alias("i", "obj")).filter(F.col("obj") >= floor)
    r = (F.col("tile_row") + F.floor(F.col("i") / F.col("w"))).cast("bigint")
    peaks = peaks.withColumns({"r": r, "c": (F.col("tile_col") + F.col("i") % F.col("w")).cast("bigint")})
    best = best_peaks(peaks, max_objects)
    others = ("vsl", "fsh", "len_log", "off_x", "off_y")
    value = F.element_at("pixels", F.col("i") + 1)
    read = [F.max(F.when(F.col("channel") == n, value)).alias(n) for n in others]
    there = maps.filter(F.col("channel").isin(*others)).select("scene_id", "tile_row", "tile_col", "channel", "pixels")
    full = best.join(there, ["scene_id", "tile_row", "tile_col"], "left").groupBy("scene_id", "r", "c", "obj").agg(*read)
    x, y = (F.col(at) + F.coalesce(F.col(off), F.lit(0.0)) for at, off in (("c", "off_x"), ("r", "off_y")))
    return full.select(
        "scene_id",
        (x * stride).alias("x"),
        (y * stride).alias("y"),
        log_to_length(F.col("len_log")).alias("length_px"),
        F.col("obj").alias("objectness_p"),
        F.col("vsl").alias("is_vessel_p"),
        F.col("fsh").alias("is_fishing_p"),
    )


def detect_scenes(
    tiles: DataFrame,
    normalise: Mapping[str, Callable[[Column], Column]],
    models: Sequence[Model],
    tile: int = 2048,
    step: int = 1536,
    variants: Sequence[str] = ("none", "fliplr"),
    activation: bool = False,
    max_objects: int | DataFrame = 2048,
    floor: float = SCORE_FLOOR,
    kernel: int = 3,
) -> DataFrame:
    """Detections of all scenes in ``tiles`` (``scene_id, channel, tile_row, tile_col, h, w, pixels``).

    Scenes with output are left out beforehand with ``sinks.pending_scenes``; the result goes to
    ``sinks.write_per_scene``.  ``normalise`` names the channels in the order of the models' input.
    """
    channels = list(normalise)
    cut = P.cut_tiles(normalised(tiles, normalise), tile, step)
    maps = score_maps(align_channels(cut, channels), channels, models, variants, activation)
    side = int(np.gcd(tile, step))
    return detections(decode_patches(P.merge(maps, tile, step), side, max_objects, floor, kernel), floor)
