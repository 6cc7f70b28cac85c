"""Raster scenes as tables of tiles: windows, channels, coarse layers.

A tile row holds ``scene_id, channel, tile_row, tile_col, h, w, pixels`` with the pixels
row by row.  Tiles stay arrays as long as possible; a pixel gets its own row only
after a filter or for the coarse-layer joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schemas
from tidegrid.constants import NODATA

TILE_KEYS = ("scene_id", "tile_row", "tile_col", "h", "w")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Parquet by scene, sorted inside so that row groups can be skipped by position."""
    laid = tiles.repartition("scene_id", "tile_row").sortWithinPartitions("scene_id", "tile_row", "tile_col")
    laid.write.mode("overwrite").partitionBy("scene_id").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TILES.replace("ARRAY<FLOAT>", "ARRAY<DOUBLE>")).parquet(path)


def window(tiles: DataFrame, tile: int, r0: int, r1: int, c0: int, c1: int, scene_id: str | None = None) -> DataFrame:
    """The part of a scene inside ``[r0, r1) x [c0, c1)``, as tiles cut at its edges.

    The bounds on ``tile_row`` and ``tile_col`` are plain comparisons with literals, so
    partitions and row groups outside the window are not read.  ``tile`` is the tile size.
    """
    if scene_id is not None:
        tiles = tiles.filter(F.col("scene_id") == scene_id)
    row, col = F.col("tile_row"), F.col("tile_col")
    near = tiles.filter((row > r0 - tile) & (row < r1) & (col > c0 - tile) & (col < c1))
    y0, y1 = F.greatest(r0 - row, F.lit(0)), F.least(r1 - row, F.col("h"))
    x0, x1 = F.greatest(c0 - col, F.lit(0)), F.least(c1 - col, F.col("w"))
    cut = near.withColumns({"_y0": y0, "_y1": y1, "_x0": x0, "_x1": x1, "_w": F.col("w")}).filter("_y1 > _y0 AND _x1 > _x0")
    # Spark may test the array before the filter above, so its bounds must hold for every tile
    width = F.greatest(F.col("_x1") - F.col("_x0"), F.lit(0))
    lines = F.transform(
        F.sequence(F.col("_y0"), F.greatest(F.col("_y1") - 1, F.col("_y0"))),
        lambda y: F.slice("pixels", y * F.col("_w") + F.col("_x0") + 1, width),
    )
    return cut.select(
        "scene_id",
        "channel",
        (row + F.col("_y0")).alias("tile_row"),
        (col + F.col("_x0")).alias("tile_col"),
        (F.col("_y1") - F.col("_y0")).alias("h"),
        (F.col("_x1") - F.col("_x0")).alias("w"),
        F.flatten(lines).alias("pixels"),
    )


def clean_pixels(pixels: Column, nodata: float = NODATA) -> Column:
    """No-data values of an array become NULL."""
    return F.transform(pixels, lambda v: F.when((v != nodata) & ~F.isnan(v), v))


def align_channels(tiles: DataFrame, channels: Sequence[str], nodata: float = NODATA) -> DataFrame:
    """One row per tile with a column of pixels per channel; tiles missing a channel are dropped."""
    wanted = tiles.filter(F.col("channel").isin(*channels))
    picked = [F.first(F.when(F.col("channel") == ch, F.col("pixels")), ignorenulls=True).alias(ch) for ch in channels]
    joined = wanted.groupBy(*TILE_KEYS).agg(*picked).dropna(subset=list(channels))
    return joined.withColumns({ch: clean_pixels(F.col(ch), nodata) for ch in channels})


def stack_channels(aligned: DataFrame, order: Sequence[str]) -> DataFrame:
    """Channels of each pixel together, in the given order."""
    zipped = F.arrays_zip(*[F.col(ch).alias(f"ch{i}") for i, ch in enumerate(order)])
    stacked = F.transform(zipped, lambda z: F.array(*[z[f"ch{i}"] for i in range(len(order))]))
    return aligned.select(*TILE_KEYS, stacked.alias("stacked"))


def tiles_from_pixels(pixels: DataFrame, tile: int, channels: dict[str, Column]) -> DataFrame:
    """Dense pixels ``scene_id, r, c, ...`` to tile rows; a tile's pixels meet in one row, sorted by place.

    A tile covers the rows and columns it has pixels of.
    """
    r, c = F.col("r"), F.col("c")
    entries = F.array(*[F.struct(F.lit(n).alias("channel"), v.cast("double").alias("v")) for n, v in channels.items()])
    long = pixels.select(
        "scene_id",
        F.floor(r / tile).cast("int").alias("_i"),
        F.floor(c / tile).cast("int").alias("_j"),
        r.cast("int").alias("y"),
        c.cast("int").alias("x"),
        F.explode(entries).alias("e"),
    )
    item = F.struct("y", "x", F.col("e.v").alias("v"))
    sides = [(F.max(k) - F.min(k) + 1).alias(n) for k, n in (("y", "h"), ("x", "w"))]
    grouped = long.groupBy("scene_id", F.col("e.channel").alias("channel"), "_i", "_j").agg(
        F.min("y").alias("tile_row"), F.min("x").alias("tile_col"), *sides, F.array_sort(F.collect_list(item)).alias("items")
    )
    return grouped.withColumn("pixels", F.transform("items", lambda i: i["v"])).drop("items", "_i", "_j")


def pixels_of(tiles: DataFrame) -> DataFrame:
    """Tile rows to pixel rows ``scene_id, channel, r, c, v``."""
    flat = tiles.select("scene_id", "channel", "tile_row", "tile_col", "w", F.posexplode("pixels").alias("i", "v"))
    r = (F.col("tile_row") + F.floor(F.col("i") / F.col("w"))).cast("bigint")
    c = (F.col("tile_col") + F.col("i") % F.col("w")).cast("bigint")
    return flat.select("scene_id", "channel", r.alias("r"), c.alias("c"), "v")


def upsample_nearest(fine: DataFrame, coarse: DataFrame, factor: int, values: Sequence[str]) -> DataFrame:
    """Give each fine pixel (``r, c``) the value of its coarse cell (``ar, ac``); outside the layer it is NULL."""
    keyed = fine.withColumns(
        {"ar": F.floor(F.col("r") / factor).cast("bigint"), "ac": F.floor(F.col("c") / factor).cast("bigint")}
    )
    return keyed.join(coarse.select("scene_id", "ar", "ac", *values), ["scene_id", "ar", "ac"], "left").drop("ar", "ac")


def upsample_bilinear(fine: DataFrame, coarse: DataFrame, factor: int, values: Sequence[str]) -> DataFrame:
    """Weighted mean of the four coarse cells around each fine pixel; missing cells are left out of the mean.

    One coarse lookup per fine pixel: every coarse cell first collects its right and
    lower neighbours (the coarse layer is tiny next to the fine one).
    """
    around = coarse.select("scene_id", "ar", "ac", F.struct(*values).alias("_v"))
    spread = None
    for name, dr, dc in (("v00", 0, 0), ("v01", 0, 1), ("v10", 1, 0), ("v11", 1, 1)):
        part = around.select(
            "scene_id", (F.col("ar") - dr).alias("ar"), (F.col("ac") - dc).alias("ac"), F.lit(name).alias("_n"), "_v"
        )
        spread = part if spread is None else spread.unionByName(part)
    corner = {n: F.first(F.when(F.col("_n") == n, F.col("_v")), ignorenulls=True).alias(n) for n in ("v00", "v01", "v10", "v11")}
    corners = spread.groupBy("scene_id", "ar", "ac").agg(*corner.values())
    y, x = F.col("r") / F.lit(float(factor)), F.col("c") / F.lit(float(factor))
    keyed = fine.withColumns({"ar": F.floor(y).cast("bigint"), "ac": F.floor(x).cast("bigint")})
    joined = keyed.join(corners, ["scene_id", "ar", "ac"], "left")
    fy, fx = y - F.col("ar"), x - F.col("ac")
    weights = {"v00": (1 - fy) * (1 - fx), "v01": (1 - fy) * fx, "v10": fy * (1 - fx), "v11": fy * fx}

    def mean(value: str) -> Column:
        top, bottom = F.lit(0.0), F.lit(0.0)
        for n, w in weights.items():
            v = F.col(n)[value]
            top = top + F.coalesce(w * v, F.lit(0.0))
            bottom = bottom + F.when(v.isNotNull(), w).otherwise(0.0)
        return F.try_divide(top, bottom)

    return joined.withColumns({v: mean(v) for v in values}).drop("ar", "ac", *weights)


def surface_classes(code: Column) -> dict[str, Column]:
    """Water, land and ice flags of a mask code."""
    return {
        "water": F.coalesce(code == 0, F.lit(False)).cast("double"),
        "land": F.coalesce(code.isin(1, 5), F.lit(False)).cast("double"),
        "ice": F.coalesce(code.isin(2, 6), F.lit(False)).cast("double"),
    }
