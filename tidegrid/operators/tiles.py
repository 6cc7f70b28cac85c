"""Cutting scenes into tiles and merging overlapping tiles, models and test-time variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.geometry import move_back
from tidegrid.functions.scalars import sigmoid


def regular_crops(scenes: DataFrame, tile: int, step: int) -> DataFrame:
    """Whole tiles of each scene (``scene_id, scene_rows, scene_cols``); a remainder is dropped."""
    fits = scenes.filter((F.col("scene_rows") >= tile) & (F.col("scene_cols") >= tile))
    rows = fits.withColumn("r0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("scene_rows") - tile, F.lit(step).cast("bigint"))))
    cells = rows.withColumn("c0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("scene_cols") - tile, F.lit(step).cast("bigint"))))
    return cells.select("scene_id", "r0", (F.col("r0") + tile).alias("r1"), "c0", (F.col("c0") + tile).alias("c1"))


def padded_size(size: Column, divisor: int) -> Column:
    return (F.ceil(size / F.lit(divisor)) * divisor).cast("bigint")


def overlapping_tiles(scenes: DataFrame, tile: int, step: int) -> DataFrame:
    """Overlapping tiles over a scene padded at its right and bottom to a multiple of the tile.

    The scene stays top left.  Tiles start at multiples of the step as long as they fit.
    """
    padded = scenes.withColumns(
        {"pad_rows": padded_size(F.col("scene_rows"), tile), "pad_cols": padded_size(F.col("scene_cols"), tile)}
    )
    zero, stride = F.lit(0).cast("bigint"), F.lit(step).cast("bigint")
    rows = padded.withColumn("r0", F.explode(F.sequence(zero, F.col("pad_rows") - tile, stride)))
    cells = rows.withColumn("c0", F.explode(F.sequence(zero, F.col("pad_cols") - tile, stride)))
    return cells.select("scene_id", "pad_rows", "pad_cols", "r0", "c0")


def prediction_cut(tiles: DataFrame, tile: int, stride: int) -> DataFrame:
    """The cut of the prediction grid that belongs to each image tile."""
    return tiles.withColumns(
        {"pred_r0": F.col("r0") / stride, "pred_c0": F.col("c0") / stride, "pred_size": F.lit(tile // stride)}
    ).withColumns({"pred_r0": F.col("pred_r0").cast("bigint"), "pred_c0": F.col("pred_c0").cast("bigint")})


def chips(pixels: DataFrame, size: int, value: str) -> DataFrame:
    """Number each pixel by the chip it falls in; ``value`` of the padding would be 0, so no row is needed for it."""
    r, c = F.col("r"), F.col("c")
    return pixels.select(
        "scene_id",
        F.floor(r / size).cast("bigint").alias("chip_row"),
        F.floor(c / size).cast("bigint").alias("chip_col"),
        (r % size).alias("in_row"),
        (c % size).alias("in_col"),
        value,
    )


def cut_tiles(pixels: DataFrame, tile: int, step: int, value: str) -> DataFrame:
    """Pixels of overlapping tiles: each pixel goes to every tile that covers it, with its place inside.

    Tiles start at multiples of ``step``; a pixel meets ``ceil(tile/step)^2`` of them at most.
    """

    def firsts(x: Column) -> Column:
        low = F.greatest(F.floor((x - tile) / F.lit(float(step))) + 1, F.lit(0))
        return F.sequence(low.cast("bigint"), F.floor(x / F.lit(float(step))).cast("bigint"))

    keyed = pixels.withColumn("ti", F.explode(firsts(F.col("r")))).withColumn("tj", F.explode(firsts(F.col("c"))))
    return keyed.select(
        "scene_id",
        (F.col("ti") * step).alias("r0"),
        (F.col("tj") * step).alias("c0"),
        (F.col("r") - F.col("ti") * step).alias("y"),
        (F.col("c") - F.col("tj") * step).alias("x"),
        value,
    )


def drop_empty_tiles(tile_pixels: DataFrame, value: str) -> DataFrame:
    """Tiles with at least one pixel other than 0, as ``scene_id, r0, c0``; missing pixels count as 0."""
    signal = F.bool_or(F.coalesce(F.col(value), F.lit(0.0)) != 0)
    return tile_pixels.groupBy("scene_id", "r0", "c0").agg(signal.alias("s")).filter("s").drop("s")


def drop_blank_crops(tile_pixels: DataFrame, value: str, most_missing: float = 0.8) -> DataFrame:
    """Crops whose share of missing pixels is not above the limit."""
    share = F.avg(F.col(value).isNull().cast("double"))
    return tile_pixels.groupBy("scene_id", "r0", "c0").agg(share.alias("missing")).filter(F.col("missing") <= most_missing)


def pyramid_weight(y: Column, x: Column, height: int, width: int) -> Column:
    """Weight of a pixel inside its tile: edge distance over edge plus centre distance."""
    py, px = y + F.lit(0.5), x + F.lit(0.5)
    dy, dx = py - F.lit(height / 2.0), px - F.lit(width / 2.0)
    centre = F.sqrt(dy * dy + dx * dx)

    def to_edge(p: Column, size: int) -> Column:
        near = F.least(p, F.lit(float(size)) - p)
        return F.sqrt(near * near + F.lit(0.25))

    edge = F.least(to_edge(py, height), to_edge(px, width))
    return edge / (edge + centre)


def explode_tiles(tiles: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Tile rows ``scene_id, r0, c0, w, pixels`` (row-major array) to pixel rows with their place inside."""
    flat = tiles.select("scene_id", "r0", "c0", "w", F.posexplode(pixels).alias("i", "v"))
    y, x = F.floor(F.col("i") / F.col("w")).cast("bigint"), (F.col("i") % F.col("w")).cast("bigint")
    return flat.select("scene_id", "r0", "c0", y.alias("y"), x.alias("x"), "v")


def merge_tiles(tile_pixels: DataFrame, values: Sequence[str], weight: Column) -> DataFrame:
    """Weighted mean of overlapping tile pixels; one shuffle on the pixel, summed map-side first."""
    r, c = (F.col("r0") + F.col("y")).alias("r"), (F.col("c0") + F.col("x")).alias("c")
    placed = tile_pixels.select("scene_id", r, c, weight.alias("_w"), *values)
    total = F.sum("_w")
    return placed.groupBy("scene_id", "r", "c").agg(*[(F.sum(F.col("_w") * F.col(v)) / total).alias(v) for v in values])


def ensemble_mean(models: DataFrame, values: Sequence[str], activation: str | None = "after_model") -> DataFrame:
    """Mean over models per pixel, with the sigmoid before or after it."""
    if activation not in (None, "after_model", "after_ensemble", "after_tta"):
        raise ValueError(f"unknown activation place {activation!r}")
    before = sigmoid if activation == "after_model" else (lambda v: v)
    after = sigmoid if activation in ("after_ensemble", "after_tta") else (lambda v: v)
    return models.groupBy("scene_id", "r", "c").agg(*[after(F.avg(before(F.col(v)))).alias(v) for v in values])


def average_same_grid(models: DataFrame, keys: Sequence[str], pixels: str = "pixels") -> DataFrame:
    """Mean of models whose tiles share a grid, element by element on the tile arrays.

    Nothing is unfolded to pixels: the number of models is small, so a tile's
    arrays meet in one row and are added with ``zip_with``.
    """
    stacked = models.groupBy(*keys).agg(F.collect_list(pixels).alias("_all"))
    size = F.size("_all")
    zeros = F.transform(F.element_at("_all", 1), lambda _: F.lit(0.0).cast("double"))
    total = F.aggregate("_all", zeros, lambda acc, one: F.zip_with(acc, one, lambda a, b: a + b))
    return stacked.select(*keys, F.transform(total, lambda v: v / size).alias(pixels))


def undo_variants(maps: DataFrame, height: int, width: int, values: Sequence[str], reduction: str = "mean", mirror_offsets: bool = False) -> DataFrame:
    """Turn the maps of flipped or rotated inputs back and average (or add) them per pixel.

    ``maps`` hold ``scene_id, variant, r, c``.  Offsets keep their sign unless ``mirror_offsets``.
    """
    r, c = move_back(F.col("variant"), F.col("r"), F.col("c"), height, width)
    turned = maps.withColumns({"_r": r, "_c": c})
    if mirror_offsets:
        flips_x, flips_y = F.col("variant").isin("fliplr", "rot180"), F.col("variant").isin("flipud", "rot180")
        signs = {"off_x": flips_x, "off_y": flips_y}
        turned = turned.withColumns({n: F.when(s, -F.col(n)).otherwise(F.col(n)) for n, s in signs.items() if n in values})
    reduce = F.avg if reduction == "mean" else F.sum
    return turned.groupBy("scene_id", F.col("_r").alias("r"), F.col("_c").alias("c")).agg(*[reduce(v).alias(v) for v in values])


def undo_scales(maps: DataFrame, scenes: DataFrame, value: str, axis: str = "rows", reduction: str = "mean") -> DataFrame:
    """Bring size maps of rescaled inputs back to the base grid and average them.

    ``maps`` hold ``scene_id, scale_offset, r, c``; a map of offset ``o`` has ``o`` more
    rows and columns than its scene (``scene_rows, scene_cols``).  The nearest
    cell is taken and the value scaled by the size ratio of ``axis``.
    """
    offsets = maps.select("scene_id", "scale_offset").distinct().join(scenes.select("scene_id", "scene_rows", "scene_cols"), "scene_id")
    grid = offsets.withColumn("tr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("scene_rows") - 1)))
    grid = grid.withColumn("tc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("scene_cols") - 1)))
    more_r, more_c = F.col("scene_rows") + F.col("scale_offset"), F.col("scene_cols") + F.col("scale_offset")
    grid = grid.withColumns(
        {
            "r": F.floor(F.col("tr") * more_r / F.col("scene_rows")).cast("bigint"),
            "c": F.floor(F.col("tc") * more_c / F.col("scene_cols")).cast("bigint"),
            "ratio": (F.col("scene_rows") / more_r) if axis == "rows" else (F.col("scene_cols") / more_c),
        }
    )
    reduce = F.avg if reduction == "mean" else F.sum
    joined = grid.join(maps, ["scene_id", "scale_offset", "r", "c"])
    return joined.groupBy("scene_id", F.col("tr").alias("r"), F.col("tc").alias("c")).agg(
        reduce(F.col(value) * F.col("ratio")).alias(value)
    )


def overview(pixels: DataFrame, value: str, factor: int = 4) -> DataFrame:
    """Mean of each block of pixels."""
    r, c = F.floor(F.col("r") / factor).cast("bigint"), F.floor(F.col("c") / factor).cast("bigint")
    return pixels.groupBy("scene_id", r.alias("r"), c.alias("c")).agg(F.avg(value).alias(value))


def grey_composite(pixels: DataFrame, vv: str, vh: str) -> DataFrame:
    """Mean of two bands stretched to 0..255 per scene; missing pixels are 0.

    The range comes from a small table of one row per scene joined back, so a scene's pixels never
    have to meet in one task.
    """
    mixed = pixels.withColumn("_m", (F.col(vv) + F.col(vh)) / 2.0)
    ends = mixed.groupBy("scene_id").agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col("_m") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255.0, F.lit(0.0))
    return mixed.join(ends, "scene_id").select("scene_id", "r", "c", F.round(scaled).cast("bigint").alias("grey"))


def score_tiles(tiles: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Run a user's model over tiles; ``scorer`` maps batches of tile frames to batches of map frames."""
    return tiles.mapInPandas(scorer, schema)
