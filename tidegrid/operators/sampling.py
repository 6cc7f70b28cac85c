"""Weighted draws, crops around objects, and training-sample tables.

Every random number is a hash of a seed and a key, so a result does not depend on
partitioning, retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.labels import folder_weight, unknown_to_code
from tidegrid.functions.scalars import normal_hash, uniform_hash
from tidegrid.operators.ranking import chunked_rank, chunked_running_sum, first_by, hash_chunk
from tidegrid.operators.spatial import cell_of, points_in_crops, repeated, with_cell
from tidegrid.session import cut_lineage


def capped_normal(lo: float, hi: float, *keys: Column) -> Column:
    """Normal number around the middle of ``[lo, hi]`` with variance ``hi - lo``, clipped to the range."""
    x = F.lit((lo + hi) * 0.5) + F.lit((hi - lo) ** 0.5) * normal_hash(*keys)
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def weighted_draws(items: DataFrame, item_id: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` picks with replacement, each item in proportion to its weight: ``draw, item_id``.

    The items are laid end to end on a line as long as the total weight (running sums by
    chunk).  Each draw is a uniform point on the line.  Line and points are cut
    into as many strips as there are draws, so the range join is an equality on
    the strip with about one draw per strip.
    """
    spark = items.sparkSession
    live = items.select(item_id, F.col(weight).cast("double").alias("_w")).filter("_w > 0")
    laid = chunked_running_sum(live, F.col("_w"), [F.col(item_id)], hash_chunk(F.col(item_id)), "_hi")
    laid = laid.withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = live.agg(F.sum("_w")).scalar()
    strips = max(1, draws)
    width = F.col("_total") / F.lit(float(strips))
    laid = laid.withColumn("_total", total)
    first = F.floor(F.col("_lo") / width).cast("bigint")
    last = F.least(F.floor(F.col("_hi") / width), F.lit(strips)).cast("bigint")
    laid = laid.withColumn("_strip", F.explode(F.sequence(F.least(first, last), last)))
    points = spark.range(draws).select(F.col("id").alias("draw"), uniform_hash(F.lit(seed), F.col("id")).alias("_u"))
    points = points.withColumn("_strip", F.floor(F.col("_u") * strips).cast("bigint"))
    # neighbours meet at a rounded boundary: take the last item that starts at or before the point
    hit = points.join(repeated(laid), "_strip").filter(F.col("_u") * F.col("_total") >= F.col("_lo"))
    best = hit.groupBy("draw").agg(F.max_by(item_id, F.struct("_lo", item_id)).alias(item_id))
    return best


def crop_around(df: DataFrame, row: Column, col: Column, crop_h: int, crop_w: int, dx: Column, dy: Column) -> DataFrame:
    """Crop with the object near its middle, moved by the jitter (``dx`` along rows), kept inside the scene.

    ``df`` holds ``scene_rows, scene_cols``.
    """
    r0 = F.greatest(F.lit(0), row + dx - crop_h // 2).cast("bigint")
    c0 = F.greatest(F.lit(0), col + dy - crop_w // 2).cast("bigint")
    placed = df.withColumns({"r0": r0, "c0": c0})
    return placed.withColumns(
        {
            "r1": F.least(F.col("scene_rows"), F.col("r0") + crop_h).cast("bigint"),
            "c1": F.least(F.col("scene_cols"), F.col("c0") + crop_w).cast("bigint"),
        }
    )


def jitter(crop: int, *keys: Column) -> Column:
    """Whole-pixel jitter of a quarter of the crop to either side."""
    return capped_normal(float(-crop // 4), float(crop // 4), *keys).cast("bigint")


def mixed_crops(
    scenes: DataFrame,
    labels: DataFrame,
    shoreline: DataFrame,
    crops_per_scene: int,
    crop: int,
    object_share: float,
    seed: int,
    weight: str = "weight",
    attempt: int = 0,
    attempts: int = 1,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Crops of each scene: around an object with a given chance, else half near the shore, else anywhere.

    Objects are picked by weight, shoreline points evenly.  Picking the item with the
    smallest ``-ln(u)/w`` is a weighted choice, and a minimum needs no list of
    items in one place.  Each of the ``attempts`` numbers from
    ``attempt`` on gives another crop; ``samples`` (scene_id, sample_no) names those still
    wanted, all of them by default.  A scene whose objects all have weight 0 has no object crops.
    """
    wanted = scenes.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(crops_per_scene - 1))))
    wanted = wanted.withColumn("attempt", F.explode(F.sequence(F.lit(attempt), F.lit(attempt + attempts - 1))))
    if samples is not None:
        wanted = wanted.join(samples.select("scene_id", "sample_no"), ["scene_id", "sample_no"], "left_semi")
    key = [F.lit(seed), F.col("scene_id"), F.col("sample_no"), F.col("attempt")]
    has_labels = labels.filter(F.col(weight) > 0).groupBy("scene_id").agg(F.count("*").alias("n_labels"))
    has_shore = shoreline.groupBy("scene_id").agg(F.count("*").alias("n_points"))
    wanted = wanted.join(has_labels, "scene_id", "left").join(has_shore, "scene_id", "left")
    object_turn = F.col("n_labels").isNotNull() & (uniform_hash(*key, F.lit("object")) < object_share)
    shore_turn = F.col("n_points").isNotNull() & (uniform_hash(*key, F.lit("shore")) < 0.5)
    wanted = wanted.withColumn("source", F.when(object_turn, "object").when(shore_turn, "shore").otherwise("any"))
    wanted = wanted.drop("n_labels", "n_points")
    ids = ["scene_id", "sample_no", "attempt"]
    around_object = _numbered_pick(
        wanted.filter("source = 'object'"), labels, "detect_id", F.col(weight), ("detect_scene_row", "detect_scene_column"), seed
    )
    around_shore = _numbered_pick(
        wanted.filter("source = 'shore'"), shoreline, "point_id", F.lit(1.0), ("pt_row", "pt_col"), seed + 1
    )
    picked = around_object.unionByName(around_shore)
    moved = crop_around(
        picked, F.col("row"), F.col("col"), crop, crop, jitter(crop, *key, F.lit("dx")), jitter(crop, *key, F.lit("dy"))
    ).drop("row", "col")
    free_r = F.greatest(F.col("scene_rows") - crop, F.lit(0))
    free_c = F.greatest(F.col("scene_cols") - crop, F.lit(0))
    anywhere = wanted.filter("source = 'any'").withColumns(
        {
            "r0": F.floor(uniform_hash(*key, F.lit("r")) * (free_r + 1)).cast("bigint"),
            "c0": F.floor(uniform_hash(*key, F.lit("c")) * (free_c + 1)).cast("bigint"),
        }
    )
    anywhere = anywhere.withColumns({"r1": F.col("r0") + crop, "c1": F.col("c0") + crop})
    both = moved.unionByName(anywhere)
    return both.select(*ids, "source", "r0", "r1", "c0", "c1")


def _numbered_pick(wanted: DataFrame, items: DataFrame, item_id: str, weight: Column, at: tuple[str, str], seed: int) -> DataFrame:
    """Give each wanted crop one item of its scene by weight.

    The items of each scene lie end to end on a line of the scene's total weight; a draw is a point on
    it.  Both are cut into strips so that a busy scene's items never meet all its draws.
    """
    live = items.select("scene_id", item_id, F.col(at[0]).cast("bigint").alias("row"), F.col(at[1]).cast("bigint").alias("col"), weight.cast("double").alias("_w"))
    live = live.filter("_w > 0")
    totals = live.groupBy("scene_id").agg(F.sum("_w").alias("_total"), F.count("*").alias("_count"))
    laid = chunked_running_sum(live, F.col("_w"), [F.col(item_id)], hash_chunk(F.col(item_id), chunks=64), "_hi", ["scene_id"])
    laid = laid.join(totals, "scene_id").withColumn("_lo", F.col("_hi") - F.col("_w"))
    strip_width = F.col("_total") / F.col("_count")
    last = F.least(F.floor(F.col("_hi") / strip_width), F.col("_count")).cast("bigint")
    first = F.least(F.floor(F.col("_lo") / strip_width).cast("bigint"), last)
    laid = laid.withColumn("_strip", F.explode(F.sequence(first, last))).select("scene_id", "_strip", "_lo", item_id, "row", "col")
    u = uniform_hash(F.lit(seed), F.col("scene_id"), F.col("sample_no"), F.col("attempt"), F.lit("pick"))
    points = wanted.join(totals, "scene_id").withColumn("_u", u)
    points = points.withColumn("_strip", F.floor(F.col("_u") * F.col("_count")).cast("bigint"))
    hit = points.join(repeated(laid), ["scene_id", "_strip"]).filter(F.col("_u") * F.col("_total") >= F.col("_lo"))
    keys = wanted.columns
    best = hit.groupBy(*keys).agg(F.max_by(F.struct("row", "col"), F.struct("_lo", item_id)).alias("_b"))
    return best.select(*keys, "_b.row", "_b.col")


def crops_with_signal(
    scenes: DataFrame,
    labels: DataFrame,
    shoreline: DataFrame,
    pixels: DataFrame,
    value: str,
    crops_per_scene: int,
    crop: int,
    object_share: float,
    seed: int,
    most_missing: float = 0.8,
    cell: int = 256,
    patience: int = 1000,
) -> DataFrame:
    """``crops_per_scene`` crops of every scene, each drawn again until at most ``most_missing`` of it has no signal.

    A round draws every sample that is still open, twice as often as the round before, and takes its first good
    attempt.  A sample that fails ``patience`` times or more is taken to be impossible, which is an error that names
    a scene, not a loss of rows.
    """
    done, samples, attempt, attempts = None, None, 0, 1
    key = ["scene_id", "sample_no"]
    while True:
        crops = mixed_crops(
            scenes, labels, shoreline, crops_per_scene, crop, object_share, seed, attempt=attempt, attempts=attempts, samples=samples
        )
        drawn = cut_lineage(missing_share(crops, pixels, value, cell))
        good = first_by(drawn.filter(F.col("missing") <= most_missing), key, [F.col("attempt")])
        done = good if done is None else done.unionByName(good)
        samples = drawn.select(*key).distinct().join(good.select(*key), key, "left_anti")
        open_scene = samples.agg(F.min("scene_id")).first()[0]
        if open_scene is None:
            return done
        attempt, attempts = attempt + attempts, 2 * attempts
        if attempt >= patience:
            raise ValueError(f"no crop with enough signal in scene {open_scene}")


def missing_share(crops: DataFrame, pixels: DataFrame, value: str, cell: int = 256) -> DataFrame:
    """Add ``missing``, the share of missing pixels of each crop (a pixel not in the table is missing).

    Each crop is cut along the grid cells; a cell's part counts its pixels, and the counts are added up.
    """
    present = with_cell(pixels.filter(F.col(value).isNotNull()).select("scene_id", "r", "c"), "r", "c", cell)
    spread = crops.withColumn(
        "cell_r", F.explode(F.sequence(cell_of(F.col("r0"), cell), cell_of(F.col("r1") - 1, cell)))
    ).withColumn("cell_c", F.explode(F.sequence(cell_of(F.col("c0"), cell), cell_of(F.col("c1") - 1, cell))))
    met = repeated(spread).join(present, ["scene_id", "cell_r", "cell_c"], "left")
    r, c = F.col("r"), F.col("c")
    inside = (r >= F.col("r0")) & (r < F.col("r1")) & (c >= F.col("c0")) & (c < F.col("c1"))
    counted = met.groupBy(*crops.columns).agg(F.count_if(inside).alias("_seen"))
    size = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    return counted.withColumn("missing", F.lit(1.0) - F.try_divide(F.col("_seen"), size)).drop("_seen")


def _free_spots(spots: DataFrame, boxes: DataFrame) -> DataFrame:
    """Spots farther from every box of their image than the donor's longer side."""
    near_x = F.greatest(F.col("b.x1") - F.col("s.cx"), F.col("s.cx") - F.col("b.x2") + 1, F.lit(0))
    near_y = F.greatest(F.col("b.y1") - F.col("s.cy"), F.col("s.cy") - F.col("b.y2") + 1, F.lit(0))
    reach = F.greatest("s.donor_h", "s.donor_w")
    blocked = (F.col("s.image_id") == F.col("b.image_id")) & (near_x * near_x + near_y * near_y <= reach * reach)
    return spots.alias("s").join(boxes.alias("b"), blocked, "left_anti")


def paste_plan(
    images: DataFrame, boxes: DataFrame, donors: DataFrame, height: int, width: int, seed: int, attempts: int = 16, patience: int = 4096
) -> DataFrame:
    """Where to paste a drawn donor object in each image, away from all boxes.

    ``donors`` hold ``donor_id, donor_h, donor_w, weight``.  Each image draws a donor by weight and then an even spot
    among all pixels that leave room to the image's border and keep farther from every box than the donor's longer
    side: spots are drawn until one is free, ``attempts`` at first and twice as many each round.  After ``patience``
    draws the pixels of the few images left are all listed; an image without a free pixel has no row.
    """
    numbered = chunked_rank(images.select("image_id"), [F.col("image_id")], hash_chunk(F.col("image_id")), "draw")
    numbered = numbered.withColumn("draw", F.col("draw") - 1)
    count = images.count()
    drawn = weighted_draws(donors, "donor_id", "weight", count, seed)
    chosen = numbered.join(drawn, "draw").join(donors.select("donor_id", "donor_h", "donor_w"), "donor_id").drop("draw")
    half_h, half_w = F.floor(F.col("donor_h") / 2).cast("int"), F.floor(F.col("donor_w") / 2).cast("int")
    rows, cols = F.lit(height - 2) - 2 * half_h, F.lit(width - 2) - 2 * half_w  # room for the middle of the donor
    left = cut_lineage(chosen.filter((rows > 0) & (cols > 0)))
    key, first, done = ["image_id", "donor_id", "donor_h", "donor_w"], 0, None
    while True:
        last_round = first >= patience
        if last_round:
            spots = left.withColumn("cy", F.explode(F.sequence(half_h + 1, half_h + rows)))
            spots = spots.withColumn("cx", F.explode(F.sequence(half_w + 1, half_w + cols)))
            order = uniform_hash(F.lit(seed), F.col("image_id"), F.col("cx"), F.col("cy"))
        else:
            spots = left.withColumn("_try", F.explode(F.sequence(F.lit(first), F.lit(first + attempts - 1))))
            at = [uniform_hash(F.lit(seed), F.col("image_id"), F.col("_try"), F.lit(axis)) for axis in ("x", "y")]
            spots = spots.withColumn("cx", (half_w + 1 + F.floor(at[0] * cols)).cast("int")).withColumn("cy", (half_h + 1 + F.floor(at[1] * rows)).cast("int"))
            order = F.col("_try")
        best = _free_spots(spots, boxes).groupBy(*key).agg(F.min_by(F.struct("cx", "cy"), F.struct(order.alias("o"), "cx", "cy")).alias("p"))
        best = cut_lineage(best)
        done = best if done is None else done.unionByName(best)
        left = cut_lineage(left.join(best.select("image_id"), "image_id", "left_anti"))
        if last_round or left.isEmpty():
            break
        first, attempts = first + attempts, 2 * attempts
    x1 = F.col("p.cx") - F.floor(F.col("donor_w") / 2).cast("int")
    y1 = F.col("p.cy") - F.floor(F.col("donor_h") / 2).cast("int")
    return done.select(
        "image_id", "donor_id", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("donor_w")).alias("x2"), (y1 + F.col("donor_h")).alias("y2")
    )


def training_samples(crops: DataFrame, labels: DataFrame, scenes: DataFrame, cell: int = 1024) -> DataFrame:
    """One row per crop and object (crops without objects have one row of NULLs), with codes and weights."""
    objects = labels.select(
        "scene_id",
        "detect_id",
        "detect_scene_row",
        "detect_scene_column",
        "confidence",
        unknown_to_code(F.col("is_vessel")).alias("vessel_code"),
        unknown_to_code(F.col("is_fishing")).alias("fishing_code"),
        (F.coalesce("vessel_length_m", F.lit(0.0)) / 10.0).alias("length_px"),
    )
    inside = points_in_crops(objects, crops, cell)
    folder = scenes.select("scene_id", "folder")
    return inside.join(folder, "scene_id").withColumn("sample_weight", folder_weight(F.col("folder")))


def sample_lists(samples: DataFrame) -> DataFrame:
    """The objects of each crop as one array; a crop is small, and so is its list."""
    item = F.struct("detect_id", "crop_row", "crop_col", "confidence", "vessel_code", "fishing_code", "length_px")
    objects = F.array_sort(F.collect_list(F.when(F.col("detect_id").isNotNull(), item)))
    return samples.groupBy("scene_id", "crop_id", "r0", "r1", "c0", "c1", "folder", "sample_weight").agg(objects.alias("objects"))
