"""Box overlaps within an image, and dropping boxes or points under holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.boxes import box_of, iou
from tidegrid.functions.scalars import uniform_hash
from tidegrid.operators.ranking import top_k
from tidegrid.operators.spatial import cell_of, repeated

CELL = 64


def _over_cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, cell: int) -> DataFrame:
    """Repeat a row into every grid cell its half-open box touches."""
    return df.withColumn("cell_r", F.explode(F.sequence(cell_of(y1, cell), cell_of(y2 - 1, cell)))).withColumn(
        "cell_c", F.explode(F.sequence(cell_of(x1, cell), cell_of(x2 - 1, cell)))
    )


def overlapping_pairs(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs ``box_no < other_no`` of one image that share area, with their IoU.

    Boxes meet in the grid cells they cover; a pair is reported by the one cell that
    holds the upper left corner of the common area, so no pair appears twice and
    boxes far apart are never compared.
    """
    b = box_of()
    left = _over_cells(boxes, b.x1, b.y1, b.x2, b.y2, cell)
    names = {n: "o_" + n for n in ("x1", "y1", "x2", "y2")}
    right = left.select("image_id", F.col("box_no").alias("other_no"), *[F.col(n).alias(o) for n, o in names.items()], "cell_r", "cell_c")
    pairs = left.select("image_id", "box_no", *names, "cell_r", "cell_c").join(repeated(right), ["image_id", "cell_r", "cell_c"])
    other = box_of("o_")
    corner_x, corner_y = F.greatest(b.x1, other.x1), F.greatest(b.y1, other.y1)
    touching = (F.least(b.x2, other.x2) > corner_x) & (F.least(b.y2, other.y2) > corner_y)
    here = (cell_of(corner_x, cell) == F.col("cell_c")) & (cell_of(corner_y, cell) == F.col("cell_r"))
    kept = pairs.filter((F.col("box_no") < F.col("other_no")) & touching & here)
    return kept.select("image_id", "box_no", "other_no", iou(b, other).alias("iou"))


def drop_boxes(
    boxes: DataFrame,
    seed: int,
    max_objects: int = 5,
    max_fraction: float = 0.2,
    overlap_iou: float = 0.35,
    drop_partners: bool = True,
) -> DataFrame:
    """Remove some boxes of each image together with the boxes that overlap them.

    Up to ``min(max_objects, max_fraction*n)`` boxes are drawn per image by seeded hashes.
    If the drawn boxes and their partners exceed that number, the image keeps all.
    """
    sizes = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    most = F.least(F.lit(max_objects), F.floor(F.col("n") * F.lit(max_fraction))).cast("int")
    wanted = F.when(most > 0, 1 + F.floor(uniform_hash(F.lit(seed), F.col("image_id")) * most)).otherwise(0).cast("int")
    plan = sizes.select("image_id", most.alias("most"), wanted.alias("wanted")).filter("wanted > 0")
    shuffled = boxes.withColumn("_u", uniform_hash(F.lit(seed), F.col("image_id"), F.col("box_no")))
    ranked = top_k(shuffled, max_objects, ["image_id"], [F.col("_u"), F.col("box_no")], "_rank")
    drawn = ranked.join(plan, "image_id").filter(F.col("_rank") <= F.col("wanted")).select("image_id", "box_no")
    doomed = drawn
    if drop_partners:
        pairs = overlapping_pairs(boxes).filter(F.col("iou") > overlap_iou)
        both = pairs.select("image_id", "box_no", "other_no").unionByName(
            pairs.select("image_id", F.col("other_no").alias("box_no"), F.col("box_no").alias("other_no"))
        )
        partners = both.join(drawn, ["image_id", "box_no"]).select("image_id", F.col("other_no").alias("box_no"))
        doomed = drawn.unionByName(partners).distinct()
    count = doomed.groupBy("image_id").agg(F.count("*").alias("n_drop"))
    allowed = count.join(plan, "image_id").filter(F.col("n_drop") <= F.col("most")).select("image_id")
    return boxes.join(doomed.join(allowed, "image_id", "left_semi"), ["image_id", "box_no"], "left_anti")


WORD = 64


def _word_mask(x1: Column, x2: Column, word: Column) -> Column:
    """Bits of the 64-pixel word ``word`` that lie in ``[x1, x2)``."""
    start = F.greatest(x1 - word * WORD, F.lit(0)).cast("int")
    length = (F.least(x2 - word * WORD, F.lit(WORD)) - start).cast("int")
    one, everything = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")
    run = F.when(length >= WORD, everything).otherwise(F.call_function("shiftleft", one, length) - 1)
    return F.call_function("shiftleft", run, start)


BAND = 16
# holes whose cells a task puts together
HOLES_PER_TASK = 200_000


def visible_fraction(boxes: DataFrame, holes: DataFrame) -> DataFrame:
    """Share of each box's pixels that no hole covers.

    An image is cut into cells of one 64-pixel word by ``BAND`` lines.  A hole is one mask and a range of lines in each
    cell; masks are joined by a bitwise OR line by line, so overlapping holes count once, and a cell ends as one row of
    ``BAND`` words.  A box counts the bits it shares with the lines of its cells: one join on (image, cell).
    Beyond ``HOLES_PER_TASK`` for each of Spark's shuffle partitions, images and then cells are dealt to as many tasks
    as holes need, so that a task's memory does not grow with the table; holes are counted for that.
    """
    b, h = box_of(), box_of("h")
    keys = ["image_id", "band", "word"]
    usual = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-holes.count() // HOLES_PER_TASK)

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(tasks, *by) if tasks > usual else df

    def cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
        """The cells of a box: its mask in the cell, and its lines there, ``[top, bottom)``."""
        spread = df.withColumn("band", F.explode(F.sequence(cell_of(y1, BAND), cell_of(y2 - 1, BAND))))
        spread = spread.withColumn("word", F.explode(F.sequence(cell_of(x1, WORD), cell_of(x2 - 1, WORD))))
        start = F.col("band") * BAND
        return spread.withColumns({"own": _word_mask(x1, x2, F.col("word")), "top": F.greatest(y1 - start, F.lit(0)), "bottom": F.least(y2 - start, F.lit(BAND))})

    def inside(line: int) -> Column:
        return (F.col("top") <= line) & (F.col("bottom") > line)

    covered = cells(dealt(holes.select("image_id", "hx1", "hy1", "hx2", "hy2"), "image_id"), h.x1, h.y1, h.x2, h.y2)
    covered = dealt(covered.select(*keys, "own", "top", "bottom"), *keys)
    lines = [F.bit_or(F.when(inside(i), F.col("own"))).alias(f"line{i}") for i in range(BAND)]
    covered = covered.groupBy(*keys).agg(*lines)
    spread = cells(dealt(boxes.select("image_id", "box_no", "x1", "y1", "x2", "y2"), "image_id"), b.x1, b.y1, b.x2, b.y2)
    spread = dealt(spread.select(*keys, "box_no", "own", "top", "bottom"), *keys)
    met = spread.join(repeated(covered), keys)
    shared = [F.when(inside(i), F.coalesce(F.bit_count(F.col("own").bitwiseAND(F.col(f"line{i}"))), F.lit(0))).otherwise(0) for i in range(BAND)]
    hidden = met.groupBy("image_id", "box_no").agg(F.sum(sum(shared[1:], shared[0])).alias("hidden"))
    joined = boxes.join(hidden, ["image_id", "box_no"], "left")
    size = (b.x2 - b.x1) * (b.y2 - b.y1)
    share = F.try_divide((size - F.coalesce("hidden", F.lit(0))).cast("double"), size.cast("double"))
    return joined.withColumn("visible", share).drop("hidden")


def hide_under_holes(
    boxes: DataFrame, holes: DataFrame, label: str, uncertain_label: int, min_visible: float = 0.5, uncertain_below: float = 0.75
) -> DataFrame:
    """Drop boxes that are mostly hidden and relabel the half-hidden ones."""
    seen = visible_fraction(boxes, holes).filter(F.col("visible") > min_visible)
    return seen.withColumn(label, F.when(F.col("visible") < uncertain_below, uncertain_label).otherwise(F.col(label)))


def median_box_size(boxes: DataFrame) -> DataFrame:
    """Median square root of the box areas of each image."""
    b = box_of()
    size = F.sqrt(((b.x2 - b.x1) * (b.y2 - b.y1)).cast("double"))
    return boxes.groupBy("image_id").agg(F.percentile(size, 0.5).alias("median_size"))
