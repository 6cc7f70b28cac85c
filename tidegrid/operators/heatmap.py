"""Local maxima of score maps, and drawing objects into maps, on pixel rows.

Maps are tables of pixels ``scene_id, r, c, ...``.  After a score floor only a tiny share
of a scene's pixels is left, so drawing and suppression work on that sparse form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.functions.scalars import disk_value, gaussian_value, point_value
from tidegrid.operators.spatial import cell_of

PIXEL = ("scene_id", "r", "c")


def _strip_max(value: Column, along: str, across: str, half: int) -> Column:
    """Largest value within ``half`` steps along one axis; a window holds one line of pixels."""
    return F.max(value).over(Window.partitionBy("scene_id", across).orderBy(along).rangeBetween(-half, half))


def local_maxima_dense(maps: DataFrame, value: str, kernel: int = 3) -> DataFrame:
    """Zero every pixel below the maximum of its ``kernel x kernel`` square; equal neighbours all stay.

    For maps that hold all their pixels: two passes along rows and columns.
    """
    half = (kernel - 1) // 2
    across = maps.withColumn("_line", _strip_max(F.col(value), "c", "r", half))
    both = across.withColumn("_square", _strip_max(F.col("_line"), "r", "c", half))
    kept = F.when(F.col(value) == F.col("_square"), F.col(value)).otherwise(F.lit(0.0))
    return both.withColumn(value, kept).drop("_line", "_square")


def tight_maxima_dense(maps: DataFrame, value: str, kernel: int = 3) -> DataFrame:
    """Suppression by a plus-shaped neighbourhood: 3 long, or 5 long together with the 3x3 square."""
    if kernel not in (3, 5):
        raise ValueError(f"kernel must be 3 or 5, not {kernel}")
    half = (kernel - 1) // 2
    marked = maps.withColumns(
        {"_h": _strip_max(F.col(value), "c", "r", half), "_v": _strip_max(F.col(value), "r", "c", half)}
    )
    keep = (F.col(value) == F.col("_h")) & (F.col(value) == F.col("_v"))
    if kernel == 5:
        marked = marked.withColumn("_l", _strip_max(F.col(value), "c", "r", 1))
        marked = marked.withColumn("_s", _strip_max(F.col("_l"), "r", "c", 1))
        keep = keep & (F.col(value) == F.col("_s"))
    return marked.withColumn(value, F.when(keep, F.col(value)).otherwise(F.lit(0.0))).drop("_h", "_v", "_l", "_s")


# side of the blocks of a map whose maxima are found by one task
MAXIMA_BLOCK = 1024


def _block_maxima(value: str, half: int, columns: list[str]):
    """The pixels of one block that no pixel of their square is above."""

    def pick(table: pa.Table) -> pa.Table:
        # all or none of a block's pixels have a row, and a column
        r, c = (table[n].cast(pa.int64()).fill_null(0).to_numpy() for n in ("r", "c"))
        width = int(c.max() - c.min()) + 2 * half + 1
        place = (r - r.min()) * width + c - c.min()
        known = table[value].is_valid().to_numpy()
        rank = np.full(len(table), -1)  # as the values are ordered, NaN last
        rank[known] = np.unique(table[value].drop_null().to_numpy(), return_inverse=True)[1]
        order = np.lexsort((rank, place))
        pixel = order[np.r_[np.diff(place[order]) != 0, True]]
        place, rank = place[pixel], rank[pixel]
        top = rank >= 0
        for a in range(-half, half + 1):
            for b in range(-half, half + 1):
                other = place + a * width + b
                at = np.minimum(np.searchsorted(place, other), len(place) - 1)
                top &= (place[at] != other) | (rank[at] <= rank)
        return table.select(columns).take(pa.array(pixel[top & table["own"].to_numpy()[pixel]]))

    return pick


def local_maxima_sparse(maps: DataFrame, value: str, kernel: int = 3) -> DataFrame:
    """Pixels that are the maximum of their square, for maps with pixels left out.

    A pixel goes to its block, and to others only from the border between them; a block
    answers its own pixels.  A block is bounded by its pixels.
    """
    half = (kernel - 1) // 2
    columns = [*PIXEL, *[c for c in maps.columns if c not in PIXEL]]
    spread, own = maps, F.lit(True)
    for axis, at in (("block_r", F.col("r")), ("block_c", F.col("c"))):
        reached = F.sequence(cell_of(at - half, MAXIMA_BLOCK), cell_of(at + half, MAXIMA_BLOCK))
        # pixels without a row or column are neighbours of each other, too
        spread = spread.withColumn(axis, F.explode(F.coalesce(reached, F.array(F.lit(None).cast("bigint")))))
        own &= F.col(axis).eqNullSafe(cell_of(at, MAXIMA_BLOCK))
    schema = StructType([maps.schema[c] for c in columns])
    return spread.withColumn("own", own).groupBy("scene_id", "block_r", "block_c").applyInArrow(_block_maxima(value, half, columns), schema)


def _spread(objects: DataFrame, reach: Column, height: int, width: int) -> DataFrame:
    """One row per object and map pixel within ``reach`` of its centre (``oy, ox``), with the offsets ``dy, dx``."""
    reach = reach.cast("int")
    spread = objects.withColumn("dy", F.explode(F.sequence(-reach, reach))).withColumn(
        "dx", F.explode(F.sequence(-reach, reach))
    )
    spread = spread.withColumns({"r": F.col("oy") + F.col("dy"), "c": F.col("ox") + F.col("dx")})
    return spread.filter((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))


def splat_gaussian(objects: DataFrame, height: int, width: int, name: str = "obj") -> DataFrame:
    """Round Gaussian of each object's ``radius``; where objects overlap the largest value wins."""
    radius = F.col("radius")
    sigma = (radius * 2 + 1) / F.lit(6.0)
    drawn = _spread(objects, radius, height, width).withColumn(name, gaussian_value(F.col("dx"), F.col("dy"), sigma))
    return drawn.filter(F.col(name) > 0).groupBy(*PIXEL).agg(F.max(name).alias(name))


def splat_points(objects: DataFrame, height: int, width: int, name: str = "obj") -> DataFrame:
    """The fixed 3x3 kernel of point objects."""
    drawn = _spread(objects, F.lit(1), height, width).withColumn(name, point_value(F.col("dx"), F.col("dy")))
    return drawn.groupBy(*PIXEL).agg(F.max(name).alias(name))


def splat_square_gaussian(objects: DataFrame, height: int, width: int, name: str = "obj") -> DataFrame:
    """Gaussian ``exp(-d^2/sigma^2)`` on the square of half-side ``3*sigma`` (``sigma`` a whole number)."""
    dx, dy, sigma = F.col("dx"), F.col("dy"), F.col("sigma")
    drawn = _spread(objects, sigma * 3, height, width)
    drawn = drawn.withColumn(name, F.exp(-(dx * dx + dy * dy) / (sigma * sigma).cast("double")))
    return drawn.groupBy(*PIXEL).agg(F.max(name).alias(name))


def splat_disk(objects: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """A disk of each object's value; where disks overlap the largest value wins."""
    drawn = _spread(objects, F.col("radius"), height, width)
    drawn = drawn.withColumn(value, disk_value(F.col("dx"), F.col("dy"), F.col("radius"), F.col(value)))
    inside = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= F.col("radius") * F.col("radius")
    return drawn.filter(inside).groupBy(*PIXEL).agg(F.max(value).alias(value))
