"""Range joins on grid cells.

A distance predicate alone makes Spark compare every pair of a scene.  Here both
sides carry the cell of a grid as wide as the radius, one side is repeated into
its 3x3 neighbourhood, and the join is an equality on (scene, cell).  A busy scene
thus spreads over as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def with_cell(df: DataFrame, row: str, col: str, size: float) -> DataFrame:
    return df.withColumns({"cell_r": cell_of(F.col(row), size), "cell_c": cell_of(F.col(col), size)})


def with_neighbour_cells(df: DataFrame, row: str, col: str, size: float) -> DataFrame:
    """Repeat each row into the nine cells around its own."""
    r, c = cell_of(F.col(row), size), cell_of(F.col(col), size)
    return df.withColumn("cell_r", F.explode(F.sequence(r - 1, r + 1))).withColumn(
        "cell_c", F.explode(F.sequence(c - 1, c + 1))
    )


def repeated(df: DataFrame) -> DataFrame:
    """Mark the side of a join whose rows ``explode`` repeats, so that it is shuffled and never broadcast.

    Spark takes the size of such rows to be that of the rows before they were repeated, and compressed at that.
    """
    return df.hint("merge")


def squared_distance(ar: Column, ac: Column, br: Column, bc: Column) -> Column:
    return (ar - br) * (ar - br) + (ac - bc) * (ac - bc)


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    keys: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """All pairs of the same scene at most ``radius`` apart, with their squared distance ``d2``.

    ``right`` is the side that is repeated, so pass the smaller side there.  The
    two sides must not share column names other than ``keys``.
    """
    a = with_cell(left, *left_at, radius)
    b = with_neighbour_cells(right, *right_at, radius)
    d2 = squared_distance(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    joined = a.join(repeated(b), [*keys, "cell_r", "cell_c"])
    return joined.withColumn("d2", d2).filter(F.col("d2") <= F.lit(radius * radius)).drop("cell_r", "cell_c")


def close_pairs(a: tuple, b: tuple, radius: float, at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same pairs inside a task: indices into ``a`` and ``b``, and the squared distance.

    Both are whole-number columns ``group, r, c``; only points of one group pair.  Candidates come from the nine cells
    around each point of ``a``, ``at_once`` of them at a time.
    """
    size = max(int(np.ceil(radius)), 1)
    (a_group, a_r, a_c), (b_group, b_r, b_c) = a, b
    # cells by rank among those that can meet, so that keys stay small; three neighbours have ranks that follow each other
    near_r, near_c = (np.unique(np.add.outer((-1, 0, 1), np.unique(x // size))) for x in (a_r, a_c))

    def key(group: np.ndarray, cell_r: np.ndarray, cell_c: np.ndarray) -> np.ndarray:
        return (group * len(near_r) + np.searchsorted(near_r, cell_r)) * len(near_c) + np.searchsorted(near_c, cell_c)

    met = np.flatnonzero(np.isin(b_r // size, near_r) & np.isin(b_c // size, near_c))
    keys = key(b_group[met], b_r[met] // size, b_c[met] // size)
    order = np.argsort(keys, kind="stable")
    keys, met = keys[order], met[order]
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for step in (-1, 0, 1):
        at = key(a_group, a_r // size + step, a_c // size)
        first, n = np.searchsorted(keys, at - 1), np.searchsorted(keys, at + 1, side="right")
        n -= first
        upto = np.r_[0, np.cumsum(n)]
        cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(at_once, upto[-1], at_once)), len(n)])
        for x, y in zip(cuts[:-1], cuts[1:]):
            i = np.repeat(np.arange(x, y), n[x:y])
            j = met[np.arange(len(i)) + np.repeat(first[x:y] - (upto[x:y] - upto[x]), n[x:y])]
            d2 = (a_r[i] - b_r[j]) ** 2 + (a_c[i] - b_c[j]) ** 2
            near = d2 <= radius * radius
            found.append((i[near], j[near], d2[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def near_any(
    df: DataFrame,
    points: DataFrame,
    radius: float,
    at: tuple[str, str],
    points_at: tuple[str, str],
    exclude_zero: bool = True,
) -> DataFrame:
    """Rows of ``df`` with at least one point within ``radius``.

    With ``exclude_zero`` a point exactly under the row does not count.  A
    semi-join stops at the first hit, so no pair is ever produced.
    """
    spots = points.select(
        "scene_id", F.col(points_at[0]).alias("spot_r"), F.col(points_at[1]).alias("spot_c")
    ).distinct()
    a = with_cell(df, *at, radius).alias("a")
    b = with_neighbour_cells(spots, "spot_r", "spot_c", radius).alias("b")
    d2 = squared_distance(F.col("a." + at[0]), F.col("a." + at[1]), F.col("b.spot_r"), F.col("b.spot_c"))
    near = (
        (F.col("a.scene_id") == F.col("b.scene_id"))
        & (F.col("a.cell_r") == F.col("b.cell_r"))
        & (F.col("a.cell_c") == F.col("b.cell_c"))
        & (d2 <= F.lit(radius * radius))
    )
    if exclude_zero:
        near = near & (d2 > 0)
    return a.join(repeated(b), near, "left_semi").drop("cell_r", "cell_c")


def _square_counts(half: int, block: int):
    """Count, per pixel of one block, the objects in the square around it."""

    def count(table: pa.Table) -> pa.Table:
        cols = {n: table[n].to_numpy() for n in ("block_r", "block_c", "px_r", "px_c", "n")}
        own = table["own"].to_numpy()
        r0, c0 = int(cols["block_r"][0]) * block - half, int(cols["block_c"][0]) * block - half
        rr, cc = cols["px_r"] - r0, cols["px_c"] - c0
        qr, qc = rr[own], cc[own]
        # summed-area table over the occupied rows and columns only
        ur, ir = np.unique(rr, return_inverse=True)
        uc, ic = np.unique(cc, return_inverse=True)
        area = np.zeros((len(ur) + 1, len(uc) + 1), dtype=np.int64)
        np.add.at(area, (ir + 1, ic + 1), cols["n"])
        area = area.cumsum(axis=0).cumsum(axis=1)
        top, bottom = np.searchsorted(ur, qr - half), np.searchsorted(ur, qr + half, side="right")
        lft, rgt = np.searchsorted(uc, qc - half), np.searchsorted(uc, qc + half, side="right")
        total = area[bottom, rgt] - area[top, rgt] - area[bottom, lft] + area[top, lft]
        kept = table.select(["scene_id", "px_r", "px_c"]).filter(pa.array(own))
        return kept.append_column("neighbours", pa.array(total, pa.int64()))

    return count


def neighbour_counts(df: DataFrame, half: int, at: tuple[str, str], name: str = "neighbours") -> DataFrame:
    """For each pixel with rows, the number of rows of the scene in the square of half-side ``half`` around it.

    Rows are first counted per pixel.  Each pixel then goes to its own block and to
    those whose margin holds it (four at most), and a block answers all its
    pixels from one summed-area table.  A block is bounded by its pixels, at most
    ``max(4*half, 512 + 2*half)`` squared, however many rows or copies a scene holds.
    """
    block = max(2 * half, 512)
    r, c = F.col(at[0]), F.col(at[1])
    pixels = df.groupBy("scene_id", r.alias("px_r"), c.alias("px_c")).agg(F.count("*").alias("n"))
    pr, pc = F.col("px_r"), F.col("px_c")
    spread = pixels.withColumn(
        "block_r", F.explode(F.sequence(cell_of(pr - half, block), cell_of(pr + half, block)))
    ).withColumn("block_c", F.explode(F.sequence(cell_of(pc - half, block), cell_of(pc + half, block))))
    spread = spread.withColumn(
        "own", (F.col("block_r") == cell_of(pr, block)) & (F.col("block_c") == cell_of(pc, block))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["scene_id", "block_r", "block_c"]
    counts = spread.repartition(parts, *keys).groupBy(*keys).applyInArrow(
        _square_counts(half, block), "scene_id STRING, px_r BIGINT, px_c BIGINT, neighbours BIGINT"
    )
    return counts.select(
        "scene_id", F.col("px_r").alias(at[0]), F.col("px_c").alias(at[1]), F.col("neighbours").alias(name)
    )


def square_neighbours(df: DataFrame, half: int, at: tuple[str, str], name: str = "neighbours") -> DataFrame:
    """Add the number of rows in the square around each row, itself included."""
    return df.join(neighbour_counts(df, half, at, name), ["scene_id", *at])


def points_in_crops(
    points: DataFrame, crops: DataFrame, cell: int = 1024, at: tuple[str, str] = ("detect_scene_row", "detect_scene_column")
) -> DataFrame:
    """Points inside half-open crops, shifted to the crop's origin; crops without a point stay, with NULLs.

    ``crops`` holds ``scene_id, crop_id, r0, r1, c0, c1``.
    """
    spread = crops.withColumn(
        "cell_r", F.explode(F.sequence(cell_of(F.col("r0"), cell), cell_of(F.col("r1") - 1, cell)))
    ).withColumn("cell_c", F.explode(F.sequence(cell_of(F.col("c0"), cell), cell_of(F.col("c1") - 1, cell))))
    r, c = F.col(at[0]), F.col(at[1])
    inside = with_cell(points, *at, cell).join(repeated(spread), ["scene_id", "cell_r", "cell_c"]).filter(
        (r >= F.col("r0")) & (r < F.col("r1")) & (c >= F.col("c0")) & (c < F.col("c1"))
    )
    shifted = inside.withColumns({"crop_row": r - F.col("r0"), "crop_col": c - F.col("c0")}).drop(
        "cell_r", "cell_c", "r0", "r1", "c0", "c1"
    )
    return crops.join(shifted, ["scene_id", "crop_id"], "left")


def points_outside_holes(points: DataFrame, holes: DataFrame, cell: int = 64, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Points (``x, y``) that lie in none of the half-open holes (``hx1 hy1 hx2 hy2``) of their image."""
    spread = holes.withColumn(
        "cell_r", F.explode(F.sequence(cell_of(F.col("hy1"), cell), cell_of(F.col("hy2") - 1, cell)))
    ).withColumn("cell_c", F.explode(F.sequence(cell_of(F.col("hx1"), cell), cell_of(F.col("hx2") - 1, cell))))
    a, b = with_cell(points, "y", "x", cell).alias("a"), spread.alias("b")
    on = (F.col("a.cell_r") == F.col("b.cell_r")) & (F.col("a.cell_c") == F.col("b.cell_c"))
    for key in keys:
        on = on & (F.col("a." + key) == F.col("b." + key))
    hit = (F.col("a.x") >= F.col("b.hx1")) & (F.col("a.x") < F.col("b.hx2"))
    hit = hit & (F.col("a.y") >= F.col("b.hy1")) & (F.col("a.y") < F.col("b.hy2"))
    return a.join(repeated(b), on & hit, "left_anti").drop("cell_r", "cell_c")
