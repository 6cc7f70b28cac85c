"""Coordinate maps of flips, turns and tile shuffles, for keypoints and for pixel indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each entry maps (row, col) of an n x n or h x w pixel grid to its place after the move.
# Pixel indices run from 0 to h-1 and 0 to w-1.
PIXEL_MOVES = {
    "none": lambda r, c, h, w: (r, c),
    "fliplr": lambda r, c, h, w: (r, w - 1 - c),
    "flipud": lambda r, c, h, w: (h - 1 - r, c),
    "rot180": lambda r, c, h, w: (h - 1 - r, w - 1 - c),
    "transpose": lambda r, c, h, w: (c, r),
    "rot90": lambda r, c, h, w: (w - 1 - c, r),
    "rot270": lambda r, c, h, w: (c, h - 1 - r),
    "antitranspose": lambda r, c, h, w: (w - 1 - c, h - 1 - r),
}
# the move that takes a moved grid back; h and w are those of the moved grid
INVERSE_MOVE = {
    "none": "none",
    "fliplr": "fliplr",
    "flipud": "flipud",
    "rot180": "rot180",
    "transpose": "transpose",
    "rot90": "rot270",
    "rot270": "rot90",
    "antitranspose": "antitranspose",
}
# moves averaged by each test-time mode
MODE_MOVES = {
    "fliplr": ["none", "fliplr"],
    "flips": ["none", "fliplr", "flipud"],
    "d2": ["none", "rot180", "fliplr", "flipud"],
    "d4": ["none", "rot90", "rot180", "rot270", "transpose", "antitranspose", "fliplr", "flipud"],
}
TURNS_SIDEWAYS = ("transpose", "rot90", "rot270", "antitranspose")


def move_pixel(move: str, r: Column, c: Column, h: Column, w: Column) -> tuple[Column, Column]:
    return PIXEL_MOVES[move](r, c, h, w)


def move_back(variant: Column, r: Column, c: Column, h: int, w: int) -> tuple[Column, Column]:
    """Undo the move named in ``variant`` for pixels of a moved map of an ``h x w`` scene."""
    row, col = None, None
    for name, inverse in INVERSE_MOVE.items():
        mh, mw = (w, h) if name in TURNS_SIDEWAYS else (h, w)
        back_r, back_c = PIXEL_MOVES[inverse](r, c, F.lit(mh), F.lit(mw))
        row = F.when(variant == name, back_r) if row is None else row.when(variant == name, back_r)
        col = F.when(variant == name, back_c) if col is None else col.when(variant == name, back_c)
    return row, col


def move_keypoint(move: str, x: Column, y: Column, h: Column, w: Column) -> tuple[Column, Column]:
    """Keypoint of an image after the move; returns (x, y)."""
    row, col = PIXEL_MOVES[move](y, x, h, w)
    return col, row


def shuffle_tiles(points: DataFrame, permutation: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Move each point with its tile.

    ``permutation`` holds ``old_tr, old_tc, new_tr, new_tc`` per tile of a fixed
    grid; points whose tile is not listed stay where they are.
    """
    x, y = F.col("x"), F.col("y")
    keyed = points.withColumns({"old_tr": F.floor(y / tile_h), "old_tc": F.floor(x / tile_w)})
    moved = keyed.join(permutation, ["old_tr", "old_tc"], "left")
    return moved.withColumns(
        {
            "x": x + (F.coalesce(F.col("new_tc"), F.col("old_tc")) - F.col("old_tc")) * tile_w,
            "y": y + (F.coalesce(F.col("new_tr"), F.col("old_tr")) - F.col("old_tr")) * tile_h,
        }
    ).drop("old_tr", "old_tc", "new_tr", "new_tc")
