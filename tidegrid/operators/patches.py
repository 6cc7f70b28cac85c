"""Map operators on patches: rasters stay arrays, keys are those of patches, never of pixels.

A patch is a tile row ``scene_id, channel, tile_row, tile_col, h, w, pixels`` on a regular grid of side ``side``
(patches at the lower and right edge are smaller).  Operators that move or combine maps cut each array at the lines of
the target grid into pieces, send every piece to its patch once, and put the pieces of a patch together there.  A patch
gets a bounded number of pieces: those of the tiles, models and variants that cover it.  Missing pixels are NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.geometry import INVERSE_MOVE, PIXEL_MOVES, TURNS_SIDEWAYS

PATCH = "scene_id string, channel string, tile_row int, tile_col int, h int, w int, pixels array<double>"
PIECE = "scene_id string, channel string, tile_row int, tile_col int, y int, x int, h int, w int, from_y int, from_x int, pixels array<double>"
KEYS = ("scene_id", "channel", "tile_row", "tile_col")
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}


def grids(batch: pa.RecordBatch, name: str = "pixels") -> list[np.ndarray]:
    """The arrays of a batch as two-dimensional ones, NaN where a pixel is missing."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    sides = zip(batch.column("h").to_pylist(), batch.column("w").to_pylist())
    return [flat[a:b].reshape(hw) for a, b, hw in zip([0, *ends], ends, sides)]


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays as one list column, NaN as NULL."""
    flat = np.concatenate([a.reshape(-1) for a in arrays]) if arrays else np.zeros(0)
    ends = np.cumsum([0, *(a.size for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows whose last column is a two-dimensional array."""
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows))
    data = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns[:-1], fields[:-1])] + [lists(list(columns[-1]))]
    return pa.RecordBatch.from_arrays(data, names=[n for n, _ in fields])


def in_batches(rows: Iterator[tuple], schema: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``most`` pixels."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[-1].size + 16
        if size >= most:
            yield rows_of(held, schema)
            held, size = [], 0
    if held:
        yield rows_of(held, schema)


def cut(array: np.ndarray, r0: int, c0: int, side: int) -> Iterator[tuple]:
    """Pieces of an array whose corner is at (r0, c0): ``patch row, patch column, y, x, h, w, from_y, from_x, pixels``."""
    h, w = array.shape
    for top in range(r0 // side * side, r0 + h, side):
        a, b = max(top, r0), min(top + side, r0 + h)
        for left in range(c0 // side * side, c0 + w, side):
            c, d = max(left, c0), min(left + side, c0 + w)
            yield top, left, a - top, c - left, b - a, d - c, a - r0, c - c0, array[a - r0 : b - r0, c - c0 : d - c0]


def pieces(tiles: DataFrame, side: int, place: Callable[[dict, np.ndarray], tuple[np.ndarray, int, int] | None] | None = None) -> DataFrame:
    """Rows of ``PIECE`` for the patches that each tile touches.

    ``place`` may turn or resample an array first: from a tile's other columns and its pixels to the new pixels and the
    place of their corner.
    """

    def run(batches):
        for batch in batches:
            def made():
                names = [n for n in batch.schema.names if n != "pixels"]
                for values, array in zip(zip(*(batch.column(n).to_pylist() for n in names)), grids(batch)):
                    row = dict(zip(names, values))
                    found = (array, row["tile_row"], row["tile_col"]) if place is None else place(row, array)
                    if found is not None:
                        yield from ((row["scene_id"], row["channel"], *piece) for piece in cut(*found, side))

            yield from in_batches(made(), PIECE)

    return tiles.mapInArrow(run, PIECE)


def assemble(parts: DataFrame, join: Callable[[list[dict], int, int], np.ndarray], *more: str) -> DataFrame:
    """Patches from their pieces, by one shuffle of the pieces' arrays.

    ``join`` gets the pieces of a patch, each with its place and pixels, and the patch's size.
    """
    fields = ["y", "x", "h", "w", "from_y", "from_x", *more, "pixels"]
    met = parts.groupBy(*KEYS).agg(F.collect_list(F.struct(*fields)).alias("p"))
    met = met.select(*KEYS, F.array_max(F.transform("p", lambda q: q["y"] + q["h"])).alias("h"), F.array_max(F.transform("p", lambda q: q["x"] + q["w"])).alias("w"), "p")

    def run(batches):
        for batch in batches:
            def made():
                lists_ = batch.column("p")
                ends = np.cumsum(lists_.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                inner = pa.RecordBatch.from_struct_array(lists_.flatten())
                every = [dict(zip(fields, v)) for v in zip(*(inner.column(n).to_pylist() for n in fields[:-1]), grids(inner))]
                keys = zip(*(batch.column(n).to_pylist() for n in (*KEYS, "h", "w")))
                for key, a, b in zip(keys, [0, *ends], ends):
                    yield (*key, join(every[a:b], key[-2], key[-1]))

            yield from in_batches(made(), PATCH)

    return met.mapInArrow(run, PATCH)


def _added(parts: list[dict], h: int, w: int, weigh: Callable[[dict], np.ndarray | float], empty_counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum and weight of each pixel, in a fixed order of the pieces."""
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for p in sorted(parts, key=lambda p: (p["from_y"], p["from_x"], p["y"], p["x"], p["pixels"].tobytes())):
        at = np.s_[p["y"] : p["y"] + p["h"], p["x"] : p["x"] + p["w"]]
        there = ~np.isnan(p["pixels"])
        by = weigh(p)
        total[at] += np.where(there, p["pixels"], 0.0) * by
        weight[at] += np.broadcast_to(by, there.shape) * (True if empty_counts else there)
    return total, weight


def _mean(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.divide(total, weight, out=np.full(total.shape, np.nan), where=weight > 0)


def _once(parts: list[dict], h: int, w: int) -> np.ndarray:
    out = np.full((h, w), np.nan)
    for p in parts:
        out[p["y"] : p["y"] + p["h"], p["x"] : p["x"] + p["w"]] = p["pixels"]
    return out


def regrid(tiles: DataFrame, side: int) -> DataFrame:
    """The same map as patches of another side; tiles must not overlap."""
    return assemble(pieces(tiles, side), _once)


def pyramid(tile: int) -> np.ndarray:
    """Weights of a tile's pixels: edge distance over edge plus centre distance."""
    at = np.arange(tile) + 0.5
    centre = np.sqrt((at[:, None] - tile / 2) ** 2 + (at[None, :] - tile / 2) ** 2)
    near = np.sqrt(np.minimum(at, tile - at) ** 2 + 0.25)
    edge = np.minimum(near[:, None], near[None, :])
    return edge / (edge + centre)


def merge(tiles: DataFrame, tile: int, step: int) -> DataFrame:
    """Weighted mean of overlapping tiles that start at multiples of ``step``, as patches of side gcd(tile, step).

    A patch meets ``ceil(tile / step)^2`` tiles at most.  Weights follow from a piece's place in its tile, so only pixels
    are sent.
    """
    weights = pyramid(tile)

    def weigh(p: dict) -> np.ndarray:
        return weights[p["from_y"] : p["from_y"] + p["h"], p["from_x"] : p["from_x"] + p["w"]]

    return assemble(pieces(tiles, int(np.gcd(tile, step))), lambda parts, h, w: _mean(*_added(parts, h, w, weigh, True)))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-v))


def ensemble(models: DataFrame, side: int, activation: str | None = "after_model") -> DataFrame:
    """Mean over models whose maps may be cut differently, with the sigmoid before or after it."""
    if activation not in (None, "after_model", "after_ensemble", "after_tta"):
        raise ValueError(f"unknown activation place {activation!r}")
    first = activation == "after_model"

    def join(parts: list[dict], h: int, w: int) -> np.ndarray:
        if first:
            parts = [{**p, "pixels": _sigmoid(p["pixels"])} for p in parts]
        mean = _mean(*_added(parts, h, w, lambda p: 1.0, False))
        return _sigmoid(mean) if activation in ("after_ensemble", "after_tta") else mean

    return assemble(pieces(models, side), join)


def turn_back(variant: str, array: np.ndarray, r0: int, c0: int, height: int, width: int) -> tuple[np.ndarray, int, int]:
    """A block of a moved map at (r0, c0) and its corner in the map before the move; the map was ``height x width``."""
    sideways = variant in TURNS_SIDEWAYS
    size = (width, height) if sideways else (height, width)
    move = PIXEL_MOVES[INVERSE_MOVE[variant]]
    first, last = move(r0, c0, *size), move(r0 + array.shape[0] - 1, c0 + array.shape[1] - 1, *size)
    turned = array.T if sideways else array
    turned = turned[:: 1 if first[0] <= last[0] else -1, :: 1 if first[1] <= last[1] else -1]
    return turned, min(first[0], last[0]), min(first[1], last[1])


def move_variants(maps: DataFrame, variants: list[str], height: int, width: int, side: int) -> DataFrame:
    """Flipped or rotated copies of maps of one size, as patches with the column ``variant``; pixels not given are missing."""
    def place(row: dict, array: np.ndarray):
        variant = row["channel"].rsplit("|", 1)[1]
        size = (width, height) if variant in TURNS_SIDEWAYS else (height, width)
        return turn_back(INVERSE_MOVE[variant], array, row["tile_row"], row["tile_col"], *size)

    named = F.explode(F.array(*[F.lit(v) for v in variants]))
    every = maps.withColumn("_v", named).withColumn("channel", F.concat("channel", F.lit("|"), "_v")).drop("_v")
    moved = assemble(pieces(every, side, place), _once)
    return moved.withColumns({"variant": F.substring_index("channel", "|", -1), "channel": F.regexp_replace("channel", r"\|[^|]*$", "")})


def undo_variants(maps: DataFrame, height: int, width: int, side: int, reduction: str = "mean", mirror_offsets: bool = False) -> DataFrame:
    """Turn the maps of flipped or rotated inputs (column ``variant``) back and average or add them.

    Turning is index arithmetic inside a patch and a new place for it.  Offsets keep their sign unless
    ``mirror_offsets``.
    """
    mirrored = {"off_x": ("fliplr", "rot180"), "off_y": ("flipud", "rot180")}

    def place(row: dict, array: np.ndarray):
        if mirror_offsets and row["variant"] in mirrored.get(row["channel"], ()):
            array = -array
        return turn_back(row["variant"], array, row["tile_row"], row["tile_col"], height, width)

    return assemble(pieces(maps, side, place), _reducer(reduction))


def _reducer(reduction: str):
    if reduction == "mean":
        return lambda parts, h, w: _mean(*_added(parts, h, w, lambda p: 1.0, False))

    def add(parts: list[dict], h: int, w: int) -> np.ndarray:
        total, weight = _added(parts, h, w, lambda p: 1.0, False)
        return np.where(weight > 0, total, np.nan)

    return add


def undo_scales(maps: DataFrame, side: int, axis: str = "rows", reduction: str = "mean") -> DataFrame:
    """Bring size maps of rescaled inputs back to the base grid and average them.

    A map of ``scale_offset`` o has o more rows and columns than its scene (``scene_rows, scene_cols``).  Each patch knows
    which rows and columns of the base grid have their nearest cell in it, and sends those, scaled by the ratio of sizes.
    """

    def reads(first: int, n: int, size: int, more: int) -> tuple[int, np.ndarray]:
        # cell floor(t * more / size) lies in [first, first + n)
        start, stop = -(-first * size // more), min(-(-(first + n) * size // more), size)
        return start, np.arange(start, stop) * more // size - first

    def place(row: dict, array: np.ndarray):
        sizes = row["scene_rows"], row["scene_cols"]
        more = [s + row["scale_offset"] for s in sizes]
        r0, down = reads(row["tile_row"], row["h"], sizes[0], more[0])
        c0, across = reads(row["tile_col"], row["w"], sizes[1], more[1])
        if not len(down) or not len(across):
            return None
        k = 0 if axis == "rows" else 1
        return array[np.ix_(down, across)] * (sizes[k] / more[k]), r0, c0

    return assemble(pieces(maps, side, place), _reducer(reduction))


def overview(tiles: DataFrame, factor: int = 4) -> DataFrame:
    """Mean of each block of pixels, inside each tile; tiles must start at multiples of ``factor``.  No shuffle."""

    def run(batches):
        for batch in batches:
            def made():
                names = ("scene_id", "channel", "tile_row", "tile_col")
                for (scene, channel, r0, c0), a in zip(zip(*(batch.column(n).to_pylist() for n in names)), grids(batch)):
                    if r0 % factor or c0 % factor:
                        raise ValueError(f"tile at ({r0}, {c0}) does not start at a multiple of {factor}")
                    there = ~np.isnan(a)
                    rows, cols = np.arange(0, a.shape[0], factor), np.arange(0, a.shape[1], factor)
                    fold = lambda v: np.add.reduceat(np.add.reduceat(v, rows, 0), cols, 1)
                    mean = _mean(fold(np.where(there, a, 0.0)), fold(there.astype(float)))
                    yield scene, channel, r0 // factor, c0 // factor, *mean.shape, mean

            yield from in_batches(made(), PATCH)

    return tiles.mapInArrow(run, PATCH)


def cut_tiles(tiles: DataFrame, tile: int, step: int) -> DataFrame:
    """Overlapping tiles that start at multiples of ``step``, from a map cut in any way.

    A pixel goes to every tile that covers it, ``ceil(tile / step)^2`` at most; tiles at the edge hold the pixels there are.
    """

    def run(batches):
        for batch in batches:
            def made():
                names = ("scene_id", "channel", "tile_row", "tile_col")
                for (scene, channel, r0, c0), a in zip(zip(*(batch.column(n).to_pylist() for n in names)), grids(batch)):
                    h, w = a.shape
                    for top in _starts(r0, h, tile, step):
                        y0, y1 = max(top, r0), min(top + tile, r0 + h)
                        for left in _starts(c0, w, tile, step):
                            x0, x1 = max(left, c0), min(left + tile, c0 + w)
                            yield scene, channel, top, left, y0 - top, x0 - left, y1 - y0, x1 - x0, 0, 0, a[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0]

            yield from in_batches(made(), PIECE)

    return assemble(tiles.mapInArrow(run, PIECE), _once)


def _starts(first: int, n: int, tile: int, step: int) -> range:
    """Starts of the tiles that meet ``[first, first + n)``."""
    return range(max((first - tile) // step + 1, 0) * step, first + n, step)


def drop_empty(tiles: DataFrame) -> DataFrame:
    """Tiles with at least one pixel other than 0; missing pixels count as 0.  A filter on the arrays."""
    return tiles.filter(F.exists("pixels", lambda v: v.isNotNull() & (v != 0)))


def drop_blank(tiles: DataFrame, most_missing: float = 0.8) -> DataFrame:
    """Tiles whose share of missing pixels (``missing``) is not above the limit."""
    share = F.size(F.filter("pixels", lambda v: v.isNull())) / F.size("pixels")
    return tiles.withColumn("missing", share).filter(F.col("missing") <= most_missing)


def grey_composite(aligned: DataFrame, vv: str, vh: str) -> DataFrame:
    """Mean of two bands stretched to 0..255 per scene, from tiles with a column of pixels per band.

    Ranges are folded per tile, then per scene; one row a scene goes back to the tiles.  Missing pixels are 0.
    """
    mixed = aligned.withColumn("_m", F.zip_with(vv, vh, lambda a, b: (a + b) / 2.0))
    ends = mixed.groupBy("scene_id").agg(F.min(F.array_min("_m")).alias("_lo"), F.max(F.array_max("_m")).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    grey = F.transform("_m", lambda v: F.round(F.coalesce(F.try_divide(v - F.col("_lo"), span) * 255.0, F.lit(0.0))))
    return mixed.join(ends, "scene_id").select("scene_id", F.lit("grey").alias("channel"), "tile_row", "tile_col", "h", "w", grey.alias("pixels"))


# --- suppression with halos -----------------------------------------------------


def _border(array: np.ndarray, dy: int, dx: int, reach: int) -> np.ndarray:
    """The part of a patch that the neighbour in direction (dy, dx) needs."""
    pick = {-1: slice(0, reach), 0: slice(None), 1: slice(-reach, None)}
    return array[pick[dy], pick[dx]]


AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def with_halo(patches: DataFrame, side: int, reach: int) -> DataFrame:
    """Each patch with the border lines of its up to eight neighbours: ``halo array<struct<dy, dx, h, w, pixels>>``.

    Only lines of ``reach`` pixels are sent; a patch must not be smaller than that but at the edge of its scene.
    """
    sent = "scene_id string, channel string, tile_row int, tile_col int, dy int, dx int, h int, w int, pixels array<double>"

    def run(batches):
        for batch in batches:
            def made():
                for (scene, channel, r0, c0), a in zip(zip(*(batch.column(n).to_pylist() for n in KEYS)), grids(batch)):
                    for dy, dx in AROUND:
                        if r0 + dy * side >= 0 and c0 + dx * side >= 0:
                            line = _border(a, dy, dx, reach)
                            yield scene, channel, r0 + dy * side, c0 + dx * side, -dy, -dx, *line.shape, line

            yield from in_batches(made(), sent)

    lines = patches.mapInArrow(run, sent).groupBy(*KEYS).agg(F.collect_list(F.struct("dy", "dx", "h", "w", "pixels")).alias("halo"))
    return patches.join(lines, list(KEYS), "left")


def _padded(a: np.ndarray, halo: list, reach: int) -> np.ndarray:
    h, w = a.shape
    out = np.full((h + 2 * reach, w + 2 * reach), -np.inf)
    out[reach : reach + h, reach : reach + w] = a
    for dy, dx, lh, lw, line in halo:
        top = {-1: reach - lh, 0: reach, 1: reach + h}[dy]
        left = {-1: reach - lw, 0: reach, 1: reach + w}[dx]
        part = line[: out.shape[0] - top, : out.shape[1] - left]
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
    out[np.isnan(out)] = -np.inf
    return out


def _slide(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Largest value within ``reach`` steps along an axis; that axis loses ``reach`` at both ends."""
    n = a.shape[axis] - 2 * reach
    take = lambda k: a[k : k + n] if axis == 0 else a[:, k : k + n]
    out = take(0).copy()
    for k in range(1, 2 * reach + 1):
        np.maximum(out, take(k), out=out)
    return out


def square(padded: np.ndarray, reach: int) -> np.ndarray:
    return _slide(_slide(padded, reach, 0), reach, 1)


def plus(padded: np.ndarray, reach: int) -> np.ndarray:
    """Largest value of the upright and the level line through a pixel."""
    level, upright = _slide(padded[reach:-reach], reach, 1), _slide(padded[:, reach:-reach], reach, 0)
    return np.maximum(level, upright)


def suppress(patches: DataFrame, side: int, kernel: int = 3, tight: bool = False) -> DataFrame:
    """Zero every pixel below the maximum of its neighbourhood; equal neighbours all stay, missing pixels become 0.

    The neighbourhood is the ``kernel x kernel`` square, or if ``tight`` the plus of that length, for 5 together with the
    3 x 3 square.
    """
    if tight and kernel not in (3, 5):
        raise ValueError(f"kernel must be 3 or 5, not {kernel}")
    reach = (kernel - 1) // 2

    def highest(padded: np.ndarray) -> np.ndarray:
        if not tight:
            return square(padded, reach)
        top = plus(padded, reach)
        return np.maximum(top, square(padded[1:-1, 1:-1], 1)) if kernel == 5 else top

    def run(batches):
        for batch in batches:
            def made():
                keys = zip(*(batch.column(n).to_pylist() for n in (*KEYS, "h", "w")))
                column = batch.column("halo")
                ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                inner = pa.RecordBatch.from_struct_array(column.flatten())
                lines = list(zip(*(inner.column(n).to_pylist() for n in ("dy", "dx", "h", "w")), grids(inner)))
                for key, a, x, y in zip(keys, grids(batch), [0, *ends], ends):
                    yield (*key, np.where(a == highest(_padded(a, lines[x:y], reach)), a, 0.0))

            yield from in_batches(made(), PATCH)

    return with_halo(patches, side, reach).mapInArrow(run, PATCH)
