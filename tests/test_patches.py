"""Patch operators against plain numpy on whole maps."""

import numpy as np
import pytest

from tidegrid.functions.geometry import MODE_MOVES, PIXEL_MOVES, TURNS_SIDEWAYS
from tidegrid.operators import patches as P


def table(spark, maps, side, overlap=0, **more):
    """Maps ``{(scene, channel): array}`` as tiles of ``side``, starting every ``side - overlap`` pixels."""
    rows = []
    for (scene, channel), a in maps.items():
        for r in range(0, a.shape[0], side - overlap):
            for c in range(0, a.shape[1], side - overlap):
                cut = a[r : r + side, c : c + side]
                rows.append((scene, channel, r, c, *cut.shape, [None if np.isnan(v) else float(v) for v in cut.reshape(-1)], *more.values()))
    kinds = {str: "string", int: "int"}
    return spark.createDataFrame(rows, P.PATCH + "".join(f", {k} {kinds[type(v)]}" for k, v in more.items()))


def whole(df, shape, key=("s", "obj")):
    out, seen = np.full(shape, np.nan), np.zeros(shape, int)
    for t in df.collect():
        if (t.scene_id, t.channel) == key:
            at = np.s_[t.tile_row : t.tile_row + t.h, t.tile_col : t.tile_col + t.w]
            out[at] = np.array([np.nan if v is None else v for v in t.pixels]).reshape(t.h, t.w)
            seen[at] += 1
    assert (seen <= 1).all()
    return out


@pytest.fixture(scope="module")
def random_map():
    a = np.random.default_rng(3).integers(0, 40, (37, 53)).astype(float)
    a[5, 7] = a[36, 52] = np.nan
    return a


def test_regrid_and_cut_tiles_keep_every_pixel(spark, random_map):
    maps = {("s", "obj"): random_map, ("t", "obj"): random_map + 1}
    for side in (5, 64):
        got = whole(P.regrid(table(spark, maps, 16), side), random_map.shape)
        np.testing.assert_array_equal(got, random_map)
    for t in P.cut_tiles(table(spark, maps, 10), 16, 12).filter("scene_id = 's'").collect():
        want = random_map[t.tile_row : t.tile_row + 16, t.tile_col : t.tile_col + 16]
        assert (t.h, t.w) == want.shape and t.tile_row % 12 == t.tile_col % 12 == 0
        np.testing.assert_array_equal(np.array([np.nan if v is None else v for v in t.pixels]).reshape(want.shape), want)


def test_merge_is_the_weighted_mean(spark, random_map):
    a = np.nan_to_num(random_map)
    tiles = table(spark, {("s", "obj"): a}, 16, overlap=4)
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for r in range(0, a.shape[0], 12):
        for c in range(0, a.shape[1], 12):
            cut = a[r : r + 16, c : c + 16]
            w = P.pyramid(16)[: cut.shape[0], : cut.shape[1]]
            total[r : r + 16, c : c + 16] += cut * w
            weight[r : r + 16, c : c + 16] += w
    np.testing.assert_allclose(whole(P.merge(tiles, 16, 12), a.shape), total / weight, rtol=1e-12)


@pytest.mark.parametrize("reduction", ["mean", "sum"])
def test_all_moves_are_undone(spark, random_map, reduction):
    h, w = random_map.shape
    parts = None
    for k, move in enumerate(MODE_MOVES["d4"]):
        moved = np.full((w, h) if move in TURNS_SIDEWAYS else (h, w), np.nan)
        for r in range(h):
            for c in range(w):
                moved[PIXEL_MOVES[move](r, c, h, w)] = random_map[r, c] + k
        t = table(spark, {("s", "obj"): moved}, 9, variant=move)
        parts = t if parts is None else parts.unionByName(t)
    want = random_map + 3.5 if reduction == "mean" else random_map * 8 + 28
    np.testing.assert_allclose(whole(P.undo_variants(parts, h, w, 16, reduction), random_map.shape), want, rtol=1e-12)


def test_moved_maps_are_the_moves(spark, random_map):
    h, w = random_map.shape
    moved = P.move_variants(table(spark, {("s", "obj"): random_map}, 9), MODE_MOVES["d4"], h, w, 16).cache()
    for move in MODE_MOVES["d4"]:
        want = np.full((w, h) if move in TURNS_SIDEWAYS else (h, w), np.nan)
        for r in range(h):
            for c in range(w):
                want[PIXEL_MOVES[move](r, c, h, w)] = random_map[r, c]
        np.testing.assert_array_equal(whole(moved.filter(moved.variant == move), want.shape), want)


@pytest.mark.parametrize("offset", [-9, 0, 14])
def test_scales_take_the_nearest_cell(spark, offset):
    h, w = 37, 53
    small = np.random.default_rng(offset + 20).random((h + offset, w + offset))
    t = table(spark, {("s", "obj"): small}, 10, scale_offset=offset, scene_rows=h, scene_cols=w)
    want = small[np.ix_(np.arange(h) * (h + offset) // h, np.arange(w) * (w + offset) // w)]
    for axis, ratio in (("rows", h / (h + offset)), ("cols", w / (w + offset))):
        np.testing.assert_allclose(whole(P.undo_scales(t, 16, axis), (h, w)), want * ratio, rtol=1e-12)


@pytest.mark.parametrize("kernel,tight", [(3, False), (5, False), (7, False), (3, True), (5, True)])
def test_suppression_sees_over_borders(spark, random_map, kernel, tight):
    reach = kernel // 2
    wide = np.pad(np.where(np.isnan(random_map), -np.inf, random_map), reach, constant_values=-np.inf)
    want = np.zeros(random_map.shape)
    for r in range(want.shape[0]):
        for c in range(want.shape[1]):
            around = wide[r : r + kernel, c : c + kernel]
            top = around.max() if not tight else max(around[reach].max(), around[:, reach].max())
            if tight and kernel == 5:
                top = max(top, around[1:4, 1:4].max())
            want[r, c] = random_map[r, c] if random_map[r, c] == top else 0.0
    for side in (8, 64):
        np.testing.assert_array_equal(whole(P.suppress(table(spark, {("s", "obj"): random_map}, side), side, kernel, tight), want.shape), want)


def test_overview_means_of_blocks(spark, random_map):
    got = whole(P.overview(table(spark, {("s", "obj"): random_map}, 16), 4), (10, 14))
    want = [[np.nanmean(random_map[r : r + 4, c : c + 4]) if not np.isnan(random_map[r : r + 4, c : c + 4]).all() else np.nan for c in range(0, 53, 4)] for r in range(0, 37, 4)]
    np.testing.assert_allclose(got, want, rtol=1e-12)
    with pytest.raises(Exception, match="does not start"):
        P.overview(table(spark, {("s", "obj"): random_map}, 10), 4).collect()


def test_ensemble_of_maps_cut_differently(spark, random_map):
    a = random_map / 40
    both = table(spark, {("s", "obj"): a}, 8).unionByName(table(spark, {("s", "obj"): a * 3}, 20))
    sig = lambda v: 1 / (1 + np.exp(-v))
    np.testing.assert_allclose(whole(P.ensemble(both, 16), a.shape), (sig(a) + sig(a * 3)) / 2, rtol=1e-12)
    np.testing.assert_allclose(whole(P.ensemble(both, 16, "after_ensemble"), a.shape), sig(a * 2), rtol=1e-12)
    with pytest.raises(ValueError):
        P.ensemble(both, 16, "never")


def test_empty_tables_and_no_exchange_on_pixels(spark):
    none = spark.createDataFrame([], P.PATCH)
    assert P.merge(none, 16, 12).collect() == P.suppress(none, 8).collect() == P.overview(none).collect() == []
    plan = P.merge(none, 16, 12)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all("tile_row" in k and "r#" not in k.replace("tile_row#", "") for k in keys)
