"""Headline queries, timed: prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from registry import load  # noqa: E402
from tidegrid.constants import linspace  # noqa: E402
from tidegrid.fixtures import Fixtures  # noqa: E402
from tidegrid.operators import patches  # noqa: E402
from tidegrid.operators.tiles import overlapping_tiles  # noqa: E402
from tidegrid.plans import scoring as SC  # noqa: E402
from tidegrid.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# the sweep of the final configuration: 26 objectness thresholds, 50 x 50 class thresholds
SWEEP = linspace(0.35, 0.60, 26)
NAMED = (
    "j6_pairs_within",
    "j7_optimal_matching",
    "j10_near_shore",
    "j11_crowd_count",
    "j13_box_iou",
    "j16_visible_fraction",
    "a9_official_scores",
    "a11_scores_per_scene",
    "a14_raster_stats",
    "a25_roc_auc",
    "a32_combined_weight",
    "a34_merge_tiles",
    "a36_undo_variants",
    "k6_stratified_group_folds",
    "n1_local_maxima",
    "n2_sparse_maxima",
    "d1_decode_maps",
    "d3_encode_targets",
    "t5_weighted_draws",
)


def full_sweep(fx):
    return SC.best_thresholds(SC.sweep_thresholds(fx.pred, fx.gt, fx.shore, SWEEP, shore_radius_px=60))


def near_shore(fx):
    """The near-shore mark at the reach of the scoring rule; the named query uses 60 pixels."""
    return SC.mark_near_shore(fx.pred, fx.shore, 220)


def large_tiles(fx, tile=128, step=96, side=768):
    """Overlapping tiles of a map of 768 x 768 pixels for each scene: 32 million tile pixels at the usual size."""
    scenes = fx.pix.select("scene_id").distinct().withColumns({n: F.lit(side).cast("bigint") for n in ("scene_rows", "scene_cols")})
    tiles = overlapping_tiles(scenes, tile, step).select("scene_id", F.col("r0").cast("int").alias("r0"), F.col("c0").cast("int").alias("c0"))

    def fill(batches):
        at = np.arange(tile)
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("scene_id", "r0", "c0")))
            made = ((s, "obj", r, c, tile, tile, ((r + at[:, None]) * 7919 + (c + at) * 31 + len(s)) % 1000 / 1000.0) for s, r, c in rows)
            yield from patches.in_batches(made, patches.PATCH)

    return tiles.repartition(int(CPUS) * 4).mapInArrow(fill, patches.PATCH)


def merge_32m_pixels(fx):
    """Merge of overlapping tiles, then suppression, all on patches of 32 pixels."""
    return patches.suppress(patches.merge(large_tiles(fx), 128, 96), 32)


def main() -> None:
    spark = build_session("bench", cpus=CPUS, shuffle_partitions=int(CPUS))
    fx = Fixtures(spark, FOLDER)
    smallest = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):  # start readers, workers and code generation before timing
        full_sweep(Fixtures(spark, smallest)).collect()
    registry = load()
    runs = {"sweep_26_thresholds": full_sweep, "near_shore_220_px": near_shore, "merge_32m_pixels": merge_32m_pixels, **{n: registry[n].run for n in NAMED}}
    times = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(fx).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
