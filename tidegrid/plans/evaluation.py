"""A whole evaluation from one matching: threshold summary, best triple, scores per scene, thresholded detections."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.thresholds import apply_thresholds
from tidegrid.plans import scoring as S
from tidegrid.sources import sinks
from tidegrid.session import cut_lineage

NO_CUT = -1e300  # every score reaches it


class Evaluation(NamedTuple):
    detections: DataFrame  # as given
    summary: DataFrame  # all threshold triples, best first
    best: dict  # the three best thresholds
    per_scene: DataFrame  # scores of each scene at the best class thresholds and at its own
    thresholded: DataFrame  # detections cut at the best triple


def evaluate(
    pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None = None, objectness: Sequence[float] | None = None, **overrides
) -> Evaluation:
    """Everything an evaluation reports.

    Detections are matched once, for all objectness thresholds and for none; the counts of each scene then give the
    sweep over all scenes and the scores of single scenes, which take detections without an objectness cut.  Detections
    need a score; without any label there is no best triple, which is an error.
    """
    options = S.ScoreOptions(**overrides)
    cuts = S.OBJECTNESS_THRESHOLDS if objectness is None else objectness
    base, cells, levels = S.count_levels(pred, labels, shoreline, [NO_CUT, *cuts], options, ["scene_id"])
    total = S.scores_from_counts(*S.over_scenes(base, cells), levels, options, [])
    summary = S.rank_summary(cut_lineage(total.filter(F.col("objectness_threshold") != NO_CUT)))
    row = S.best_thresholds(summary).first()
    best = {t: row[t] for t in S.THRESHOLDS}
    if None in best.values():
        raise ValueError("no scene has a label")
    uncut = F.col("k") == 0
    scores = S.scores_from_counts(base.filter(uncut), cells.filter(uncut), levels, options, ["scene_id"])
    grid = options.vessel_thresholds, options.fishing_thresholds
    per_scene = S.choose_per_scene(scores, best["is_vessel_threshold"], best["is_fishing_threshold"], grid)
    kept = apply_thresholds(pred, *(best[t] for t in S.THRESHOLDS))
    return Evaluation(pred, summary, best, per_scene, kept)


def write_evaluation(result: Evaluation, path: str) -> None:
    """The four tables below ``path``; thresholded detections by scene."""
    sinks.write_summary(result.detections, f"{path}/unfiltered_predictions")
    sinks.write_summary(result.summary, f"{path}/thresholds_summary")
    sinks.write_summary(result.per_scene, f"{path}/scores_per_scene")
    sinks.write_per_scene(result.thresholded, f"{path}/predictions")
