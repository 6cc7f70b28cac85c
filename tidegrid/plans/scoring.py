"""Scores of detections against labels, for one cut or for a whole sweep of thresholds.

The matching does not depend on the class thresholds, and its rows say for which
threshold numbers they hold.  All counts therefore come from two aggregations
over events ("from threshold number k on, one more"), whose results are tiny:
groups x thresholds x classes, however many detections there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.constants import CLASS_THRESHOLDS, DISTANCE_TOLERANCE_M, OBJECTNESS_THRESHOLDS, PIX_TO_M, SHORE_TOLERANCE_KM
from tidegrid.functions.labels import cap_length, keep_confident
from tidegrid.operators.matching import BLOCK_PX, match_levels, threshold_level
from tidegrid.operators.spatial import near_any
from tidegrid.session import cut_lineage

POINT = ("detect_scene_row", "detect_scene_column")


def ratio(a: Column, b: Column) -> Column:
    """``a/b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall_f(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return precision, recall, ratio(precision * recall * 2.0, precision + recall)


def aggregate_score(loc: Column, length: Column, vessel: Column, fishing: Column, shore: Column) -> Column:
    return loc * (F.lit(1.0) + length + vessel + fishing + shore) / F.lit(5.0)


def length_error(predicted: Column, actual: Column) -> Column:
    """Relative error of capped lengths; NULL without a label length or with a zero one."""
    want, got = cap_length(actual), cap_length(predicted)
    return F.try_divide(F.abs(got - want), want)


@dataclass
class ScoreOptions:
    """What to score and how."""

    tolerance_m: float = DISTANCE_TOLERANCE_M
    shore_km: float = SHORE_TOLERANCE_KM
    drop_low: bool = True
    score_all: bool = False
    vessel_thresholds: Sequence[float] = field(default_factory=lambda: CLASS_THRESHOLDS)
    fishing_thresholds: Sequence[float] = field(default_factory=lambda: CLASS_THRESHOLDS)
    shore_radius_px: float | None = None
    per_scene: bool = False
    block_px: int = BLOCK_PX

    @property
    def shore_reach_px(self) -> float:
        """Detections count as near shore up to the shore tolerance plus the match tolerance."""
        if self.shore_radius_px is not None:
            return self.shore_radius_px
        return (self.shore_km + self.tolerance_m / 1000.0) * 1000.0 / PIX_TO_M


def mark_near_shore(pred: DataFrame, shoreline: DataFrame | None, reach_px: float) -> DataFrame:
    """Add ``near_shore``: a shoreline point lies within reach, points exactly underneath not counted."""
    if shoreline is None:
        return pred.withColumn("near_shore", F.lit(False))
    near = near_any(pred.select("scene_id", "pred_id", *POINT), shoreline, reach_px, POINT, ("pt_row", "pt_col"))
    flag = near.select("pred_id", F.lit(True).alias("near_shore"))
    return pred.join(flag, "pred_id", "left").withColumn("near_shore", F.coalesce("near_shore", F.lit(False)))


def _prepare(pred: DataFrame, shoreline: DataFrame | None, cuts: Sequence[float] | None, options: ScoreOptions) -> DataFrame:
    """The detections with their threshold levels and near-shore flag, written once and read three times."""
    level = F.lit(1) if cuts is None else threshold_level("objectness_p", cuts)
    narrow = pred.select(
        "pred_id",
        "scene_id",
        *POINT,
        level.alias("k"),
        threshold_level("is_vessel_p", options.vessel_thresholds).alias("v_level"),
        threshold_level("is_fishing_p", options.fishing_thresholds).alias("f_level"),
        F.col("vessel_length_m").alias("p_length"),
    )
    return cut_lineage(mark_near_shore(narrow.filter("k > 0"), shoreline, options.shore_reach_px))


def _level_counts(pred: DataFrame, gold: DataFrame, rows: DataFrame, steps: int, scenes: DataFrame) -> DataFrame:
    """Per scene and threshold number: detections, labels and true positives, overall and near shore.

    Each input becomes events "from number k on, so many more"; one aggregation and a running
    sum over the numbers of each scene give the counts.
    """
    names = ("tp", "pred", "gold", "tp_s", "pred_s", "gold_s")

    def event(k: str, **counts: str) -> str:
        fields = ", ".join(f"'{n}', bigint({counts.get(n, '0')})" for n in names)
        return f"named_struct('k', int({k}), {fields})"

    shown = pred.groupBy("scene_id", "k").agg(F.count("*").alias("n"), F.count_if("near_shore").alias("s"))
    there, gone = event("0", pred="n", pred_s="s"), event("k", pred="-n", pred_s="-s")
    from_pred = shown.selectExpr("scene_id", f"inline(array({there}, {gone}))")
    sign = {
        "tp": "int(kind = 'paired')",
        "tp_s": "int(kind = 'paired_shore')",
        "pred": "-int(kind = 'paired_low')",
        "pred_s": "-int(kind = 'paired_low' AND ps)",
    }
    starts = event("k_from", **sign)
    ends = event("k_to", **{n: f"-({v})" for n, v in sign.items()})
    from_rows = rows.selectExpr("scene_id", f"inline(array({starts}, {ends}))")
    from_gold = gold.selectExpr("scene_id", f"inline(array({event('0', gold='1', gold_s='near_shore')}))")
    grid = scenes.selectExpr("scene_id", f"inline(transform(sequence(0, {steps - 1}), i -> {event('i')}))")
    events = from_pred.unionByName(from_rows).unionByName(from_gold).unionByName(grid)
    summed = events.filter(F.col("k") < steps).groupBy("scene_id", "k").agg(*[F.sum(n).alias(n) for n in names])
    upto = Window.partitionBy("scene_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    counts = summed.select("scene_id", "k", *[F.sum(n).over(upto).alias(n) for n in names])
    labelled = F.col("gold") > 0
    both_near = labelled & (F.col("gold_s") > 0) & (F.col("pred_s") > 0)
    return counts.select(
        "scene_id",
        "k",
        F.when(labelled, F.col("tp")).otherwise(0).alias("tp"),
        F.when(labelled, F.col("pred") - F.col("tp")).otherwise(0).alias("fp"),
        (F.col("gold") - F.col("tp")).alias("fn"),
        F.when(both_near, F.col("tp_s")).otherwise(0).alias("tp_s"),
        F.when(both_near, F.col("pred_s") - F.col("tp_s")).otherwise(0).alias("fp_s"),
        F.when(both_near, F.col("gold_s") - F.col("tp_s")).otherwise(0).alias("fn_s"),
        F.col("gold").alias("labels"),
    )


def _class_cells(rows: DataFrame, pred: DataFrame, gold: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Matched pairs counted per threshold number, kind of class, class level and label."""
    attributes = pred.select("pred_id", "v_level", "f_level", "p_length")
    truth = gold.select(
        "detect_id",
        F.col("is_vessel").alias("g_vessel"),
        F.col("is_fishing").alias("g_fishing"),
        F.col("vessel_length_m").alias("g_length"),
    )
    pairs = rows.filter("kind = 'paired'").join(attributes, "pred_id").join(truth, "detect_id")
    error = length_error(F.col("p_length"), F.col("g_length"))
    pairs = pairs.withColumn("err", F.coalesce(error, F.lit(0.0)))
    item = "named_struct('part', '{}', 'level', int({}), 'label', {}, 'err', {}, 'broken', bigint({}))"
    items = (
        f"CASE WHEN g_vessel IS NOT NULL THEN {item.format('v', 'v_level', 'g_vessel', '0D', '0')} END",
        f"CASE WHEN g_vessel AND g_fishing IS NOT NULL THEN {item.format('f', 'f_level', 'g_fishing', '0D', '0')} END",
        f"CASE WHEN g_length IS NOT NULL AND NOT isnan(g_length) AND p_length IS NOT NULL THEN {item.format('l', '0', 'true', 'err', 'g_length = 0')} END",
    )
    flat = pairs.selectExpr(*keys, "k_from", "k_to", f"inline(array_compact(array({', '.join(items)})))")
    ends = "inline(array(named_struct('k', k_from, 'sign', 1L), named_struct('k', k_to, 'sign', -1L)))"
    events = flat.selectExpr("*", ends).filter(F.col("k") < steps)
    group = [*keys, "part", "level", "label"]
    jumps = events.groupBy(*group, "k").agg(
        F.sum("sign").alias("n"), F.sum(F.col("err") * F.col("sign")).alias("err"), F.sum(F.col("broken") * F.col("sign")).alias("broken")
    )
    spread = jumps.withColumn("k", F.explode(F.sequence(F.col("k"), F.lit(steps - 1))))
    return spread.groupBy(*group, "k").agg(F.sum("n").alias("n"), F.sum("err").alias("err"), F.sum("broken").alias("broken"))


def _class_scores(cells: DataFrame, base: DataFrame, part: str, thresholds: Sequence[float], keys: list[str], name: str) -> DataFrame:
    """F1 of one class for each of its thresholds, 0 where nothing was matched."""
    count = len(thresholds)
    # a pair of level b is positive for the first b thresholds
    spread = cells.filter(F.col("part") == part).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    said_yes = F.col("j") < F.col("level")
    n = F.col("n")
    counts = spread.groupBy(*keys, "k", "j").agg(
        F.sum(F.when(F.col("label") & said_yes, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("label") & said_yes, n).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("label") & ~said_yes, n).otherwise(0)).alias("fn"),
    )
    score = counts.select(*keys, "k", "j", precision_recall_f(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias(name))
    values = ", ".join(f"named_struct('j', {i}, 't', {float(t)!r}D)" for i, t in enumerate(thresholds))
    grid = base.selectExpr(*keys, "k", f"inline(array({values}))")
    joined = grid.join(score, [*keys, "k", "j"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return joined.withColumnRenamed("t", name.replace("fscore", "threshold")).drop("j")


def score_levels(
    pred: DataFrame,
    labels: DataFrame,
    shoreline: DataFrame | None = None,
    objectness: Sequence[float] | None = None,
    options: ScoreOptions | None = None,
) -> DataFrame:
    """All scores for every objectness threshold and every pair of class thresholds.

    With ``objectness=None`` all detections take part.  With ``per_scene`` the
    result has a row set per labelled scene.
    """
    options = options or ScoreOptions()
    keys = ["scene_id"] if options.per_scene else []
    return scores_from_counts(*count_levels(pred, labels, shoreline, objectness, options, keys), options, keys)


def count_levels(
    pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None, objectness: Sequence[float] | None, options: ScoreOptions, keys: list[str]
) -> tuple[DataFrame, DataFrame, list[float] | None]:
    """What all scores follow from, by ``keys`` and threshold number ``k``: outcome counts, class cells, and the thresholds.

    This is the one place that matches; both tables are small and written.
    """
    cuts = None if objectness is None else sorted(float(t) for t in objectness)
    steps = 1 if cuts is None else len(cuts)
    pred = _prepare(pred, shoreline, cuts, options)
    labels = labels.withColumn("near_shore", F.coalesce(F.col("distance_from_shore_km") <= options.shore_km, F.lit(False)))
    gold = labels if options.score_all else keep_confident(labels)
    drop_low = options.drop_low and not options.score_all
    rows = match_levels(
        pred,
        labels if drop_low else gold,
        cuts,
        options.tolerance_m,
        drop_low=drop_low,
        shore=shoreline is not None,
        block_px=options.block_px,
    )
    scenes = labels.select("scene_id").distinct()
    counts = _level_counts(pred, gold, rows, steps, scenes)
    base = cut_lineage(counts.groupBy(*keys, "k").agg(*[F.sum(n).alias(n) for n in OUTCOMES]))
    # a table of counts, small whatever the input: groups x thresholds x class levels
    cells = cut_lineage(_class_cells(rows, pred, gold, keys, steps))
    return base, cells, cuts


OUTCOMES = ("tp", "fp", "fn", "tp_s", "fp_s", "fn_s")
CELLS = ("part", "level", "label", "k")


def over_scenes(base: DataFrame, cells: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts by scene added up to counts of all scenes, or of each group of ``groups(scene_id, ...)``."""
    keys = [] if groups is None else [c for c in groups.columns if c != "scene_id"]
    if groups is not None:
        base, cells = base.join(groups, "scene_id"), cells.join(groups, "scene_id")
    total = base.groupBy(*keys, "k").agg(*[F.sum(n).alias(n) for n in OUTCOMES])
    return total, cells.groupBy(*keys, *CELLS).agg(*[F.sum(n).alias(n) for n in ("n", "err", "broken")])


def scores_from_counts(base: DataFrame, cells: DataFrame, cuts: list[float] | None, options: ScoreOptions, keys: list[str]) -> DataFrame:
    """All scores of each group, objectness threshold and pair of class thresholds."""
    lengths = cells.filter("part = 'l'").select(
        *keys,
        "k",
        F.when(F.col("broken") > 0, 0.0)
        .otherwise(F.lit(1.0) - F.least(ratio(F.col("err"), F.col("n")), F.lit(1.0)))
        .alias("length_acc"),
        F.col("n").alias("n_lengths"),
    )
    lengths = lengths.withColumn("length_acc", F.when(F.col("n_lengths") > 0, F.col("length_acc")).otherwise(0.0)).drop("n_lengths")
    base = base.join(lengths, [*keys, "k"], "left")
    loc_p, loc_r, loc_f = precision_recall_f(F.col("tp"), F.col("fp"), F.col("fn"))
    shore_f = precision_recall_f(F.col("tp_s"), F.col("fp_s"), F.col("fn_s"))[2]
    base = base.select(
        *keys,
        "k",
        loc_p.alias("loc_precision"),
        loc_r.alias("loc_recall"),
        loc_f.alias("loc_fscore"),
        shore_f.alias("loc_fscore_shore"),
        F.coalesce("length_acc", F.lit(0.0)).alias("length_acc"),
    )
    vessel = _class_scores(cells, base, "v", options.vessel_thresholds, keys, "is_vessel_fscore")
    fishing = _class_scores(cells, base, "f", options.fishing_thresholds, keys, "is_fishing_fscore")
    full = base.join(vessel, [*keys, "k"]).join(fishing, [*keys, "k"])
    full = full.withColumnsRenamed({"is_vessel_fscore": "vessel_fscore", "is_fishing_fscore": "fishing_fscore"})
    cut = F.lit(None).cast("double") if cuts is None else F.expr(f"element_at(array({', '.join(f'{t!r}D' for t in cuts)}), k + 1)")
    total = aggregate_score(
        F.col("loc_fscore"), F.col("length_acc"), F.col("vessel_fscore"), F.col("fishing_fscore"), F.col("loc_fscore_shore")
    )
    return full.select(
        *keys,
        cut.alias("objectness_threshold"),
        "is_vessel_threshold",
        "is_fishing_threshold",
        "loc_fscore",
        "loc_fscore_shore",
        "vessel_fscore",
        "fishing_fscore",
        "length_acc",
        total.alias("aggregate"),
    )


def detection_scores(
    pred: DataFrame, labels: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M, per_scene: bool = False, matcher=None
) -> DataFrame:
    """Detection counts, precision, recall and F1.

    ``matcher(pred, labels, tolerance_m)`` returns correct pairs with ``pred_id`` and
    ``scene_id``; the optimal matching is the default.
    """
    if matcher is None:
        from tidegrid.operators.matching import match as matcher
    pairs = matcher(pred, labels, tolerance_m)
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    seen = labels.select("scene_id", zero.alias("tp"), zero.alias("pred"), one.alias("gold"))
    seen = seen.unionByName(pred.select("scene_id", zero.alias("tp"), one.alias("pred"), zero.alias("gold")))
    seen = seen.unionByName(pairs.select("scene_id", one.alias("tp"), zero.alias("pred"), zero.alias("gold")))
    scenes = seen.groupBy("scene_id").agg(*[F.sum(n).alias(n) for n in ("tp", "pred", "gold")]).filter("gold > 0")
    total = scenes if per_scene else scenes.agg(*[F.sum(n).alias(n) for n in ("tp", "pred", "gold")])
    keys = ["scene_id"] if per_scene else []
    counts = total.select(*keys, "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))
    p, r, f = precision_recall_f(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", p.alias("loc_precision"), r.alias("loc_recall"), f.alias("loc_fscore"))


def score_thresholded(pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None = None, options: ScoreOptions | None = None) -> DataFrame:
    """One row of scores for detections that already carry ``is_vessel`` and ``is_fishing``; all given labels count."""
    options = replace(options or ScoreOptions(score_all=True, drop_low=False), vessel_thresholds=[1.0], fishing_thresholds=[1.0])
    flags = pred.withColumns(
        {
            "is_vessel_p": F.coalesce(F.col("is_vessel").cast("double"), F.lit(0.0)),
            "is_fishing_p": F.coalesce(F.col("is_fishing").cast("double"), F.lit(0.0)),
        }
    )
    scores = score_levels(flags, labels, shoreline, None, options)
    return scores.drop("objectness_threshold", "is_vessel_threshold", "is_fishing_threshold")


def score_multithreshold(pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None = None, **overrides) -> DataFrame:
    """Scores on a grid of class thresholds; all given labels count."""
    options = ScoreOptions(score_all=True, drop_low=False, **overrides)
    return score_levels(pred, labels, shoreline, None, options).drop("objectness_threshold")


def official_scores(pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None = None, **overrides) -> DataFrame:
    """Detections that pair with LOW labels are removed, then HIGH and MEDIUM labels are scored."""
    return score_levels(pred, labels, shoreline, None, ScoreOptions(**overrides)).drop("objectness_threshold")


def score_files(
    pred: DataFrame,
    labels: DataFrame,
    shoreline: DataFrame | None = None,
    scene_id: str | None = None,
    score_all: bool = False,
    drop_low_detect: bool = False,
    **overrides,
) -> DataFrame:
    """Score two tables with the options of the command-line scorer.

    One scene, or the labels of all scenes that have detections; LOW labels are
    left out unless ``score_all``; their matches too with ``drop_low_detect``.
    """
    if scene_id is not None:
        pred, labels = pred.filter(F.col("scene_id") == scene_id), labels.filter(F.col("scene_id") == scene_id)
    else:
        labels = labels.join(pred.select("scene_id").distinct(), "scene_id", "left_semi")
    options = ScoreOptions(score_all=score_all, drop_low=drop_low_detect, **overrides)
    return score_levels(pred, labels, shoreline, None, options).drop("objectness_threshold")


def sweep_thresholds(
    pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None = None, objectness: Sequence[float] | None = None, **overrides
) -> DataFrame:
    """Official scores for every objectness threshold, best first, in one job over the detections."""
    cuts = OBJECTNESS_THRESHOLDS if objectness is None else objectness
    return rank_summary(score_levels(pred, labels, shoreline, cuts, ScoreOptions(**overrides)))


def rank_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("aggregate"), "objectness_threshold", "is_vessel_threshold", "is_fishing_threshold")


THRESHOLDS = ("objectness_threshold", "is_vessel_threshold", "is_fishing_threshold")


def best_thresholds(summary: DataFrame) -> DataFrame:
    """The row with the best aggregate; among equals the smallest thresholds."""
    rank = F.struct(F.col("aggregate"), *[(-F.col(t)).alias("neg_" + t) for t in THRESHOLDS])
    best = summary.agg(F.max_by(F.struct(*THRESHOLDS, "aggregate"), rank).alias("b"))
    return best.select("b.*")


def scores_per_scene(
    pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None, vessel: float, fishing: float, **overrides
) -> DataFrame:
    """Each scene's score at the global class thresholds and at its own best ones.

    Detections are taken as they come, without an objectness cut.
    """
    options = ScoreOptions(per_scene=True, **overrides)
    grid = options.vessel_thresholds, options.fishing_thresholds
    options = replace(options, vessel_thresholds=sorted({*grid[0], vessel}), fishing_thresholds=sorted({*grid[1], fishing}))
    scores = score_levels(pred, labels, shoreline, None, options)
    return choose_per_scene(scores, vessel, fishing, grid)


def choose_per_scene(scores: DataFrame, vessel: float, fishing: float, grid: tuple[Sequence[float], Sequence[float]]) -> DataFrame:
    """From the scores of each scene on a grid: that at the given class thresholds, and the best one with its own."""
    # global thresholds off the grid are scored too, but are no choice of a scene
    off = [F.col(c) == x for c, x, own in (("is_vessel_threshold", vessel, grid[0]), ("is_fishing_threshold", fishing, grid[1])) if x not in own]
    choice = ~reduce(lambda a, b: a | b, off, F.lit(False))
    at_global = (F.col("is_vessel_threshold") == vessel) & (F.col("is_fishing_threshold") == fishing)
    rank = F.struct("aggregate", (-F.col("is_vessel_threshold")).alias("nv"), (-F.col("is_fishing_threshold")).alias("nf"))
    best = F.max_by(F.struct("aggregate", "is_vessel_threshold", "is_fishing_threshold"), F.when(choice, rank))
    per_scene = scores.groupBy("scene_id").agg(F.max(F.when(at_global, F.col("aggregate"))).alias("g"), best.alias("b"))
    return per_scene.select(
        "scene_id",
        F.col("g").alias("global_thresholds_score"),
        F.lit(float(vessel)).alias("global_is_vessel_threshold"),
        F.lit(float(fishing)).alias("global_is_fishing_threshold"),
        F.col("b.aggregate").alias("local_thresholds_score"),
        F.col("b.is_vessel_threshold").alias("local_is_vessel_threshold"),
        F.col("b.is_fishing_threshold").alias("local_is_fishing_threshold"),
    )


def sweep_folds(
    pred: DataFrame, labels: DataFrame, shoreline: DataFrame | None, folds: DataFrame, objectness: Sequence[float], **overrides
) -> DataFrame:
    """The threshold summary of each fold (``folds(scene_id, fold)``), all from one matching.

    Scenes without a fold are left out; a fold without labelled scenes has no rows.
    """
    options = ScoreOptions(**overrides)
    base, cells, cuts = count_levels(pred, labels, shoreline, objectness, options, ["scene_id"])
    return scores_from_counts(*over_scenes(base, cells, folds.select("scene_id", "fold")), cuts, options, ["fold"])


def mean_over_folds(summaries: DataFrame) -> DataFrame:
    """Mean aggregate of each threshold triple over the folds."""
    return summaries.groupBy(*THRESHOLDS).agg(F.avg("aggregate").alias("aggregate"))


def best_cell_per_objectness(means: DataFrame) -> DataFrame:
    """Best class thresholds for each objectness threshold; among equals the smallest."""
    rank = F.struct("aggregate", (-F.col("is_vessel_threshold")).alias("nv"), (-F.col("is_fishing_threshold")).alias("nf"))
    best = F.max_by(F.struct("is_vessel_threshold", "is_fishing_threshold", "aggregate"), rank)
    return means.groupBy("objectness_threshold").agg(best.alias("b")).select("objectness_threshold", "b.*")


def score_matrix(means: DataFrame, objectness: float, fishing_thresholds: Sequence[float] = CLASS_THRESHOLDS) -> DataFrame:
    """Mean scores of one objectness threshold as a matrix: a row per vessel threshold, a column per fishing one."""
    cut = means.filter(F.col("objectness_threshold") == float(objectness))
    return cut.groupBy("is_vessel_threshold").pivot("is_fishing_threshold", list(fishing_thresholds)).agg(F.first("aggregate"))


def paired_rows(pairs: DataFrame, pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Correct pairs with the classes and lengths of both sides (``p_...`` and ``g_...``)."""
    left = pred.select("pred_id", *[F.col(c).alias("p_" + c) for c in ("is_vessel", "is_fishing", "vessel_length_m")])
    right = labels.select("detect_id", *[F.col(c).alias("g_" + c) for c in ("is_vessel", "is_fishing", "vessel_length_m")])
    return pairs.select("scene_id", "pred_id", "detect_id").join(left, "pred_id").join(right, "detect_id")


def class_outcomes(paired: DataFrame, said: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN and TN of a yes/no class over correct pairs; unknown labels are left out."""
    return paired.groupBy(*keys).agg(
        F.count_if(said & truth).alias("tp"),
        F.count_if(said & ~truth).alias("fp"),
        F.count_if(~said & truth).alias("fn"),
        F.count_if(~said & ~truth).alias("tn"),
    )


def vessel_outcomes(paired: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return class_outcomes(paired, F.col("p_is_vessel"), F.col("g_is_vessel"), keys)


def fishing_outcomes(paired: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Only where the label is a vessel."""
    return class_outcomes(paired.filter("g_is_vessel"), F.col("p_is_fishing"), F.col("g_is_fishing"), keys)


def length_accuracy(paired: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One minus the mean capped relative error, not below 0; 0 without a known length or with a zero one."""
    known = paired.filter(F.col("g_vessel_length_m").isNotNull() & F.col("p_vessel_length_m").isNotNull())
    error = length_error(F.col("p_vessel_length_m"), F.col("g_vessel_length_m"))
    score = F.lit(1.0) - F.least(F.avg(error), F.lit(1.0))
    broken = F.count_if(F.col("g_vessel_length_m") == 0) > 0
    return known.groupBy(*keys).agg(F.when(broken | (F.count("*") == 0), 0.0).otherwise(score).alias("length_acc"))
