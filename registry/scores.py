"""Scores, threshold sweeps and their rankings."""

from pyspark.sql import functions as F

from registry.core import add
from registry.joins import MATCH, SHORE_PX
from registry.matching_sql import match_ctes
from tidegrid.constants import CLASS_THRESHOLDS
from tidegrid.functions import labels as L
from tidegrid.operators import matching as M
from tidegrid.operators import thresholds as T
from tidegrid.plans import evaluation as EV
from tidegrid.plans import scoring as SC

C = F.col
CUTS = (0.45, 0.5, 0.55)
V_AT, F_AT = CLASS_THRESHOLDS[17], CLASS_THRESHOLDS[18]


def ratio_sql(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})/CAST({b} AS DOUBLE) END"


def f1_sql(tp, fp, fn):
    p, r = ratio_sql(tp, f"{tp}+{fp}"), ratio_sql(tp, f"{tp}+{fn}")
    return f"(SELECT CASE WHEN p+r = 0 THEN 0 ELSE p*r*2/(p+r) END FROM (SELECT {p} AS p, {r} AS r))"


def score_ctes(cuts=(), key="t", drop_low=True, gold="confidence <> 'LOW'", vessel=None, fishing=None):
    """CTEs of the whole scoring ending in ``full_scores``; every matching is listed by brute force."""
    values = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(cuts)) or "(0, -1.0::DOUBLE)"

    def grid(values):
        if values is None:
            return "SELECT j, CASE WHEN j = 49 THEN 1.0 ELSE j*(1/49.0::DOUBLE) END AS thr FROM range(0, 50) r(j)"
        return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(values)) + ") v(j, thr)"

    everyone = "SELECT t, scene_id, detect_id, detect_scene_row AS r, detect_scene_column AS c FROM gt_fx, cuts"
    p1 = "SELECT * FROM p0"
    first = ""
    if drop_low:
        first = match_ctes("x", "SELECT * FROM p0", everyone) + ","
        p1 = "SELECT * FROM p0 ANTI JOIN (SELECT t, pred_id FROM x_m JOIN gt_fx USING (detect_id) WHERE confidence = 'LOW') USING (t, pred_id)"

    def classes(name, thresholds, score, truth, use):
        return f"""{name} AS (SELECT k.{key}, j, thr, {f1_sql('coalesce(tp,0)', 'coalesce(fp,0)', 'coalesce(fn,0)')} AS f FROM keys k CROSS JOIN ({grid(thresholds)}) LEFT JOIN
 (SELECT {key}, j, count(*) FILTER ({score} >= thr AND {truth}) AS tp, count(*) FILTER ({score} >= thr AND NOT {truth}) AS fp, count(*) FILTER ({score} < thr AND {truth}) AS fn
 FROM pairs, ({grid(thresholds)}) WHERE {use} GROUP BY 1, 2) USING ({key}, j))"""

    keys = "SELECT t FROM cuts" if key == "t" else "SELECT DISTINCT scene_id FROM gt_fx"
    return f"""WITH RECURSIVE cuts(t, cut) AS (VALUES {values}),
p0 AS MATERIALIZED (SELECT t, scene_id, pred_id, detect_scene_row AS r, detect_scene_column AS c FROM pred_fx, cuts WHERE objectness_p >= cut),
{first}
gold AS MATERIALIZED (SELECT * FROM gt_fx WHERE {gold}),
p1 AS MATERIALIZED ({p1}),
near AS MATERIALIZED (SELECT DISTINCT pred_id FROM pred_fx p JOIN shore_fx s ON s.scene_id = p.scene_id
 WHERE (detect_scene_row-pt_row)*(detect_scene_row-pt_row)+(detect_scene_column-pt_col)*(detect_scene_column-pt_col) BETWEEN 1 AND {SHORE_PX * SHORE_PX}),
ps AS MATERIALIZED (SELECT * FROM p1 WHERE pred_id IN (SELECT pred_id FROM near)),
gs AS MATERIALIZED (SELECT * FROM gold WHERE distance_from_shore_km <= 2),
{match_ctes("y", "SELECT * FROM p1", "SELECT t, scene_id, detect_id, detect_scene_row AS r, detect_scene_column AS c FROM gold, cuts")},
{match_ctes("z", "SELECT * FROM ps", "SELECT t, scene_id, detect_id, detect_scene_row AS r, detect_scene_column AS c FROM gs, cuts")},
per AS (SELECT t, g.scene_id, (SELECT count(*) FROM gold o WHERE o.scene_id = g.scene_id) AS ng, (SELECT count(*) FROM gs o WHERE o.scene_id = g.scene_id) AS ngs,
 (SELECT count(*) FROM p1 o WHERE o.scene_id = g.scene_id AND o.t = cuts.t) AS np, (SELECT count(*) FROM ps o WHERE o.scene_id = g.scene_id AND o.t = cuts.t) AS nps,
 (SELECT count(*) FROM y_m o WHERE o.scene_id = g.scene_id AND o.t = cuts.t) AS tp, (SELECT count(*) FROM z_m o WHERE o.scene_id = g.scene_id AND o.t = cuts.t) AS tps
 FROM (SELECT DISTINCT scene_id FROM gold) g, cuts),
keys AS ({keys}),
base AS (SELECT k.{key}, {f1_sql('tp', '(np-tp)', '(ng-tp)')} AS loc, {f1_sql('tps', '(nps-tps)', '(ngs-tps)')} AS shore FROM keys k JOIN (SELECT {key}, coalesce(sum(tp),0) AS tp, coalesce(sum(np),0) AS np, coalesce(sum(ng),0) AS ng,
 coalesce(sum(tps) FILTER (nps > 0 AND ngs > 0),0) AS tps, coalesce(sum(nps) FILTER (nps > 0 AND ngs > 0),0) AS nps, coalesce(sum(ngs) FILTER (nps > 0 AND ngs > 0),0) AS ngs FROM keys LEFT JOIN per USING ({key}) GROUP BY 1) s ON s.{key} = k.{key}),
pairs AS MATERIALIZED (SELECT t, y_m.scene_id, is_vessel_p, is_fishing_p, is_vessel, is_fishing, least(p.vessel_length_m, 500) AS pl, CASE WHEN g.vessel_length_m > 500 THEN 500 ELSE g.vessel_length_m END AS gl
 FROM y_m JOIN pred_fx p USING (pred_id) JOIN gold g USING (detect_id)),
len AS (SELECT {key}, 1 - least(avg(abs(pl-gl)/gl), 1) AS length_acc FROM pairs WHERE gl IS NOT NULL GROUP BY 1),
{classes('vf', vessel, 'is_vessel_p', 'is_vessel', 'is_vessel IS NOT NULL')},
{classes('ff', fishing, 'is_fishing_p', 'is_fishing', 'is_vessel AND is_fishing IS NOT NULL')},
full_scores AS MATERIALIZED (SELECT base.{key}, vf.thr AS v_thr, ff.thr AS f_thr, loc, shore, vf.f AS vessel, ff.f AS fishing, coalesce(length_acc, 0) AS len,
 loc*(1+coalesce(length_acc,0)+vf.f+ff.f+shore)/5 AS total FROM base JOIN vf USING ({key}) JOIN ff USING ({key}) LEFT JOIN len USING ({key}))"""


SCORES = """round(loc,6) AS loc_fscore, round(shore,6) AS loc_fscore_shore, round(vessel,6) AS vessel_fscore, round(fishing,6) AS fishing_fscore, round(len,6) AS length_acc, round(total,6) AS aggregate"""
AT = "round(v_thr,6) AS is_vessel_threshold, round(f_thr,6) AS is_fishing_threshold"
SHORE = {"shore_radius_px": SHORE_PX}


def flagged(fx):
    return T.apply_thresholds(fx.pred, 0.5, 0.338, 0.35)


def _paired(fx):
    pred, gold = flagged(fx), L.keep_confident(fx.gt)
    return SC.paired_rows(M.match(pred, gold), pred, gold)


PAIRED = score_ctes((0.5,), drop_low=False)
add(
    "a1_precision_recall_f1",
    lambda fx: SC.detection_scores(T.apply_thresholds(fx.pred, 0.5), L.keep_confident(fx.gt), per_scene=True),
    PAIRED
    + f""" SELECT scene_id, tp, np-tp AS fp, ng-tp AS fn, round({ratio_sql('tp', 'np')},6) AS loc_precision, round({ratio_sql('tp', 'ng')},6) AS loc_recall, round({f1_sql('tp', '(np-tp)', '(ng-tp)')},6) AS loc_fscore FROM per""",
)
add(
    "a2_vessel_outcomes",
    lambda fx: SC.vessel_outcomes(_paired(fx), ["scene_id"]),
    PAIRED
    + """ SELECT scene_id, count(*) FILTER (is_vessel_p >= 0.338 AND is_vessel) AS tp, count(*) FILTER (is_vessel_p >= 0.338 AND NOT is_vessel) AS fp,
 count(*) FILTER (is_vessel_p < 0.338 AND is_vessel) AS fn, count(*) FILTER (is_vessel_p < 0.338 AND NOT is_vessel) AS tn FROM pairs GROUP BY 1""",
)
add(
    "a3_fishing_outcomes",
    lambda fx: SC.fishing_outcomes(_paired(fx), ["scene_id"]),
    PAIRED
    + """ SELECT scene_id, count(*) FILTER (is_fishing_p >= 0.35 AND is_fishing) AS tp, count(*) FILTER (is_fishing_p >= 0.35 AND NOT is_fishing) AS fp,
 count(*) FILTER (is_fishing_p < 0.35 AND is_fishing) AS fn, count(*) FILTER (is_fishing_p < 0.35 AND NOT is_fishing) AS tn FROM pairs WHERE is_vessel GROUP BY 1""",
)
add(
    "a4_length_accuracy",
    lambda fx: SC.length_accuracy(_paired(fx), ["scene_id"]),
    PAIRED + " SELECT scene_id, round(1-least(avg(abs(pl-gl)/gl),1),6) AS length_acc FROM pairs WHERE gl IS NOT NULL GROUP BY 1",
)
add(
    "a5_shore_f1",
    lambda fx: SC.score_levels(fx.pred, fx.gt, fx.shore, [0.5], SC.ScoreOptions(per_scene=True, vessel_thresholds=[0.5], fishing_thresholds=[0.5], **SHORE)).select(
        "scene_id", "loc_fscore", "loc_fscore_shore"
    ),
    score_ctes((0.5,), "scene_id", vessel=[0.5], fishing=[0.5]) + " SELECT scene_id, round(loc,6) AS loc_fscore, round(shore,6) AS loc_fscore_shore FROM full_scores",
)
add(
    "a6_aggregate_score",
    lambda fx: fx.pred.select("pred_id", SC.aggregate_score(C("objectness_p"), C("is_vessel_p"), C("is_fishing_p"), C("objectness_p"), F.lit(0.5)).alias("aggregate")),
    "SELECT pred_id, round(objectness_p*(1.5+is_vessel_p+is_fishing_p+objectness_p)/5,6) AS aggregate FROM pred_fx",
)
add(
    "a7_score_thresholded",
    lambda fx: SC.score_thresholded(flagged(fx), L.keep_confident(fx.gt), fx.shore, SC.ScoreOptions(score_all=True, drop_low=False, **SHORE)),
    score_ctes((0.5,), drop_low=False, vessel=[0.338], fishing=[0.35]) + f" SELECT {SCORES} FROM full_scores",
)
add(
    "a8_score_class_thresholds",
    lambda fx: SC.score_multithreshold(fx.pred, L.keep_confident(fx.gt), fx.shore, **SHORE),
    score_ctes(drop_low=False) + f" SELECT {AT}, {SCORES} FROM full_scores",
)
add(
    "a9_official_scores",
    lambda fx: SC.official_scores(fx.pred, fx.gt, fx.shore, **SHORE),
    score_ctes() + f" SELECT {AT}, {SCORES} FROM full_scores",
)
add(
    "a9b_score_files",
    lambda fx: SC.score_files(fx.pred, fx.gt, fx.shore, score_all=True, **SHORE),
    score_ctes(drop_low=False, gold="scene_id IN (SELECT scene_id FROM pred_fx)") + f" SELECT {AT}, {SCORES} FROM full_scores",
)
add(
    "a9c_detection_f1",
    lambda fx: SC.detection_scores(fx.pred, fx.gt).select("tp", "loc_fscore"),
    MATCH
    + """ SELECT tp, round(2*tp/CAST(np+ng AS DOUBLE),6) AS loc_fscore FROM (SELECT count(*) AS tp FROM x_m), (SELECT count(*) AS np FROM pred_fx), (SELECT count(*) AS ng FROM gt_fx)""",
)
SWEEP = score_ctes(CUTS)
ALL = "objectness_threshold, is_vessel_threshold, is_fishing_threshold, loc_fscore, loc_fscore_shore, vessel_fscore, fishing_fscore, length_acc, aggregate"


def _evaluation(fx):
    """The scenes of a whole evaluation: their scores at the best triple of the sweep, and the detections that it keeps."""
    run = EV.evaluate(fx.pred, fx.gt, fx.shore, CUTS, **SHORE)
    kept = run.thresholded.groupBy("scene_id").agg(F.count("*").alias("n_kept"))
    best = F.lit(run.best["objectness_threshold"]).alias("objectness_threshold")
    return run.per_scene.join(kept, "scene_id", "left").select("*", best).withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))


def sweep(fx):
    return SC.sweep_thresholds(fx.pred, fx.gt, fx.shore, CUTS, **SHORE)


add("a10_threshold_sweep", sweep, SWEEP + f" SELECT cut AS objectness_threshold, {AT}, {SCORES} FROM full_scores JOIN cuts USING (t)")
BEST = "ORDER BY total DESC, cut, v_thr, f_thr"
add(
    "a12_best_thresholds",
    lambda fx: SC.best_thresholds(sweep(fx)),
    SWEEP + f" SELECT cut AS objectness_threshold, {AT}, round(total,6) AS aggregate FROM full_scores JOIN cuts USING (t) {BEST} LIMIT 1",
)
add(
    "o1_sorted_summary",
    lambda fx: SC.rank_summary(sweep(fx)).select("objectness_threshold", "is_vessel_threshold", "is_fishing_threshold", "aggregate"),
    SWEEP + f" SELECT cut AS objectness_threshold, {AT}, round(total,6) AS aggregate FROM full_scores JOIN cuts USING (t) {BEST}",
)
add(
    "o2_head_of_summary",
    lambda fx: sweep(fx).limit(5).select("objectness_threshold", "is_vessel_threshold", "is_fishing_threshold", "aggregate"),
    SWEEP + f" SELECT cut AS objectness_threshold, {AT}, round(total,6) AS aggregate FROM full_scores JOIN cuts USING (t) {BEST} LIMIT 5",
)
add(
    "a11_scores_per_scene",
    lambda fx: SC.scores_per_scene(fx.pred, fx.gt, fx.shore, V_AT, F_AT, **SHORE),
    score_ctes(key="scene_id")
    + f""", b AS (SELECT scene_id, max(total) FILTER (v_thr = 17*(1/49.0::DOUBLE) AND f_thr = 18*(1/49.0::DOUBLE)) AS own, max({{'t': total, 'v': -v_thr, 'f': -f_thr}}) AS best FROM full_scores GROUP BY 1)
 SELECT scene_id, round(own,6) AS global_thresholds_score, round({V_AT}::DOUBLE,6) AS global_is_vessel_threshold, round({F_AT}::DOUBLE,6) AS global_is_fishing_threshold,
 round(best.t,6) AS local_thresholds_score, round(-best.v,6) AS local_is_vessel_threshold, round(-best.f,6) AS local_is_fishing_threshold FROM b""",
)


FEW = [0.0, 0.2, 0.4, 0.6, 0.8]


def _folds(fx):
    return fx.scn.filter("fold >= 0").select("scene_id", "fold")


def _fold_summaries(fx):
    return SC.sweep_folds(fx.pred, fx.gt, fx.shore, _folds(fx), CUTS, vessel_thresholds=FEW, fishing_thresholds=FEW, **SHORE)


def _fold_sql(k):
    """The sweep over the scenes of one fold, on views cut to them; nothing where it has no labels."""
    text = f"{score_ctes(CUTS, vessel=FEW, fishing=FEW)} SELECT cut AS o, v_thr AS v, f_thr AS f, total AS a FROM full_scores JOIN cuts USING (t) WHERE EXISTS (SELECT 1 FROM gt_fx)"
    return f"SELECT * FROM ({text.replace('gt_fx', f'gt_of{k}').replace('pred_fx', f'pred_of{k}')})"


def _cut_to_fold(k):
    scenes = f"(SELECT scene_id FROM scn_fx WHERE fold = {k})"
    return f"gt_of{k} AS (SELECT * FROM gt_fx SEMI JOIN {scenes} USING (scene_id)), pred_of{k} AS (SELECT * FROM pred_fx SEMI JOIN {scenes} USING (scene_id))"


FOLDS_SQL = f"WITH {', '.join(_cut_to_fold(k) for k in range(4))}, m AS MATERIALIZED (SELECT o, v, f, avg(a) AS a FROM ({' UNION ALL '.join(_fold_sql(k) for k in range(4))}) GROUP BY 1, 2, 3)"
add(
    "a13_mean_over_folds",
    lambda fx: SC.mean_over_folds(_fold_summaries(fx)),
    FOLDS_SQL + " SELECT o AS objectness_threshold, v AS is_vessel_threshold, f AS is_fishing_threshold, round(a,6) AS aggregate FROM m",
)


def _cells(fx):
    """The highest mean of each objectness threshold; which cell holds it can hang on the last bit of a mean."""
    return SC.best_cell_per_objectness(SC.mean_over_folds(_fold_summaries(fx))).select("objectness_threshold", "aggregate")


add("a13_best_cells", _cells, FOLDS_SQL + " SELECT o AS objectness_threshold, round(max(a),6) AS aggregate FROM m GROUP BY 1")


def _matrix(fx):
    matrix = SC.score_matrix(SC.mean_over_folds(_fold_summaries(fx)), 0.5, FEW)
    names = [c for c in matrix.columns if c != "is_vessel_threshold"]
    return matrix.select("is_vessel_threshold", *[C(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names)])


add(
    "a13_score_matrix",
    _matrix,
    FOLDS_SQL + " SELECT v AS is_vessel_threshold, " + ", ".join(f"round(max(a) FILTER (f = {f}::DOUBLE),6) AS f{i}" for i, f in enumerate(FEW)) + " FROM m WHERE o = 0.5::DOUBLE GROUP BY 1",
)

add(
    "evaluation_run",
    _evaluation,
    f"""WITH best AS (SELECT * FROM ({SWEEP} SELECT cut, v_thr, f_thr FROM full_scores JOIN cuts USING (t) {BEST} LIMIT 1)),
 own AS (SELECT * FROM ({score_ctes(key="scene_id")} SELECT scene_id, v_thr, f_thr, total FROM full_scores)),
 per AS (SELECT o.scene_id, max(o.total) FILTER (o.v_thr = b.v_thr AND o.f_thr = b.f_thr) AS g, max({{'t': o.total, 'v': -o.v_thr, 'f': -o.f_thr}}) AS l, any_value(b.cut) AS cut, any_value(b.v_thr) AS v, any_value(b.f_thr) AS f FROM own o, best b GROUP BY 1)
 SELECT scene_id, round(g,6) AS global_thresholds_score, round(v,6) AS global_is_vessel_threshold, round(f,6) AS global_is_fishing_threshold, round(l.t,6) AS local_thresholds_score,
 round(-l.v,6) AS local_is_vessel_threshold, round(-l.f,6) AS local_is_fishing_threshold, (SELECT count(*) FROM pred_fx p WHERE p.scene_id = per.scene_id AND p.objectness_p >= per.cut) AS n_kept, round(CAST(cut AS DOUBLE),6) AS objectness_threshold FROM per""",
)
