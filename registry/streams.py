"""Streaming: files of detections processed as they arrive."""

from pyspark.sql import functions as F

from registry.core import add
from registry.joins import SHORE_PX
from registry.scores import F_AT, V_AT, score_ctes
from tidegrid.session import new_folder
from tidegrid.streaming import scenes as ST

C = F.col


def _arrived(fx):
    """Detections as files that a stream picks up one per batch; every scene is spread over all files."""
    path = new_folder(fx.spark, "arriving")
    fx.pred.repartition(4, "pred_id").write.parquet(path)
    return ST.detection_stream(fx.spark, path, fx.pred.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), 1)


def _expected(fx):
    return fx.pred.groupBy("scene_id").agg(F.count("*").alias("n_rows"))


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _once(fx):
    output, checkpoint = new_folder(fx.spark, "scenes"), new_folder(fx.spark, "progress")
    stream = _arrived(fx)
    _finish(ST.process_new_scenes(stream, _expected(fx), output, checkpoint))
    # the same files again, as a new stream: every scene is already there
    _finish(ST.process_new_scenes(stream, _expected(fx), output, new_folder(fx.spark, "progress")))
    return fx.spark.read.parquet(output).filter(C("status") == ST.COMPLETE).select("pred_id", C("scene_id").cast("string").alias("scene_id"), "objectness_p")


add("st1_scenes_once", _once, "SELECT pred_id, scene_id, objectness_p FROM pred_fx")


def _cut(fx):
    output = new_folder(fx.spark, "cut")
    _finish(ST.threshold_stream(_arrived(fx), output, new_folder(fx.spark, "progress"), 0.5, 0.338, 0.35))
    return fx.spark.read.parquet(output).select("pred_id", "is_vessel", "is_fishing")


add("st2_threshold_stream", _cut, "SELECT pred_id, is_vessel_p >= 0.338 AS is_vessel, is_fishing_p >= 0.35 AS is_fishing FROM pred_fx WHERE objectness_p >= 0.5")


def _score(fx):
    output = new_folder(fx.spark, "scores")
    stream = _arrived(fx)
    for _ in range(2):  # the second stream finds every scene scored
        _finish(ST.score_stream(stream, fx.gt, fx.shore, _expected(fx), output, new_folder(fx.spark, "progress"), V_AT, F_AT, shore_radius_px=SHORE_PX))
    return fx.spark.read.parquet(output).select(C("scene_id").cast("string").alias("scene_id"), "global_thresholds_score", "local_thresholds_score")


add(
    "st3_score_stream",
    _score,
    score_ctes(key="scene_id")
    + """ SELECT scene_id, round(max(total) FILTER (v_thr = 17*(1/49.0::DOUBLE) AND f_thr = 18*(1/49.0::DOUBLE)),6) AS global_thresholds_score, round(max(total),6) AS local_thresholds_score FROM full_scores GROUP BY 1""",
)
