"""Readers of label, detection, scene and shoreline tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schemas
from tidegrid.functions.labels import folder_of_path, scene_of_path, scene_path


def _csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Labels with their folder; empty fields are NULL, also in the three-valued flags."""
    return _csv(spark, path, schemas.LABELS).withColumn("folder", F.lit(folder))


def read_scene_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SCENE_SIZES)


def read_scene_split(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SCENE_SPLIT)


def read_detections(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.DETECTIONS) -> DataFrame:
    return _csv(spark, path, schema)


def resolve_shoreline(scenes: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Shoreline points of the scenes, from the first source that knows each scene.

    A source is a point table; a scene whose shoreline is empty has one row with
    NULL coordinates.  A scene that no source knows is an error.
    """
    tagged = None
    for rank, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy("scene_id").agg(F.min("_source").alias("_source"))
    wanted = scenes.select("scene_id").distinct().join(first, "scene_id", "left")
    unknown = F.concat(F.lit("no shoreline for scene "), F.col("scene_id"))
    wanted = wanted.withColumn("_source", F.coalesce("_source", F.raise_error(unknown).cast("int")))
    points = tagged.join(wanted, ["scene_id", "_source"], "left_semi").drop("_source")
    return points.filter(F.col("pt_row").isNotNull())


def scene_paths(scenes: DataFrame, root: str, split: str | None = None) -> DataFrame:
    """Path of each scene, of one split or of all."""
    chosen = scenes if split is None else scenes.filter(F.col("official_split") == split)
    return chosen.withColumn("scene_path", scene_path(root, F.col("official_split"), F.col("scene_id")))


def parse_paths(df: DataFrame, path: str) -> DataFrame:
    """Scene id and folder of a path."""
    return df.withColumns({"scene_of_path": scene_of_path(F.col(path)), "folder_of_path": folder_of_path(F.col(path))})


def parse_split_names(df: DataFrame, name: str) -> DataFrame:
    """Split and scene of names like ``train_<scene>.png``."""
    stem = scene_of_path(F.col(name))
    parts = F.split(stem, "_")
    return df.withColumns({"split_of_name": parts[0], "scene_of_name": parts[1]})
