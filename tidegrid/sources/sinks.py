"""Writers: detections by scene, thresholded tables, maps, and the list of scenes still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schemas
from tidegrid.operators.thresholds import threshold_tables


def write_per_scene(detections: DataFrame, path: str, form: str = "csv") -> None:
    """One folder per scene; only scenes in the table are replaced, so a rerun is harmless.

    Rows of a scene are spread over a few files, not sent to one task.
    """
    writer = detections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id")
    (writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path))


def read_per_scene(spark: SparkSession, path: str, schema: str = schemas.DETECTIONS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_threshold_tables(detections: DataFrame, triples: Sequence[tuple[float, float, float]], path: str) -> None:
    cut = threshold_tables(detections, triples)
    cut.write.mode("overwrite").partitionBy("obj_t", "vsl_t", "fsh_t").option("header", True).csv(path)


def write_summary(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def write_maps(maps: DataFrame, path: str) -> None:
    """Merged maps by scene."""
    writer = maps.repartition("scene_id", F.floor(F.col("r") / 512)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MAPS).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def finished_scenes(spark: SparkSession, path: str, schema: str = "scene_id STRING") -> DataFrame:
    """Scenes that already have output; none when nothing was written yet.  A table of another schema is an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).distinct()


def pending_scenes(scenes: DataFrame, finished: DataFrame) -> DataFrame:
    return scenes.join(finished, "scene_id", "left_anti")
