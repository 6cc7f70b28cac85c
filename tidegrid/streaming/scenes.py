"""Scenes that arrive as files, processed once each."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.thresholds import apply_thresholds
from tidegrid.plans.scoring import scores_per_scene
from tidegrid.sources.sinks import finished_scenes, pending_scenes


def detection_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _run_name(checkpoint: str) -> str:
    return f"{zlib.crc32(checkpoint.encode()):08x}"


COMPLETE, SURPLUS, LATE = "complete", "surplus", "late"


def complete_scenes(stream: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of each scene, all in the batch in which the last of them arrived, with their ``status``.

    ``expected(scene_id, n_rows)`` announces the scenes; rows of others are left out.  Rows wait in the state of their
    scene, so a batch costs its own rows and those it completes, however many batches came before.  A scene with more
    rows than announced comes as ``surplus``, rows after that as ``late``; both are handed on, not dropped.  A scene's
    waiting rows are one state value; those of a finished scene are gone from the state.
    """
    announced = expected.select("scene_id", F.col("n_rows").cast("bigint").alias("n_rows"))
    # rows travel as JSON: whole numbers with NULLs would become floating in pandas
    rows = stream.join(announced, "scene_id").select("scene_id", "n_rows", F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns])).alias("row"))

    def collect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have, done, held = state.get if state.exists else (0, False, [])
        new, wanted = [], None
        for frame in frames:
            new += frame["row"].tolist()
            wanted = int(frame["n_rows"].iloc[0])
        have += len(new)
        if done:
            yield pd.DataFrame({"status": LATE, "row": new})
        elif have >= wanted:
            yield pd.DataFrame({"status": COMPLETE if have == wanted else SURPLUS, "row": [*held, *new]})
        if done or have >= wanted:
            state.update((have, True, []))
        else:
            state.update((have, False, [*held, *new]))

    kept = rows.groupBy("scene_id").applyInPandasWithState(
        collect, "status string, row string", "have bigint, done boolean, held array<string>", "append", GroupStateTimeout.NoTimeout
    )
    return kept.select("status", F.from_json("row", stream.schema).alias("r")).select("r.*", "status")


def _unfinished(stream: DataFrame, output: str, run: str) -> DataFrame:
    """Rows of scenes that no other run has written."""
    written = finished_scenes(stream.sparkSession, output, "marker STRING, scene_id STRING")
    return pending_scenes(stream, written.filter(~F.startswith("marker", F.lit(run + "-"))).select("scene_id").distinct())


def process_new_scenes(stream: DataFrame, expected: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write each scene's rows once, as soon as all of them arrived; scenes that already have output are skipped.

    Rows of a scene may come in any number of files and batches.  Every batch writes under its own marker, so a batch
    that is replayed replaces what it had written; scenes are a column there, not folders.  ``status`` tells scenes with surplus rows and late rows apart.
    """
    run = _run_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        ready = batch.withColumn("marker", F.lit(f"{run}-{batch_id}")).write.mode("overwrite")
        ready.option("partitionOverwriteMode", "dynamic").partitionBy("marker").parquet(output)

    ready = complete_scenes(_unfinished(stream, output, run), expected)
    return ready.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def threshold_stream(stream: DataFrame, output: str, checkpoint: str, objectness: float, vessel: float, fishing: float) -> StreamingQuery:
    """Cut arriving detections by score; no state is kept."""
    cut = apply_thresholds(stream, objectness, vessel, fishing)
    return cut.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(
    stream: DataFrame,
    labels: DataFrame,
    shoreline: DataFrame | None,
    expected: DataFrame,
    output: str,
    checkpoint: str,
    vessel: float,
    fishing: float,
    **overrides,
) -> StreamingQuery:
    """Score each scene once, when all its detections arrived, surplus ones included; late ones change nothing.

    ``output`` is kept by run and batch, not by scene: a folder and files for each scene would cost far more than its rows.
    """
    run = _run_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        ready = batch.filter(F.col("status") != LATE).drop("status").persist()  # the state is gone over once
        if ready.isEmpty():
            ready.unpersist()
            return
        here = labels.join(ready.select("scene_id").distinct(), "scene_id", "left_semi")
        scores = scores_per_scene(ready, here, shoreline, vessel, fishing, **overrides)
        writer = scores.withColumn("marker", F.lit(f"{run}-{batch_id}")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("marker").parquet(output)
        ready.unpersist()

    ready = complete_scenes(_unfinished(stream, output, run), expected)
    return ready.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
