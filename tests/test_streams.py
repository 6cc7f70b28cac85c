"""Scenes whose rows arrive in pieces, late, in surplus or twice."""

from tidegrid.session import new_folder
from tidegrid.streaming import scenes as ST

SCHEMA = "pred_id bigint, scene_id string, objectness_p double, vessel_length_m double"


def files(spark, *batches):
    path = new_folder(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path, expected, output, checkpoint):
    query = ST.process_new_scenes(ST.detection_stream(spark, path, SCHEMA, 1), expected, output, checkpoint)
    query.awaitTermination()
    assert query.exception() is None


def test_status_of_scenes_and_exact_values(spark):
    big = (1 << 53) + 1
    path = files(
        spark,
        [(big, "a", 0.1, None), (2, "b", 0.30000000000000004, 5.0), (9, "other", 0.5, 1.0)],
        [(3, "a", 0.2, 1e-9), (4, "b", 0.4, None), (5, "b", 0.5, 1.0)],
        [(6, "a", None, 2.0), (7, "never", 0.1, 1.0)],
    )
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("never", 2)], "scene_id string, n_rows int")
    output, checkpoint = new_folder(spark, "scenes"), new_folder(spark, "progress")
    run(spark, path, expected, output, checkpoint)
    got = {(r.pred_id, str(r.scene_id), r.objectness_p, r.vessel_length_m, r.status) for r in spark.read.parquet(output).collect()}
    first = {(big, "a", 0.1, None, "complete"), (3, "a", 0.2, 1e-9, "complete")}
    surplus = {(2, "b", 0.30000000000000004, 5.0, "surplus"), (4, "b", 0.4, None, "surplus"), (5, "b", 0.5, 1.0, "surplus")}
    late = {(6, "a", None, 2.0, "late")}
    # files may be picked up in any order: whichever row of a comes third is late
    assert {g[:4] for g in got} == {g[:4] for g in first | surplus | late}
    assert sorted(g[4] for g in got if g[1] == "a") == ["complete", "complete", "late"]
    assert len([g for g in got if g[1] == "b"]) == 3
    # the same files as a new stream: finished scenes are not written again
    run(spark, path, expected, output, new_folder(spark, "progress"))
    assert spark.read.parquet(output).count() == len(got)


def test_a_later_file_completes_a_scene_from_state(spark):
    expected = spark.createDataFrame([("a", 3)], "scene_id string, n_rows int")
    path, output, checkpoint = files(spark, [(1, "a", 0.1, 1.0)], [(2, "a", 0.2, 1.0)]), new_folder(spark, "scenes"), new_folder(spark, "progress")
    run(spark, path, expected, output, checkpoint)
    assert not [r for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(output).collect()]
    spark.createDataFrame([(3, "a", 0.3, 1.0)], SCHEMA).write.mode("append").parquet(path)
    run(spark, path, expected, output, checkpoint)
    assert sorted(r.pred_id for r in spark.read.parquet(output).collect()) == [1, 2, 3]


def test_output_has_no_folder_per_scene(spark):
    rows = [(i, f"s{i}", 0.5, 1.0) for i in range(30)]
    path, output = files(spark, rows), new_folder(spark, "scenes")
    expected = spark.createDataFrame([(f"s{i}", 1) for i in range(30)], "scene_id string, n_rows int")
    run(spark, path, expected, output, new_folder(spark, "progress"))
    assert spark.read.parquet(output).count() == 30
    assert len(spark.read.parquet(output).inputFiles()) < 30
