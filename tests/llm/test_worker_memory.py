"""A Python worker serves many tasks: none leaves the garbage collector off, or an encoder behind."""

from tidegrid.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"


def test_tasks_leave_nothing_behind(spark):
    def look(batches):
        import gc

        import pyarrow as pa

        held = sum(type(x).__name__ == "Encoder" for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"off": [not gc.isenabled()], "held": pa.array([held], pa.int32())})

    bpe.encode(queries.documents(spark, FOLDER).repartition(8)).write.format("noop").mode("overwrite").save()
    seen = spark.range(0, 64, 1, 8).mapInArrow(look, "off boolean, held int").collect()
    assert seen and not any(r.off or r.held for r in seen)
