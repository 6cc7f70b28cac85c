"""Helpers shared by the document operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a word is a run of characters outside this class
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


@contextmanager
def quiet_gc():
    """No garbage collection inside a task, whose stores hold no cycles and are costly to walk; at its end the worker gives memory back."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()


def per_document(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, columns: list[str], slice_rows: int = 256) -> DataFrame:
    """Run a batch function over documents inside Spark's partitions, without a shuffle.

    ``make()`` is called once per task and returns a function from a list of texts (``None`` becomes ``""``) to
    a dict of new columns.  ``columns[0]`` names the text; the others pass through unchanged.
    ``schema`` describes the pass-through columns followed by the new ones.
    """
    text, keep = columns[0], columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with quiet_gc():
            work = None
            for whole in batches:
                work = work or make()
                for start in range(0, whole.num_rows, slice_rows):
                    batch = whole.slice(start, slice_rows)
                    new = work([t or "" for t in batch.column(text).to_pylist()])
                    arrays = [batch.column(k) for k in keep]
                    arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in new.values()]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])
            whole = batch = new = arrays = work = None

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([text, *keep])]).mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Words of a text as an array; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def id_type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def ordered_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ascending order of ``keys``, in partitions that are ranges of it."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def digest(text: Column) -> Column:
    """SHA-256 in lower-case hex; NULL counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
