"""Substring dedup: word passages that occur earlier in the corpus are cut out.

Hashed windows stand in for suffix trees, which are not built.  Only windows that can repeat take part: of each window
of words the five-word gram with the lowest hash is its sample, equal windows have equal samples, and a window whose
sample occurs once cannot repeat.  Of samples of a gram that lie in the same words all but the first are repeats as a
whole.  The windows of the others are told apart by the hash of their words; those of a gram with many samples are
pre-aggregated before anything is sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import id_type
from tidegrid.llm.sampling_windows import MIX, SPREAD, rolled, samples, scrambled

GRAM = 5


def word_symbols(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their hashes laid end to end, and where each text ends."""
    rows = [t.encode().split() for t in texts]  # bytes are split at the six ASCII blanks only
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
    flat = np.array([w for r in rows for w in r], object)
    return rows, pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64), ends


def _sliced(batches, size=256):
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


def _samples(docs: DataFrame, window: int) -> DataFrame:
    """``gram, around, id, h, first, n``: the samples of all documents; ``around`` stands for all words of the windows."""

    def run(batches):
        for batch in _sliced(batches):
            _, symbols, ends = word_symbols([t or "" for t in batch.column("text").to_pylist()])
            gram, text, first, n, _ = samples(symbols, ends, window, GRAM)
            rows = pa.array(text, pa.int64())
            whole, at = rolled(symbols, window), first + np.concatenate([[0], ends[:-1]])[text]
            around = scrambled(whole[at] * MIX + whole[at + n - 1] * SPREAD + n.astype(np.uint64)) if len(at) else gram
            cols = [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), batch.column("id").take(rows), batch.column("h").take(rows), pa.array(first, pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "around", "id", "h", "first", "n"])

    return docs.mapInArrow(run, f"gram bigint, around bigint, id {id_type(docs, 'id')}, h int, first int, n int")


def _windows(joined: DataFrame, ranges: str, window: int) -> DataFrame:
    """``node, check, id, h, start``: the windows in the ranges of each document, by the hash of their words."""

    def run(batches):
        for batch in _sliced(batches):
            _, symbols, ends = word_symbols(batch.column("text").to_pylist())
            starts = np.concatenate([[0], ends[:-1]])
            lists = batch.column(ranges)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            first, n = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            owner = np.repeat(owner, n)
            where, rows = starts[owner] + at, pa.array(owner)
            node, check = rolled(symbols, window)[where], rolled(symbols, window, SPREAD ^ MIX | np.uint64(1))[where]
            cols = [pa.array(node.view(np.int64)), pa.array((check >> np.uint64(33)).astype(np.int32)), batch.column("id").take(rows), batch.column("h").take(rows), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "check", "id", "h", "start"])

    picked = joined.filter(F.size(ranges) > 0).select("id", "h", "text", ranges)
    return picked.mapInArrow(run, f"node bigint, check int, id {id_type(joined, 'id')}, h int, start int")


def stretches(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a stretch ``[start, end)``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group: int = 20_000) -> DataFrame:
    """``id_col, n_words, n_removed, kept``: every whole text without its repeated passages.

    A word goes when a ``window`` of words that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one.  Windows are judged on the input.  Words are compared as they are, through 95 bits of
    hash per window (128 where a whole sample is).  NULL ids come first; different texts with one id are different documents in the order of a hash
    of their text, rows equal in both are one document and get the same result each.  NULL and empty texts have no
    words.  ``kept`` joins the words that stay by one space.  Other columns are left out.

    ``group`` is how many samples a gram may have before its subtree is split by whole windows.
    """
    kind = id_type(df, id_col)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.select("id", F.hash("text").alias("h"), "text")  # tells texts of one id apart
    found = _samples(docs, window)
    repeated = found.groupBy("gram").count().filter("count > 1")
    joined = found.join(repeated, "gram")
    # every use of ``joined`` names all its columns, so that they share one exchange; of samples in equal words the first stands for all; it needs its windows only if its gram has other surroundings too
    sample, own = F.struct("id", "h", "first"), Window.partitionBy("gram")
    small = joined.filter(F.col("count") <= group)
    small = small.withColumns({"mixed": F.min("around").over(own) < F.max("around").over(own), "firsts": F.min(sample).over(Window.partitionBy("gram", "around"))})
    alike = small.filter(sample > F.col("firsts"))
    first = small.filter((sample == F.col("firsts")) & F.col("mixed"))
    ranges = (
        first.select("id", "h", "first", "n", "count")
        .unionByName(joined.filter(F.col("count") > group).select("id", "h", "first", F.when(F.col("around").isNotNull(), F.col("n")).alias("n"), "count"))
        .withColumn("range", F.struct("first", "n"))
        .groupBy("id", "h")
        .agg(F.collect_set(F.when(F.col("count") <= group, F.col("range"))).alias("few"), F.collect_set(F.when(F.col("count") > group, F.col("range"))).alias("many"))
        .withColumnsRenamed({"id": "rid", "h": "rh"})
    )
    spots = docs.join(ranges, F.col("id").eqNullSafe(F.col("rid")) & F.col("h").eqNullSafe(F.col("rh")))
    place = F.struct("id", "h", "start")

    few = _windows(spots, "few", window)
    later = few.withColumn("firsts", F.min(place).over(Window.partitionBy("node", "check"))).filter(place > F.col("firsts")).select("id", "h", "start")
    many = _windows(spots, "many", window)
    inner = many.groupBy("node", "check").agg(F.min(place).alias("firsts"), F.count("*").alias("below")).filter("below > 1").drop("below")
    later = later.unionByName(many.join(inner, ["node", "check"]).filter(place > F.col("firsts")).select("id", "h", "start"))

    later = later.select("id", "h", F.col("start").alias("first"), F.lit(1).alias("n")).unionByName(alike.select("id", "h", "first", "n"))
    cuts = later.groupBy("id", "h").agg(F.collect_list(F.struct("first", "n")).alias("cuts")).withColumnsRenamed({"id": "rid", "h": "rh"})
    final = docs.join(cuts, F.col("id").eqNullSafe(F.col("rid")) & F.col("h").eqNullSafe(F.col("rh")), "left").select("id", "text", "cuts")

    def run(batches):
        for batch in _sliced(batches):
            out = []
            for t, cut in zip(batch.column("text").to_pylist(), batch.column("cuts")):
                words = t.encode().split()
                gone = np.zeros(len(words), bool)
                if cut.is_valid:
                    first, n = (cut.values.field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
                    gone = stretches(len(words), first, first + n + window - 1)
                out.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()))
            cols = [batch.column("id"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "kept"])

    return final.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)
