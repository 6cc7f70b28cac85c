"""Benchmark decontamination: documents that hold a benchmark item or nearly so, in DataFrame functions only.

For each item size, windows of that many words are taken where a document has enough of an item's shingles for any
similar window (a bound, so nothing is lost).  Windows and items get a SimHash of their shingles.  A multi-index finds
all fingerprints within ``RADIUS``: of ``BLOCKS`` blocks one differs in RADIUS / BLOCKS bits at most, so items are
stored under every such variant of each block.  Pairs within the radius are verified by their weighted shingles.
A document shorter than an item is one window, the whole of it, and is verified wherever the bound holds.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import words
from tidegrid.session import cut_lineage

SHINGLE = 5
BLOCKS, WIDTH = 8, 8  # blocks of a fingerprint, bits of a block
RADIUS = 23  # similar sets of 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9
FEW = 2_000_000  # rows of a table that may be broadcast


def _small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast if its counted rows allow it; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= FEW else df


def _shingle(tokens: Column, at) -> Column:
    return F.xxhash64(*[F.get(tokens, at + j) for j in range(SHINGLE)])


def _all_shingles(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(tokens) - SHINGLE), lambda i: _shingle(tokens, i)))


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint of an array of hashes, each as heavy as it is often."""

    def bit(b):
        votes = F.aggregate(shingles, F.lit(0), lambda a, x: a + F.when(x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) != 0, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(bit(b)))


def _block(fingerprint: Column, number: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, number * WIDTH).bitwiseAND(F.lit(2**WIDTH - 1).cast("bigint")).cast("int")


def least_shared(size: Column, own: Column, percent: int) -> Column:
    """Fewest shingles that an item of ``size`` shingles and a window of ``own`` share when they are similar enough."""
    return F.ceil(F.lit(percent) * (size + own) / F.lit(100 + percent) - F.lit(1e-9)).cast("int")


def overlap(a: Column, b: Column) -> Column:
    """Weight that two arrays share: each distinct value as often as the array that has it less often."""
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``text_key, words_n, size, own, print``: each different text of the benchmark with a shingle, once."""
    own = benchmark.select(F.lower(F.col(f"`{text_col}`")).alias("t")).filter("t IS NOT NULL").select(words(F.col("t")).alias("w"))
    own = own.filter(F.size("w") >= SHINGLE).select(F.concat_ws(" ", "w").alias("text_key"), "w").dropDuplicates(["text_key"])
    own = own.select("text_key", F.size("w").alias("words_n"), _all_shingles(F.col("w")).alias("own"))
    return own.select("text_key", "words_n", F.size("own").alias("size"), "own", simhash(F.col("own")).alias("print"))


def windows_of(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """``id, h, size, start, keys, shingles``: item-sized windows with enough shingles of an item.

    A document of fewer shingles than ``size`` is one window, and ``keys`` are the items it has enough shingles of.
    """
    tokens = docs.select("id", "h", words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    places = tokens.select("id", "h", "w", F.posexplode("w").alias("at", "_")).filter(F.col("at") <= F.size("w") - SHINGLE)
    places = places.select("id", "h", "at", (F.size("w") - SHINGLE + 1).alias("have"), _shingle(F.col("w"), F.col("at")).alias("shingle"))
    postings = items.select("text_key", "size", F.explode(F.array_distinct("own")).alias("shingle"))
    hits = places.join(_small(postings), "shingle")
    least = least_shared(F.col("size"), F.least("have", "size"), percent)
    enough = hits.groupBy("id", "h", "size", "text_key").agg(F.sort_array(F.collect_set("at")).alias("hits"), F.max("have").alias("have")).filter(F.size("hits") >= least)
    short = F.col("have") < F.col("size")
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(p - F.col("size") + 1, F.lit(0)), p))))
    full = F.filter(starts, lambda s: F.size(F.filter("hits", lambda p: (p >= s) & (p < s + F.col("size")))) >= least)
    full = F.when(short, F.array(F.lit(0))).otherwise(full)
    # a document's windows of one size are needed once, whichever items led to them
    wanted = enough.groupBy("id", "h", "size").agg(F.array_distinct(F.flatten(F.collect_list(full))).alias("starts"), F.sort_array(F.collect_set(F.when(short, F.col("text_key")))).alias("keys")).filter(F.size("starts") > 0)
    wanted = cut_lineage(wanted.withColumnsRenamed({"id": "wid", "h": "wh"}))  # counted and used: not to be made twice
    both = docs.join(_small(wanted), F.col("id").eqNullSafe(F.col("wid")) & F.col("h").eqNullSafe(F.col("wh"))).withColumn("w", words(F.col("text")))
    rows = both.select("id", "h", "size", "keys", "w", F.explode("starts").alias("start")).filter((F.size("keys") > 0) | (F.col("start") + F.col("size") + SHINGLE - 1 <= F.size("w")))
    cut = F.slice("w", F.col("start") + 1, F.col("size") + SHINGLE - 1)
    return rows.select("id", "h", "size", "start", "keys", cut.alias("v")).select("id", "h", "size", "start", "keys", _all_shingles(F.col("v")).alias("shingles"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """``id_col, item_col, n_windows, similarity``: which documents hold which benchmark items.

    A document holds an item if one of its windows of as many words as the item has a weighted Jaccard similarity of
    ``percent`` / 100 or more with it: common weight over total weight of the five-word shingles, in lower case, a
    shingle weighing as often as it occurs.  A document of fewer words than the item is one window as a whole.  ``similarity`` is the best window's, ``n_windows`` how many reach the
    limit.  Items and documents of fewer than five words, NULL and empty texts hold no shingle and match nothing.  All
    items with the same words are reported; equal rows give one row.  Other columns are left out.  No Python.

    Hashes are of 64 bits; windows farther than RADIUS from an item are lost: about one in a million of those just at
    the limit, none of the exact copies and none of the documents shorter than the item.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text")).filter("text IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text")
    items = items_of(benchmark, item_col, item_text)
    windows = cut_lineage(windows_of(rows, items, percent).distinct().withColumn("key", F.xxhash64("shingles")))
    # equal windows of different documents are compared once
    distinct = windows.filter(F.size("keys") == 0).groupBy("size", "key").agg(F.first("shingles").alias("shingles"))
    prints = distinct.select("size", "key", "shingles", simhash(F.col("shingles")).alias("window_print"))

    flips = [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), k)]
    number = F.explode(F.array(*[F.lit(i) for i in range(BLOCKS)])).alias("block")
    left = prints.select("*", number).withColumn("value", _block(F.col("window_print"), F.col("block")))
    right = items.select("*", number).withColumn("flip", F.explode(F.array(*[F.lit(f) for f in flips])))
    right = right.withColumn("value", _block(F.col("print"), F.col("block")).bitwiseXOR(F.col("flip"))).drop("flip")
    near = left.join(right, ["size", "block", "value"]).filter(F.bit_count(F.col("window_print").bitwiseXOR(F.col("print"))) <= RADIUS)
    short = windows.select("size", "key", "shingles", F.explode("keys").alias("text_key")).join(items.select("text_key", "own"), "text_key")
    near = near.select("size", "key", "text_key", "shingles", "own").unionByName(short)
    near = near.groupBy("size", "key", "text_key").agg(F.first("shingles").alias("shingles"), F.first("own").alias("own"))
    near = near.withColumn("both", overlap(F.col("shingles"), F.col("own")))
    near = near.withColumn("all", F.col("size") + F.size("shingles") - F.col("both")).filter(100 * F.col("both") >= percent * F.col("all"))
    alike = near.select("size", "key", "text_key", (F.col("both") / F.col("all")).alias("similarity"))

    named = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.concat_ws(" ", words(F.lower(F.col(f"`{item_text}`")))).alias("text_key")).distinct()
    found = windows.select("id", "h", "size", "start", "key").join(alike, ["size", "key"]).join(named, "text_key")
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.count_distinct("h", "start").alias("n_windows"), F.max("similarity").alias("similarity"))


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold an item; a NULL id is an id."""
    bad = found.select(F.col(f"`{id_col}`").alias("_held")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_held"]), "left_anti")
