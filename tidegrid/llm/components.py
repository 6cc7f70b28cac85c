"""Connected components of a table of links: spanning stars of bounded blocks, then alternating stars between them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

BLOCK = 1_000_000  # links a task holds at once


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``low, node`` for every node but the smallest of its component, by hooking and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[hung]], nodes[hung]


def _forest(pairs: DataFrame, block: int) -> DataFrame:
    """Each block of links replaced by the stars of its own components; no shuffle."""

    def run(batches):
        held, n = [], 0

        def emptied():
            table = pa.Table.from_batches(held)
            low, node = stars(table.column("a").to_numpy(), table.column("b").to_numpy())
            return pa.record_batch({"a": pa.array(low, pa.int64()), "b": pa.array(node, pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if n + part.num_rows > block:
                    yield emptied()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield emptied()

    return pairs.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """``node, label`` for every node (a whole number) that a link joins to another: the smallest node of its component.

    Links are dealt into blocks of at most ``block``; a task replaces a block by the stars of its components, which has
    no more links than the block has nodes.  One block is thereby done.  Stars of several blocks are tied together by
    rounds that hang the larger neighbours of a node to its smallest one, then a node's smaller neighbours to the
    smallest, until nothing changes.  Minima are pre-aggregated, so a node with very many links costs its links, not
    their pairs.  Repeated links, loops and links with a NULL end change nothing; no links give no rows.
    """
    pairs = links.select(F.least(a, b).cast("bigint").alias("a"), F.greatest(a, b).cast("bigint").alias("b")).filter("a < b")
    before = None
    while True:
        pairs = cut_lineage(pairs)
        count, mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, mark) == before:
            break
        pieces = math.ceil(count / block)
        pairs = _forest(pairs.coalesce(max(1, pieces)), block)
        if pieces <= 1:
            pairs = cut_lineage(pairs)
            break
        before = (count, mark)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        pairs = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").union(low.filter("low < a").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()
        low = pairs.groupBy("b").agg(F.min("a").alias("low"))
        up = pairs.join(low, "b")
        pairs = up.select(F.col("low").alias("a"), "b").union(up.filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("label")).union(pairs.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
