"""Prefix trie of conversations: one row for each distinct sequence of first turns, with aggregates over its subtree.

Conversations become paths: the codes of their turns one after another, 16 bytes each, so that byte order is the order
of a depth-first walk.  Paths are dealt out in ranges of (path, conversation id) and sorted.  The first path of each
shard splits the ranges; the trie of these splitters is the skeleton and goes to every shard.  All members of a node
outside the skeleton lie in one shard, which finishes it; nodes of the skeleton get a partial aggregate from each shard
that holds members, and these are reduced by node.  A group of equal conversations is thus split over shards like any
other run of rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

CODE = 16  # bytes of a turn's code
SHARD = 50_000  # paths in a shard, on average

PATHS = "path binary, sizes array<int>, conv_id bigint"
NODE = "conv_id bigint, depth int, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
LOCAL = f"skeleton boolean, node binary, parent binary, parent_conv_id bigint, {NODE}, last_size int, ends_sha256 string, ends binary, first_end bigint"


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, codes, sizes``: each conversation's turns in order, as codes of (role, text) and sizes of texts in code points.

    Turns are ordered by ``turn``, NULL first; equal numbers by code.  NULL roles and texts count as empty; rows without a
    ``conv_id`` belong to no conversation.  A conversation's turns meet in one row, 24 bytes each.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))  # hex, so that codes can be joined
    kept = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", code.alias("code"), F.length(text).alias("size")).alias("t"))
    rows = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.code").alias("codes"), F.col("t.size").alias("sizes"))


def share_openings(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are those of a common one.

    Conversation c opens with the first h turns of conversation ``c - c % every`` (all if it has fewer, none if it is
    not there) and goes on with its own after its first h; h is the CRC-32 of c in decimals modulo ``most``.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    shared = own.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("opening"), F.slice("codes", 1, most).alias("first_codes"), F.slice("sizes", 1, most).alias("first_sizes")
    )
    both = own.withColumns({"h": h, "opening": F.col("conv_id") - F.col("conv_id") % every}).join(shared, "opening", "left")

    def joined(first: str, rest: str):
        opening = F.coalesce(F.slice(first, F.lit(1), F.col("h")), F.slice(rest, 1, 0))
        return F.concat(opening, F.slice(rest, F.col("h") + 1, F.size(rest))).alias(rest)

    return both.select("conv_id", joined("first_codes", "codes"), joined("first_sizes", "sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b)) // CODE
    if a[: n * CODE] == b[: n * CODE]:
        return n
    lo, hi = 0, n  # the shared part ends in [lo, hi)
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * CODE] == b[: mid * CODE] else (lo, mid)
    return lo


def in_skeleton(path: bytes, splitters: list[bytes]) -> int:
    """Depth down to which the prefixes of a path are nodes of the trie of the sorted splitters."""
    at = bisect_right(splitters, path)
    return max((common(path, s) for s in splitters[max(at - 1, 0) : at + 1]), default=0)


def key(path: bytes) -> bytes:
    """Name of a node of the skeleton; a path itself can be long."""
    return hashlib.md5(path).digest()


class Node:
    __slots__ = ("depth", "size", "skeleton", "least", "convs", "children", "leaves", "saved", "digest", "ends", "first", "waiting")

    def __init__(self, depth: int, size: int, skeleton: bool):
        self.depth, self.size, self.skeleton = depth, size, skeleton
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.digest, self.ends, self.first = None, [], None
        self.waiting: list[tuple] = []  # finished children, until this node's smallest member is known

    def end(self, conv_id: int) -> None:
        """A member without further turns; members of one path come in ascending order."""
        if self.first is None:
            self.first = conv_id
        if self.skeleton:
            self.ends.append(conv_id)
        elif self.digest is None:
            self.digest = hashlib.sha256(str(conv_id).encode())
        else:
            self.digest.update(b",%d" % conv_id)


EMPTY = hashlib.sha256(b"").hexdigest()


def walk(rows: Iterator[tuple], splitters: list[bytes]) -> Iterator[tuple]:
    """Rows of ``LOCAL`` for the nodes of a shard, given its ``(path, sizes, conv_id)`` in order.

    Only the open path and the finished nodes whose parent is open are held.
    """
    stack: list[Node] = []
    before = None

    def close() -> Iterator[tuple]:
        node = stack.pop()
        above = stack[-1] if stack else None
        if not node.skeleton:
            node.leaves += node.children == 0
            node.saved += (node.convs - 1) * node.size
        if above is not None:
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
            above.children += not node.skeleton
        figures = (node.least, node.depth, node.convs, node.children, node.leaves, node.saved, node.size)
        name = key(before[: node.depth * CODE]) if node.skeleton else None
        yield from ((False, None, name, None if node.skeleton else node.least, *w) for w in node.waiting)
        if node.skeleton:
            up = key(before[: (node.depth - 1) * CODE]) if node.depth else None
            yield True, name, up, None, *figures, None, ",".join(map(str, node.ends)).encode(), node.first
        else:
            above.waiting.append((*figures, node.digest.hexdigest() if node.digest else EMPTY, None, None))

    for path, sizes, conv_id in rows:
        if path != before:
            shared = -1 if before is None else common(before, path)
            while len(stack) > shared + 1:
                yield from close()
            deep = in_skeleton(path, splitters)
            for depth in range(len(stack), len(path) // CODE + 1):
                stack.append(Node(depth, sizes[depth - 1] if depth else 0, depth <= deep))
            before = path
        top = stack[-1]
        top.convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.end(conv_id)
    while stack:
        yield from close()


def _digests(chunks: DataFrame) -> DataFrame:
    """``node, ends_sha256``: digest of a node's lists of ends, joined in order of their first ids, read as a stream."""

    def run(batches):
        name, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node != name:
                    done += [(name, digest.hexdigest())] if name is not None else []
                    name, digest = node, hashlib.sha256(ends)
                else:
                    digest.update(b"," + ends)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["node", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    return chunks.select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(run, "node binary, ends_sha256 string")


def _skeleton(partial: DataFrame) -> DataFrame:
    """Nodes of the skeleton from their partial aggregates: ``node, parent`` and the columns of ``NODE``.

    After the reduction by node a skeleton has at most (shards - 1) x longest path nodes, and these are all that one
    task adds up from the leaves to the root.
    """
    reduced = partial.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("last_size").alias("size"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    names = ["node", "parent", "depth", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def run(batches):
        nodes = [row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in names))]
        table = {r[0]: list(r) for r in nodes}
        for r in sorted(nodes, key=lambda r: -r[2]):
            _, up, _, size, _, convs, children, leaves, saved = table[r[0]]
            table[r[0]][7:] = leaves + (children == 0), saved + (convs - 1) * size
            if up is not None:
                above = table[up]
                above[6] += 1
                above[7] += table[r[0]][7] - r[7]  # what the shards did not know of
                above[8] += table[r[0]][8] - r[8]
        if table:
            rows = list(table.values())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], names=names)

    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), *[(n, pa.int64()) for n in names[2:]]])
    return reduced.select(*names).coalesce(1).mapInArrow(run, "node binary, parent binary, depth bigint, size bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")


def trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of ``conv_id, codes, sizes``.

    ``conv_id`` (smallest member), ``depth, parent_conv_id`` (NULL for the root), ``n_convs, n_children, n_leaves,
    saved_tokens`` (text that members share: over the subtree, members but one times the size of the last text) and
    ``ends_sha256`` (ids that end at the node, ascending).  Conversations without turns are members of the root; no
    conversations give no rows.
    """
    flat = rows.select(F.unhex(F.array_join("codes", "")).alias("path"), "sizes", F.col("conv_id").cast("bigint").alias("conv_id"))
    flat = cut_lineage(flat)
    spark = flat.sparkSession
    count = flat.count()
    if count == 0:
        return spark.createDataFrame([], RESULT)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // shard))
    ranges = flat.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    shards = cut_lineage(ranges.withColumn("shard", F.spark_partition_id()))
    # one path for each shard: the driver holds the splitters, not the paths
    splitters = sorted(r[0] for r in shards.groupBy("shard").agg(F.min("path").alias("p")).select("p").distinct().collect())

    def run(batches):
        def read():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv_id")))

        held: list[tuple] = []
        for row in walk(read(), splitters):
            held.append(row)
            if len(held) == 4096:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    types = [pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.string(), pa.binary(), pa.int64()]
    names = [c.split(" ")[0] for c in LOCAL.split(", ")]

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    local = cut_lineage(shards.select("path", "sizes", "conv_id").mapInArrow(run, LOCAL))
    top = _skeleton(local.filter("skeleton"))
    digests = _digests(local.filter("skeleton AND first_end IS NOT NULL"))
    up = top.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = top.join(up, "parent", "left").join(digests, "node", "left")
    ends = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    figures = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    # most nodes hang below another one of their shard; the others look their parent up among the few of the skeleton
    below = local.filter("NOT skeleton")
    hung = below.filter("parent IS NULL").select(*figures, ends)
    looked_up = below.filter("parent IS NOT NULL").drop("parent_conv_id").join(F.broadcast(up), "parent").select(*figures, ends)
    return hung.unionByName(looked_up).unionByName(top.select(*figures, ends))


RESULT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
