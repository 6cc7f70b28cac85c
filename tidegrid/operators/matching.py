"""One-to-one matching of detections to labels at a bounded distance.

Only pairs within the tolerance can ever count, so the matching falls apart into
connected components of the candidate edges.  The steps:

1. detections and labels are counted per pixel (and per threshold level), where
   more than three share one, which bounds every later group by its number of pixels;
2. both go to square blocks of the scene, labels also to the blocks next to them
   that they reach, and a task finds the candidate edges of its blocks by grid cells;
3. a block solves all of its components that no other block can touch;
4. the few components across block borders are joined by label passing between
   blocks and then solved one by one; a component too large for a task is solved
   piece by piece (see ``wide``).

A whole sweep over score thresholds is one run: each component is solved once per
distinct set of present detections, and a match row carries the range of
threshold numbers ``[k_from, k_to)`` it holds for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.constants import DISTANCE_TOLERANCE_M, PIX_TO_M
from tidegrid.operators.assign import EDGE_COLUMNS, MATCH_SCHEMA, PAIRED, PAIRED_LOW, PAIRED_SHORE, solve_edges
from tidegrid.operators.ranking import chunked_rank, hash_chunk
from tidegrid.operators.spatial import cell_of, close_pairs, pairs_within
from tidegrid.operators.wide import FIRST_BLOCK, solve_wide
from tidegrid.session import cut_lineage

KIND_NAMES = {PAIRED: "paired", PAIRED_SHORE: "paired_shore", PAIRED_LOW: "paired_low"}
BLOCK_PX = 2048
MATCH_COLUMNS = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
BLOCK_SCHEMA = MATCH_SCHEMA + ", pn BIGINT, gn BIGINT, k INT, low BOOLEAN, gs BOOLEAN, part BIGINT, border BOOLEAN, p_r BIGINT, p_c BIGINT, g_r BIGINT, g_c BIGINT"
ARROW_TYPES = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "BOOLEAN": pa.bool_()}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


MATCH_ARROW, BLOCK_ARROW = _arrow_schema(MATCH_SCHEMA), _arrow_schema(BLOCK_SCHEMA)
# groups of blocks that a task of the first step takes one after another
GROUPS_PER_TASK = 4
# edges a task solves at once in the second step
EDGES_PER_GROUP = 200_000
# edges of a component above which it is solved piece by piece
COMPONENT_EDGES = 2_000_000
PLACE_COLUMNS = ["p_r", "p_c", "g_r", "g_c"]
NODE_KEYS_P = ("scene_id", "detect_scene_row", "detect_scene_column", "k", "ps")
NODE_KEYS_G = ("scene_id", "detect_scene_row", "detect_scene_column", "low", "gs")


def threshold_level(column: str, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds the score reaches; a missing score reaches none.

    A balanced tree of comparisons: as many as the logarithm of the list, in generated code.
    It is one piece of SQL text, which costs one call instead of hundreds.
    """

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        yes, no = search(mid + 1, hi), search(lo, mid)
        return f"CASE WHEN {column} >= {float(thresholds[mid])!r}D THEN {yes} ELSE {no} END"

    return F.expr(f"CASE WHEN {column} IS NULL OR isnan({column}) THEN 0 ELSE {search(0, len(thresholds))} END")


def _pred_nodes(pred: DataFrame, thresholds: Sequence[float] | None, shore: bool) -> DataFrame:
    if "k" in pred.columns:
        level = F.col("k")
    else:
        level = F.lit(1) if thresholds is None else threshold_level("objectness_p", thresholds)
    marked = pred.select(
        "pred_id",
        "scene_id",
        F.col("detect_scene_row").cast("bigint").alias("detect_scene_row"),
        F.col("detect_scene_column").cast("bigint").alias("detect_scene_column"),
        level.alias("k"),
        (F.col("near_shore") if shore else F.lit(False)).alias("ps"),
    )
    return marked.filter("k > 0")


def _label_nodes(labels: DataFrame, drop_low: bool, shore: bool) -> DataFrame:
    return labels.select(
        "detect_id",
        "scene_id",
        F.col("detect_scene_row").cast("bigint").alias("detect_scene_row"),
        F.col("detect_scene_column").cast("bigint").alias("detect_scene_column"),
        (F.coalesce(F.col("confidence") == "LOW", F.lit(False)) if drop_low else F.lit(False)).alias("low"),
        (F.col("near_shore") if shore else F.lit(False)).alias("gs"),
    )


def _nodes(rows: DataFrame, keys: Sequence[str], row_id: str, node: str, copies: str) -> DataFrame:
    """Rows put together by pixel; up to three on one pixel stay nodes of their own, as their ids decide between equals.

    Least, sum and largest name three ids, so no list of ids is kept of a pixel with many.
    """
    lo, hi, n = F.col("_lo"), F.col("_hi"), F.col("_n")
    grouped = rows.groupBy(*keys).agg(F.min(row_id).alias("_lo"), F.max(row_id).alias("_hi"), F.try_sum(row_id).alias("_sum"), F.count("*").alias("_n"))
    mid = F.when(n == 3, F.col("_sum") - lo - hi)
    ids = F.when((n == 2) & (lo < hi), F.array(lo, hi)).when((lo < mid) & (mid < hi), F.array(lo, mid, hi))
    single = F.when(ids.isNotNull(), F.lit(1).cast("bigint")).otherwise(n)
    named = grouped.withColumns({copies: single, node: F.explode(F.coalesce(ids, F.array(lo)))})
    return named.drop("_lo", "_hi", "_sum", "_n")


def block_nodes(preds: DataFrame, labels: DataFrame, block: int, reach: int, buckets: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """Pixel nodes by the blocks that pair them; a node of copies is named by the smallest id on it.

    A detection belongs to one block, a label goes to every block that holds a place within its reach.
    """
    p = _nodes(preds, NODE_KEYS_P, "pred_id", "p", "pn")
    p = p.withColumnsRenamed({"detect_scene_row": "p_r", "detect_scene_column": "p_c"})
    p = p.withColumns({"block_r": cell_of(F.col("p_r"), block), "block_c": cell_of(F.col("p_c"), block)})
    g = _nodes(labels, NODE_KEYS_G, "detect_id", "g", "gn")
    g = g.withColumnsRenamed({"detect_scene_row": "g_r", "detect_scene_column": "g_c"})
    for axis, at in (("block_r", F.col("g_r")), ("block_c", F.col("g_c"))):
        g = g.withColumn(axis, F.explode(F.sequence(cell_of(at - reach, block), cell_of(at + reach, block))))

    def dealt(nodes: DataFrame) -> DataFrame:
        there = nodes.filter("scene_id IS NOT NULL AND block_r IS NOT NULL AND block_c IS NOT NULL")
        bucket = F.pmod(F.xxhash64("scene_id", "block_r", "block_c"), F.lit(groups))
        return there.withColumn("bucket", bucket).repartition(buckets, "bucket")

    return dealt(p), dealt(g)


def candidate_edges(p: pa.Table, g: pa.Table, radius_px: float) -> pa.Table:
    """Edges between the nodes of each block."""
    scene = pa.chunked_array([*p["scene_id"].chunks, *g["scene_id"].chunks], p["scene_id"].type).combine_chunks().dictionary_encode()
    if isinstance(scene, pa.ChunkedArray):
        scene = scene.combine_chunks()
    group = scene.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for n in ("block_r", "block_c"):
        names, at = np.unique(np.concatenate([p[n].to_numpy(), g[n].to_numpy()]), return_inverse=True)
        group = group * len(names) + at
    ends = (group[: len(p)], p["p_r"].to_numpy(), p["p_c"].to_numpy()), (group[len(p) :], g["g_r"].to_numpy(), g["g_c"].to_numpy())
    i, j, d2 = close_pairs(*ends, radius_px)
    edges = p.drop_columns(["bucket"]).take(pa.array(i))
    theirs = g.select([n for n in g.column_names if n not in (*p.column_names, "bucket")]).take(pa.array(j))
    for n in theirs.column_names:
        edges = edges.append_column(n, theirs[n])
    return edges.append_column("d2", pa.array(d2, pa.int64()))


def _columns(table: pa.Table) -> tuple[dict, pa.Array]:
    """Numpy columns of an edge table, scenes as numbers, and the scene names."""
    scene = table["scene_id"].combine_chunks().dictionary_encode()
    if isinstance(scene, pa.ChunkedArray):
        scene = scene.combine_chunks()
    names = [n for n in table.column_names if n != "scene_id"]
    edges = {n: table[n].to_numpy(zero_copy_only=False) for n in names}
    edges["scene"] = scene.indices.to_numpy(zero_copy_only=False)
    return edges, scene.dictionary


def _match_table(rows: dict, scenes: pa.Array) -> pa.Table:
    columns = {n: pa.array(rows[n], MATCH_ARROW.field(n).type) for n in MATCH_COLUMNS if n != "scene_id"}
    columns["scene_id"] = scenes.take(pa.array(rows["scene"], pa.int32()))
    return pa.table([columns[n] for n in MATCH_COLUMNS], schema=MATCH_ARROW)


def _solve_blocks(radius: float, limit2: int, drop_low: bool, block: int, reach: int):
    def solve(p: pa.Table, g: pa.Table) -> pa.Table:
        table = candidate_edges(p, g, radius).combine_chunks()
        if not len(table):
            return BLOCK_ARROW.empty_table()
        edges, scenes = _columns(table)
        r0, c0 = edges["block_r"] * block, edges["block_c"] * block
        g_r, g_c = edges["g_r"], edges["g_c"]
        border = (g_r - reach < r0) | (g_r + reach >= r0 + block) | (g_c - reach < c0) | (g_c + reach >= c0 + block)
        rows, left_over, label = solve_edges(edges, limit2, drop_low, border)
        solved = _match_table(rows, scenes)
        rest = table.filter(pa.array(left_over)).select(["scene_id", *EDGE_COLUMNS, *PLACE_COLUMNS])
        rest = rest.append_column("part", pa.array(label[left_over], pa.int64()))
        rest = rest.append_column("border", pa.array(border[left_over]))
        rest = rest.append_column("kind", pa.array(np.full(len(rest), -1), pa.int32()))

        def padded(part: pa.Table) -> pa.Table:
            have = set(part.column_names)
            arrays = [part[f.name] if f.name in have else pa.nulls(len(part), f.type) for f in BLOCK_ARROW]
            return pa.table([a.cast(f.type) for a, f in zip(arrays, BLOCK_ARROW)], schema=BLOCK_ARROW)

        return pa.concat_tables([padded(solved), padded(rest)])

    return solve


def _without(column: str, solve):
    """Drop the grouping column before solving; an arrow group must be one batch of plain columns."""

    def run(table: pa.Table) -> pa.Table:
        return solve(table.drop_columns([column]).combine_chunks())

    return run


def _solve_groups(limit2: int, drop_low: bool):
    def solve(table: pa.Table) -> pa.Table:
        edges, scenes = _columns(table)
        return _match_table(solve_edges(edges, limit2, drop_low)[0], scenes)

    return solve


def connected_parts(links: DataFrame) -> DataFrame:
    """Smallest linked part of every part: ``links(part, g)`` -> ``(part, root)``.

    Each round passes the smallest root through the shared labels and then follows
    roots of roots, so long chains close in a logarithmic number of rounds.
    """
    links = cut_lineage(links.distinct())
    roots = cut_lineage(links.select("part").distinct().withColumn("root", F.col("part")))
    while True:
        at_g = links.join(roots, "part").groupBy("g").agg(F.min("root").alias("via"))
        passed = links.join(at_g, "g").groupBy("part").agg(F.min("via").alias("via"))
        step = roots.join(passed, "part").select("part", F.least("root", "via").alias("next"), "root")
        jump = step.select(F.col("part").alias("next"), F.col("next").alias("far"))
        moved = step.join(jump, "next").select("part", F.least("next", "far").alias("new"), "root")
        moved = cut_lineage(moved)
        changed = not moved.filter("new <> root").isEmpty()
        roots = moved.select("part", F.col("new").alias("root"))
        if not changed:
            return roots


def _expand_copies(rows: DataFrame, preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Turn flows between pixel nodes with copies into pairs of single rows.

    Only rows of nodes that hold copies are numbered; they are few next to the rest.
    """

    def ranked(df: DataFrame, keys: Sequence[str], row_id: str, node: str, rank: str) -> DataFrame:
        nodes = _nodes(df, keys, row_id, node, "n").filter("n > 1").drop("n")
        copies = df.join(nodes, list(keys)).select(node, row_id)
        numbered = chunked_rank(copies, [F.col(row_id)], hash_chunk(F.col(row_id)), rank, [node])
        return numbered.select(node, (F.col(rank) - 1).alias(rank), row_id)

    unit = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("flow") - 1)))
    unit = unit.withColumns({"p_rank": F.col("p_rank") + F.col("i"), "g_rank": F.col("g_rank") + F.col("i")}).drop("i")
    unit = unit.join(ranked(preds, NODE_KEYS_P, "pred_id", "p", "p_rank"), ["p", "p_rank"], "left")
    unit = unit.join(ranked(labels, NODE_KEYS_G, "detect_id", "g", "g_rank"), ["g", "g_rank"], "left")
    return unit.withColumns({"pred_id": F.coalesce("pred_id", "p"), "detect_id": F.coalesce("detect_id", "g")})


def match_levels(
    pred: DataFrame,
    labels: DataFrame,
    thresholds: Sequence[float] | None = None,
    tolerance_m: float = DISTANCE_TOLERANCE_M,
    drop_low: bool = False,
    shore: bool = False,
    block_px: int = BLOCK_PX,
    edges_per_group: int = EDGES_PER_GROUP,
    component_edges: int = COMPONENT_EDGES,
) -> DataFrame:
    """Matches for every threshold number, as ``kind, scene_id, pred_id, detect_id, d2, ps, k_from, k_to``.

    ``kind`` is ``paired`` (a correct detection), ``paired_shore`` (the same among
    near-shore rows only; both inputs then need a ``near_shore`` column) or
    ``paired_low`` (a detection taken out because it pairs with a LOW label, when
    ``drop_low`` is set).  A pair exactly at the tolerance may be assigned but
    never counts, so it is not in the result.  A column ``k`` of ``pred`` is taken as the
    number of thresholds a detection reaches.
    """
    radius = tolerance_m / PIX_TO_M
    limit2, reach = int(np.ceil(radius * radius - 1e-9)), int(np.ceil(radius))
    preds, golds = _pred_nodes(pred, thresholds, shore), _label_nodes(labels, drop_low, shore)
    # many blocks share a task: a group costs a fixed amount of time in Python
    buckets = 2 * int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p, g = block_nodes(preds, golds, block_px, reach, buckets, GROUPS_PER_TASK * buckets)
    solver = _solve_blocks(radius, limit2, drop_low, block_px, reach)
    solved = cut_lineage(p.groupBy("bucket").cogroup(g.groupBy("bucket")).applyInArrow(solver, BLOCK_SCHEMA), free=True)
    rows = solved.filter("kind >= 0").select(*MATCH_COLUMNS)
    facts = solved.agg(F.count_if(F.col("kind") < 0).alias("open"), F.bool_or("copies").alias("copies")).first()
    copies = bool(facts["copies"])
    if facts["open"]:
        crossing = []
        rest = solved.filter("kind < 0").select("scene_id", *EDGE_COLUMNS, *PLACE_COLUMNS, "part", "border")
        if facts["open"] <= min(edges_per_group, component_edges):
            # counted, and few enough for one task, which finds the components itself
            together = rest.withColumn("bucket", F.lit(0).cast("bigint"))
        else:
            roots = connected_parts(rest.filter("border").select("part", "g"))
            groups = max(buckets, -(-facts["open"] // edges_per_group))
            together = rest.join(roots, "part").withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(groups)))
            sizes = together.groupBy("root").agg(F.count("*").alias("n"))
            large = cut_lineage(sizes.filter(F.col("n") > component_edges).select("root"))
            if not large.isEmpty():
                wide = together.join(large, "root", "left_semi").select("scene_id", "root", *EDGE_COLUMNS, *PLACE_COLUMNS)
                crossing = [cut_lineage(solve_wide(wide, limit2, reach, drop_low, min(block_px, FIRST_BLOCK)))]
                together = together.join(large, "root", "left_anti")
            together = together.repartition(groups, "bucket")
        together = together.select("bucket", "scene_id", *EDGE_COLUMNS)
        solver = _without("bucket", _solve_groups(limit2, drop_low))
        crossing.append(cut_lineage(together.groupBy("bucket").applyInArrow(solver, MATCH_SCHEMA)))
        for part in crossing:
            copies = copies or not part.filter("copies").isEmpty()
            rows = rows.unionByName(part)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair]), F.col("kind"))
    result = rows.filter("not copies").withColumns({"pred_id": F.col("p"), "detect_id": F.col("g")})
    if copies:
        result = result.unionByName(cut_lineage(_expand_copies(rows.filter("copies"), preds, golds)))
    return result.select(kind.alias("kind"), "scene_id", "pred_id", "detect_id", "d2", "ps", "k_from", "k_to")


def match(pred: DataFrame, labels: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M, **sizes: int) -> DataFrame:
    """Correct detections: ``scene_id, pred_id, detect_id, d2``."""
    pairs = match_levels(pred, labels, None, tolerance_m, **sizes)
    return pairs.select("scene_id", "pred_id", "detect_id", "d2")


def low_matches(pred: DataFrame, labels: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M) -> DataFrame:
    """Detections that pair with a LOW label when matched against all labels."""
    pairs = match_levels(pred, labels, None, tolerance_m, drop_low=True)
    return pairs.filter("kind = 'paired_low'").select("scene_id", "pred_id", "detect_id", "d2")


def drop_low_matches(pred: DataFrame, labels: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M) -> DataFrame:
    return pred.join(low_matches(pred, labels, tolerance_m).select("pred_id"), "pred_id", "left_anti")


def outcomes(pred: DataFrame, labels: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M) -> DataFrame:
    """Every detection and label of the labelled scenes as TP, FP or FN.

    Detections in scenes without labels are not counted.
    """
    pairs = match(pred, labels, tolerance_m)
    hit = pairs.select(F.lit("TP").alias("outcome"), "scene_id", "pred_id", "detect_id")
    seen = pred.join(labels.select("scene_id").distinct(), "scene_id", "left_semi")
    false = seen.join(pairs.select("pred_id"), "pred_id", "left_anti").select(
        F.lit("FP").alias("outcome"), "scene_id", "pred_id", F.lit(None).cast("bigint").alias("detect_id")
    )
    missed = labels.join(pairs.select("detect_id"), "detect_id", "left_anti").select(
        F.lit("FN").alias("outcome"), "scene_id", F.lit(None).cast("bigint").alias("pred_id"), "detect_id"
    )
    return hit.unionByName(false).unionByName(missed)


def isolated_matches(pred: DataFrame, labels: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M) -> DataFrame:
    """The matches that need no search: both ends of the edge have no other candidate."""
    radius = tolerance_m / PIX_TO_M
    a = pred.select("scene_id", "pred_id", F.col("detect_scene_row").alias("p_r"), F.col("detect_scene_column").alias("p_c"))
    b = labels.select("scene_id", "detect_id", F.col("detect_scene_row").alias("g_r"), F.col("detect_scene_column").alias("g_c"))
    edges = pairs_within(a, b, radius, ("p_r", "p_c"), ("g_r", "g_c")).select("scene_id", "pred_id", "detect_id", "d2")
    lone_p = edges.groupBy("scene_id", "pred_id").agg(F.count("*").alias("n"), F.min("detect_id").alias("detect_id"), F.min("d2").alias("d2"))
    lone_g = edges.groupBy("detect_id").agg(F.count("*").alias("n_g"))
    both = lone_p.filter("n = 1").join(lone_g.filter("n_g = 1"), "detect_id")
    return both.filter(F.col("d2") < radius * radius).select("scene_id", "pred_id", "detect_id", "d2")


def confirm_labels(labels: DataFrame, pred: DataFrame, tolerance_m: float = DISTANCE_TOLERANCE_M) -> DataFrame:
    """Add ``ignored``: labels no detection confirms are kept, but marked to be left out of training."""
    found = match(pred, labels, tolerance_m).select("detect_id", F.lit(True).alias("found"))
    return labels.join(found, "detect_id", "left").withColumn("ignored", F.col("found").isNull()).drop("found")
