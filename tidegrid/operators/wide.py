"""Matching of components too large for one task.

Detections are added one at a time, each by a shortest search over node prices (the
row-by-row form of the assignment method).  A search only needs the part of the
component it touches, so blocks of the scene work side by side: a search that stays
inside its block is final, one that reaches a label with detections outside is put
off to a later pass.  Passes shift the blocks by half a side and, every fourth
pass, double the side, until nothing is left.  Prices and flows of a pass are
written before the next one, and the result is the exact optimum.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.assign import PAIRED, PAIRED_LOW, PAIRED_SHORE, edge_cost
from tidegrid.operators.spatial import cell_of
from tidegrid.session import cut_lineage

# cost of leaving a detection without a partner: above every sum of 2**100 edge costs, so pairing always comes first
ALONE = 1 << 256
FIRST_BLOCK = 512
UNIT = ("scene_id", "root", "lvl")
STATE = ("f", "dn", "u", "v")


def place_rows(edges: dict, border: np.ndarray) -> None:
    """Place the units of the block's waiting detections, as far as searches stay inside; updates the state columns."""
    ps, gs = edges["p"].tolist(), edges["g"].tolist()
    cost = [edge_cost(p, g, d2) for p, g, d2 in zip(ps, gs, edges["d2"].tolist())]
    supply, demand = dict(zip(ps, edges["pn"].tolist())), dict(zip(gs, edges["gn"].tolist()))
    alone = dict(zip(ps, edges["dn"].tolist()))
    price_p, price_g = dict(zip(ps, map(int, edges["u"].tolist()))), dict(zip(gs, map(int, edges["v"].tolist())))
    closed = {g: True for g in gs}
    for g, b in zip(gs, border.tolist()):
        closed[g] = closed[g] and not b
    outgoing: dict = {p: [] for p in supply}
    flow: dict = {}
    length: dict = {}
    holders: dict = {g: set() for g in demand}
    placed = dict.fromkeys(supply, 0)
    taken = dict.fromkeys(demand, 0)
    for p, g, c, f in zip(ps, gs, cost, edges["f"].tolist()):
        outgoing[p].append(g)
        length[p, g] = c
        if f:
            flow[p, g] = f
            holders[g].add(p)
            placed[p] += f
            taken[g] += f

    def search(source: int):
        """Cheapest way to place one more unit: ``(path ends, distances, predecessors)`` or None."""
        heap = [(0, 0, source)]
        best = {(0, source): 0}
        done: dict = {}
        via: dict = {}
        while heap:
            d, side, node = heapq.heappop(heap)
            if (side, node) in done:
                continue
            done[side, node] = d
            if side == 2:
                return node, done, via
            if side == 1:
                if not closed[node]:
                    return None
                if taken[node] < demand[node]:
                    return node, done, via
                for p in sorted(holders[node]):
                    step = max(length[p, node] - price_p[p] - price_g[node], 0)
                    if (0, p) not in done and d + step < best.get((0, p), math.inf):
                        best[0, p] = d + step
                        via[0, p] = node
                        heapq.heappush(heap, (d + step, 0, p))
            else:
                heapq.heappush(heap, (d + max(ALONE - price_p[node], 0), 2, node))
                for g in outgoing[node]:
                    step = max(length[node, g] - price_p[node] - price_g[g], 0)
                    if (1, g) not in done and d + step < best.get((1, g), math.inf):
                        best[1, g] = d + step
                        via[1, g] = node
                        heapq.heappush(heap, (d + step, 1, g))
        return None

    for source in sorted(supply):
        while placed[source] + alone[source] < supply[source]:
            found = search(source)
            if found is None:
                break
            goal, done, via = found
            reach = max(done.values())
            to_alone = (2, goal) in done
            for (side, node), d in done.items():
                if side == 0:
                    price_p[node] += reach - d
                elif side == 1:
                    price_g[node] -= reach - d
            steps = []
            p = goal if to_alone else via[1, goal]
            if not to_alone:
                steps.append((p, goal, 1))
            while p != source:
                g = via[0, p]
                steps.append((p, g, -1))
                p = via[1, g]
                steps.append((p, g, 1))
            amount = supply[source] - placed[source] - alone[source]
            if not to_alone:
                amount = min(amount, demand[goal] - taken[goal])
            amount = min([amount] + [flow[p, g] for p, g, sign in steps if sign < 0])
            for p, g, sign in steps:
                value = flow.get((p, g), 0) + sign * amount
                placed[p] += sign * amount
                if value:
                    flow[p, g] = value
                    holders[g].add(p)
                else:
                    flow.pop((p, g), None)
                    holders[g].discard(p)
            if to_alone:
                alone[goal] += amount
            else:
                taken[goal] += amount
    edges["f"] = np.array([flow.get(pair, 0) for pair in zip(ps, gs)], dtype=np.int64)
    edges["dn"] = np.array([alone[p] for p in ps], dtype=np.int64)
    edges["u"] = [str(price_p[p]) for p in ps]
    edges["v"] = [str(price_g[g]) for g in gs]
    edges["pending"] = np.array([placed[p] + alone[p] < supply[p] for p in ps])


def _block_solver(side: int, shift_r: int, shift_c: int, reach: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = ("p", "g", "pn", "gn", "d2", "g_r", "g_c", *STATE)
        edges = {n: table[n].to_numpy(zero_copy_only=False) for n in names}
        r0 = table["block_r"][0].as_py() * side - shift_r
        c0 = table["block_c"][0].as_py() * side - shift_c
        g_r, g_c = edges["g_r"], edges["g_c"]
        border = (g_r - reach < r0) | (g_r + reach >= r0 + side) | (g_c - reach < c0) | (g_c + reach >= c0 + side)
        place_rows(edges, border)
        for n in (*STATE, "pending"):
            at = table.schema.get_field_index(n)
            table = table.set_column(at, table.schema.field(at), pa.array(edges[n], table.schema.field(at).type))
        return table

    return solve


def assign_wide(edges: DataFrame, reach: int, first_block: int = FIRST_BLOCK) -> DataFrame:
    """Optimal flows of each unit's edges, as the edges with ``f > 0``."""
    state = edges.selectExpr("*", "0L AS f", "0L AS dn", "'0' AS u", "'0' AS v", "true AS pending")
    columns = state.columns
    state, number = cut_lineage(state), 0
    while True:
        side = first_block * 2 ** (number // 4)
        shift_r, shift_c = side // 2 * (number & 1), side // 2 * (number >> 1 & 1)
        block = [
            cell_of(F.col("p_r") + shift_r, side).alias("block_r"),
            cell_of(F.col("p_c") + shift_c, side).alias("block_c"),
        ]
        keys = [*UNIT, "block_r", "block_c"]
        placed = state.select(*columns, *block)
        waiting = placed.filter("pending").select(*keys).distinct()
        active = placed.join(waiting, keys, "left_semi")
        solved = active.groupBy(*keys).applyInArrow(_block_solver(side, shift_r, shift_c, reach), placed.schema)
        idle = placed.join(waiting, keys, "left_anti")
        state = cut_lineage(solved.unionByName(idle).select(*columns))
        if state.filter("pending").isEmpty():
            return state.filter("f > 0")
        number += 1


def _match_rows(flows: DataFrame, kind: int, limit2: int, from_top: bool = False) -> DataFrame:
    """Match rows of flows closer than the tolerance, with the places of their copies."""
    near = flows.filter(F.col("d2") < limit2)

    def before(node: str, other: str):
        upto = Window.partitionBy(*UNIT, node).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("f").over(upto), F.lit(0)).cast("bigint")

    p_rank = before("p", "g")
    if from_top:
        p_rank = F.col("pn") - p_rank - F.col("f")
    return near.select(
        "scene_id",
        F.lit(kind).alias("kind"),
        "p",
        "g",
        p_rank.alias("p_rank"),
        before("g", "p").alias("g_rank"),
        F.col("f").alias("flow"),
        "k_from",
        F.col("lvl").alias("k_to"),
        "d2",
        "ps",
        ((F.col("pn_all") > 1) | (F.col("gn") > 1)).alias("copies"),
    )


def solve_wide(edges: DataFrame, limit2: int, reach: int, drop_low: bool, first_block: int = FIRST_BLOCK) -> DataFrame:
    """Match rows of large components for every level of the threshold; ``edges`` carry their ``root``."""
    seen = edges.select("root", "k").distinct()
    order = Window.partitionBy("root").orderBy("k")
    levels = seen.select("root", F.col("k").alias("lvl"), F.coalesce(F.lag("k").over(order), F.lit(0)).alias("k_from"))
    live = edges.join(levels, "root").filter(F.col("k") >= F.col("lvl")).withColumn("pn_all", F.col("pn"))
    live = cut_lineage(live)
    parts = []
    if drop_low:
        low = assign_wide(live, reach, first_block).filter("low")
        parts.append(_match_rows(low, PAIRED_LOW, limit2, from_top=True))
        gone = low.filter(F.col("d2") < limit2).groupBy(*UNIT, "p").agg(F.sum("f").alias("gone"))
        kept = live.filter(~F.col("low")).join(gone, [*UNIT, "p"], "left")
        live = kept.withColumn("pn", F.col("pn") - F.coalesce("gone", F.lit(0))).drop("gone").filter("pn > 0")
        live = cut_lineage(live)
    parts.append(_match_rows(assign_wide(live, reach, first_block), PAIRED, limit2))
    shore = live.filter("ps AND gs")
    if not shore.isEmpty():
        parts.append(_match_rows(assign_wide(shore, reach, first_block), PAIRED_SHORE, limit2))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
