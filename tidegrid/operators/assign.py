"""Assignment kernel run inside tasks: small flow problems on sparse pixel graphs.

A task receives the candidate edges of one block (or one component) and
answers, for every level of the score threshold, which detections pair with which
labels.  Nodes carry a multiplicity: all copies of a detection on one pixel are
one node, so the size of a block is bounded by its pixels.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

# kinds of match rows
PAIRED, PAIRED_SHORE, PAIRED_LOW = 0, 1, 2

MATCH_SCHEMA = (
    "scene_id STRING, kind INT, p BIGINT, g BIGINT, p_rank BIGINT, g_rank BIGINT, flow BIGINT, "
    "k_from INT, k_to INT, d2 BIGINT, ps BOOLEAN, copies BOOLEAN"
)
ROW_COLUMNS = ["kind", "p", "g", "p_rank", "g_rank", "flow", "k_from", "k_to", "d2", "ps", "copies"]
EDGE_COLUMNS = ["p", "g", "pn", "gn", "k", "ps", "low", "gs", "d2"]


def _mixed(p: int, g: int) -> int:
    """48 bits fixed by the two ids."""
    x = (p * 0x9E3779B97F4A7C15 + g * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 29) & (1 << 48) - 1


def edge_cost(p: int, g: int, d2: int) -> int:
    """Exact cost: the floating distance plus a step fixed by the two ids, in 2**-128 pixels, then 48 bits of their own.

    Costs are whole numbers of any size, so sums never round; the last bits differ from edge to edge, so one optimum
    is the cheapest and every way of searching finds that one.  The distance is the rounded one, so that matchings
    whose floating costs differ are told apart as a sum of these tells them apart.
    """
    top, bottom = (math.sqrt(d2) + 1e-9 * ((p * 31 + g * 17) % 1009) / 1009).as_integer_ratio()
    return ((top << 128) // bottom << 48) + _mixed(p, g)


def pair_up(edges: list[tuple], supply: dict, demand: dict) -> list[tuple]:
    """Largest pairing, and the cheapest among the largest.

    ``edges`` are ``(cost, p, g, d2)``; returns ``(p, g, d2, flow)``.
    """
    if not edges:
        return []
    left, right = {e[1] for e in edges}, {e[2] for e in edges}
    if len(left) == 1 or len(right) == 1:
        free_p, free_g, out = {p: supply[p] for p in left}, {g: demand[g] for g in right}, []
        for _, p, g, d2 in sorted(edges):
            amount = min(free_p[p], free_g[g])
            if amount:
                free_p[p] -= amount
                free_g[g] -= amount
                out.append((p, g, d2, amount))
        return out
    return _augment(edges, left, right, supply, demand)


def _augment(edges: list[tuple], left: set, right: set, supply: dict, demand: dict) -> list[tuple]:
    """Shortest augmenting paths with node prices.

    All detections with copies left share one price, so their edges wait in one
    heap across searches (keys only grow and are refreshed when seen); a
    search then touches no more than the surroundings of the path it finds.
    """
    edges = sorted(edges, key=lambda e: (e[1], e[2]))
    outgoing: dict = {p: [] for p in left}
    length, dist2 = {}, {}
    for cost, p, g, d2 in edges:
        outgoing[p].append(g)
        length[p, g], dist2[p, g] = cost, d2
    waiting = [(cost, p, g) for cost, p, g, _ in edges]
    heapq.heapify(waiting)
    flow: dict = {}
    holders: dict = {g: set() for g in right}
    price_p: dict = {}
    price_g = dict.fromkeys(right, 0)
    free_p, free_g = {p: supply[p] for p in left}, {g: demand[g] for g in right}
    source_price = 0
    while True:
        heap: list = []
        done: dict = {}
        best: dict = {}
        via: dict = {}
        borrowed: list = []
        goal = None
        while True:
            while waiting:
                key, p, g = waiting[0]
                if not free_p[p]:
                    heapq.heappop(waiting)
                    continue
                now = length[p, g] - price_g[g]
                if now > key:
                    heapq.heapreplace(waiting, (now, p, g))
                    continue
                break
            fresh = max(waiting[0][0] + source_price, 0) if waiting else math.inf
            known = heap[0][0] if heap else math.inf
            if fresh == math.inf and known == math.inf:
                break
            if fresh < known:
                key, p, g = heapq.heappop(waiting)
                borrowed.append((key, p, g))
                if (1, g) not in done and fresh < best.get((1, g), math.inf):
                    best[1, g] = fresh
                    via[1, g] = p
                    heapq.heappush(heap, (fresh, 1, g))
                continue
            d, side, node = heapq.heappop(heap)
            if (side, node) in done:
                continue
            done[side, node] = d
            if side == 1:
                # the price of a label with room, and of the sink, is 0
                if free_g[node]:
                    goal = node
                    break
                for p in sorted(holders[node]):
                    if free_p[p] or (0, p) in done:
                        continue
                    step = max(price_g[node] - price_p[p] - length[p, node], 0)
                    if d + step < best.get((0, p), math.inf):
                        best[0, p] = d + step
                        via[0, p] = node
                        heapq.heappush(heap, (d + step, 0, p))
            else:
                for g in outgoing[node]:
                    if (1, g) in done:
                        continue
                    step = max(length[node, g] + price_p[node] - price_g[g], 0)
                    if d + step < best.get((1, g), math.inf):
                        best[1, g] = d + step
                        via[1, g] = node
                        heapq.heappush(heap, (d + step, 1, g))
        for entry in borrowed:
            heapq.heappush(waiting, entry)
        if goal is None:
            break
        reach = done[1, goal]
        for (side, node), d in done.items():
            if side:
                price_g[node] -= reach - d
            else:
                price_p[node] -= reach - d
        source_price -= reach
        path, g = [], goal
        while True:
            p = via[1, g]
            path.append((p, g, 1))
            if free_p[p]:
                break
            g = via[0, p]
            path.append((p, g, -1))
        start = path[-1][0]
        amount = min([free_p[start], free_g[goal]] + [flow[p, g] for p, g, sign in path if sign < 0])
        for p, g, sign in path:
            value = flow.get((p, g), 0) + sign * amount
            if value:
                flow[p, g] = value
                holders[g].add(p)
            else:
                flow.pop((p, g), None)
                holders[g].discard(p)
        free_p[start] -= amount
        free_g[goal] -= amount
        if not free_p[start]:
            price_p[start] = source_price
    return [(p, g, dist2[p, g], amount) for (p, g), amount in flow.items()]


def solve_component(edges: list[tuple], limit2: int, drop_low: bool) -> list[tuple]:
    """All match rows of one component, for every level of the threshold.

    ``edges`` are tuples in ``EDGE_COLUMNS`` order.  A detection of level ``k`` is
    present for thresholds ``0 .. k-1``, so the answer only changes where some
    detection leaves.
    """
    supply = {e[0]: e[2] for e in edges}
    demand = {e[1]: e[3] for e in edges}
    priced = [(edge_cost(e[0], e[1], e[8]), e[0], e[1], e[8], e) for e in edges]
    ps_of = {e[0]: e[5] for e in edges}
    rows: list[tuple] = []

    def emit(kind: int, pairs: list[tuple], k_from: int, k_to: int, from_top: bool = False) -> dict:
        used_p: dict = {}
        used_g: dict = {}
        for p, g, d2, amount in sorted(pairs):
            if d2 >= limit2:
                continue
            at_p, at_g = used_p.get(p, 0), used_g.get(g, 0)
            p_rank = supply[p] - at_p - amount if from_top else at_p
            rows.append((kind, p, g, p_rank, at_g, amount, k_from, k_to, d2, ps_of[p], supply[p] > 1 or demand[g] > 1))
            used_p[p], used_g[g] = at_p + amount, at_g + amount
        return used_p

    start = 0
    for level in sorted({e[4] for e in edges}):
        live = [e for e in priced if e[4][4] >= level]
        left = supply
        if drop_low and any(e[4][6] for e in live):
            everything = pair_up([e[:4] for e in live], supply, demand)
            lows = {e[2] for e in live if e[4][6]}
            gone = emit(PAIRED_LOW, [m for m in everything if m[1] in lows], start, level, from_top=True)
            left = {p: n - gone.get(p, 0) for p, n in supply.items()}
        kept = [e for e in live if left[e[1]] and not (drop_low and e[4][6])]
        emit(PAIRED, pair_up([e[:4] for e in kept], left, demand), start, level)
        shore = [e for e in kept if e[4][5] and e[4][7]]
        if shore:
            emit(PAIRED_SHORE, pair_up([e[:4] for e in shore], left, demand), start, level)
        start = level
    return rows


def component_labels(p: np.ndarray, g: np.ndarray, n_p: int) -> np.ndarray:
    """Smallest detection index of each edge's component, by label passing with shortcuts."""
    by_g, by_p = np.argsort(g, kind="stable"), np.argsort(p, kind="stable")
    g_cut = np.flatnonzero(np.r_[True, np.diff(g[by_g]) != 0])
    p_cut = np.flatnonzero(np.r_[True, np.diff(p[by_p]) != 0])
    label = np.arange(n_p)
    while True:
        at_g = np.minimum.reduceat(label[p[by_g]], g_cut)
        new = np.minimum(label, np.minimum.reduceat(at_g[g[by_p]], p_cut))
        new = new[new]
        if np.array_equal(new, label):
            return label[p]
        label = new


def isolated_rows(edges: dict, pick: np.ndarray, limit2: int, drop_low: bool) -> dict:
    """Match rows of edges whose two ends have no other edge and no copies, without any search."""
    pick = pick[edges["d2"][pick] < limit2]
    low = edges["low"][pick] if drop_low else np.zeros(len(pick), dtype=bool)
    shore = edges["ps"][pick] & edges["gs"][pick] & ~low
    at = np.r_[pick, pick[shore]]
    kind = np.r_[np.where(low, PAIRED_LOW, PAIRED), np.full(int(shore.sum()), PAIRED_SHORE)]
    zero = np.zeros(len(at), dtype=np.int64)
    return {
        "kind": kind,
        "p": edges["p"][at],
        "g": edges["g"][at],
        "p_rank": zero,
        "g_rank": zero,
        "flow": zero + 1,
        "k_from": zero,
        "k_to": edges["k"][at],
        "d2": edges["d2"][at],
        "ps": edges["ps"][at],
        "copies": zero > 0,
        "scene": edges["scene"][at],
    }


def solve_edges(edges: dict, limit2: int, drop_low: bool, open_edge: np.ndarray | None = None):
    """Solve every closed component of an edge table (a dict of numpy columns).

    ``open_edge`` marks edges whose label may have further detections elsewhere; a
    component with such an edge is left alone.  Returns the match rows, a mask
    of the edges left over and the component label of every edge.
    """
    ids, p = np.unique(edges["p"], return_inverse=True)
    _, g = np.unique(edges["g"], return_inverse=True)
    label = component_labels(p, g, len(ids))
    left_over = np.zeros(len(p), dtype=bool)
    if open_edge is not None:
        left_over = np.isin(label, np.unique(label[open_edge]))
    single = (np.bincount(label, minlength=len(ids))[label] == 1) & ~left_over
    single &= (edges["pn"] == 1) & (edges["gn"] == 1)
    parts = [isolated_rows(edges, np.flatnonzero(single), limit2, drop_low)]
    busy = np.flatnonzero(~single & ~left_over)
    if len(busy):
        busy = busy[np.argsort(label[busy], kind="stable")]
        tuples = list(zip(*[edges[c][busy].tolist() for c in EDGE_COLUMNS]))
        scenes = edges["scene"][busy].tolist()
        cuts = np.flatnonzero(np.r_[True, np.diff(label[busy]) != 0, True]).tolist()
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows.extend([(*r, scenes[a]) for r in solve_component(tuples[a:b], limit2, drop_low)])
        if rows:
            names = [*ROW_COLUMNS, "scene"]
            parts.append({n: np.array(v) for n, v in zip(names, zip(*rows))})
    return {n: np.concatenate([x[n] for x in parts]) for n in parts[0]}, left_over, ids[label]
