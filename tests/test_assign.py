"""The assignment kernel against exhaustive search."""

import itertools
import math
import random

from tidegrid.operators.assign import pair_up


def brute(edges, supply, demand):
    """Best (count, cost) over every way to pick the edges of unit copies."""
    left = [p for p, n in supply.items() for _ in range(n)]
    right = [g for g, n in demand.items() for _ in range(n)]
    cost = {(p, g): c for c, p, g, _ in edges}
    best = (0, 0.0)
    small, big = (left, right) if len(left) <= len(right) else (right, left)
    flip = len(left) > len(right)
    for chosen in itertools.permutations(range(len(big)), len(small)):
        used = [(big[j], s) if flip else (s, big[j]) for s, j in zip(small, chosen)]
        hit = [cost[pair] for pair in used if pair in cost]
        best = min(best, (-len(hit), sum(hit)))
    return best


def test_pair_up_matches_exhaustive_search():
    rng = random.Random(3)
    for _ in range(600):
        n_p, n_g = rng.randint(1, 5), rng.randint(1, 5)
        edges = []
        for p in range(n_p):
            for g in range(n_g):
                if rng.random() < 0.55:
                    d2 = rng.randint(0, 400)
                    edges.append((math.sqrt(d2), p, g, d2))
        supply, demand = dict.fromkeys(range(n_p), 1), dict.fromkeys(range(n_g), 1)
        if n_p < 3:
            supply[0] = 2
        if n_g < 3:
            demand[0] = 3
        got = pair_up(edges, supply, demand)
        count, cost = sum(m[3] for m in got), sum(math.sqrt(m[2]) * m[3] for m in got)
        want = brute(edges, supply, demand)
        assert count == -want[0]
        assert abs(cost - want[1]) < 1e-9


def test_one_long_chain_is_fast_and_right():
    n = 20000
    edges = []
    for i in range(n):
        edges.append((3.0, i, i, 9))
        if i + 1 < n:
            edges.append((2.0, i, i + 1, 4))
    got = pair_up(edges, dict.fromkeys(range(n), 1), dict.fromkeys(range(n), 1))
    assert sum(m[3] for m in got) == n
