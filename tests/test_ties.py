"""Equal distances: the step by ids and the rounding of floating costs decide, for copies on one pixel too."""

import math

from tidegrid.operators import matching as M
from tidegrid.operators.assign import edge_cost, pair_up


def _floating(p, g, d2):
    return math.sqrt(d2) + 1e-9 * ((p * 31 + g * 17) % 1009) / 1009


def test_rounded_costs_decide_between_crossed_pairs():
    straight = [(722238, 722238, 145), (722315, 722315, 125)]
    crossed = [(722238, 722315, 125), (722315, 722238, 145)]
    assert sum(_floating(*e) for e in crossed) < sum(_floating(*e) for e in straight)
    one = dict.fromkeys((722238, 722315), 1)
    got = pair_up([(edge_cost(*e), *e) for e in straight + crossed], one, dict(one))
    assert sorted((p, g) for p, g, _, _ in got) == [e[:2] for e in crossed]


def test_ids_of_copies_on_one_pixel_decide(spark):
    ids = (202847, 202886, 202999)
    place = "scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT"
    pred = spark.createDataFrame([("a", 5, 5, p) for p in ids], place + ", pred_id BIGINT")
    for g in (202847, 202886, 5):
        gold = spark.createDataFrame([("a", 7, 5, g, "HIGH")], place + ", detect_id BIGINT, confidence STRING")
        best = min(ids, key=lambda p: _floating(p, g, 4))
        assert [r.pred_id for r in M.match(pred, gold).collect()] == [best]


def test_many_copies_are_still_one_node(spark):
    rows = spark.createDataFrame([("a", 5, 5, i, 1, False) for i in range(4)] + [("a", 6, 6, 9, 1, False), ("a", 6, 6, 8, 1, False)], "scene_id STRING, detect_scene_row BIGINT, detect_scene_column BIGINT, pred_id BIGINT, k INT, ps BOOLEAN")
    assert sorted((r.p, r.pn) for r in M._nodes(rows, M.NODE_KEYS_P, "pred_id", "p", "pn").collect()) == [(0, 4), (8, 1), (9, 1)]
