"""Optimal matching in SQL by listing every matching of every component.

Slow and simple on purpose: it shares nothing with the Spark implementation.
"""

INTEGER_NEAR = (
    "((p.detect_scene_row-g.detect_scene_row)*(p.detect_scene_row-g.detect_scene_row)"
    "+(p.detect_scene_column-g.detect_scene_column)*(p.detect_scene_column-g.detect_scene_column))"
)
# keeps ids of different threshold numbers apart
APART = 10_000_000_000


def match_ctes(x: str, preds: str, golds: str, limit: int = 400) -> str:
    """CTEs ending in ``{x}_m(t, scene_id, pred_id, detect_id, d2)``.

    ``preds`` give ``t, scene_id, pred_id, r, c`` and ``golds`` give ``t, scene_id, detect_id, r, c``.
    """
    return f"""{x}_p AS MATERIALIZED ({preds}), {x}_g AS MATERIALIZED ({golds}),
{x}_e AS MATERIALIZED (SELECT *, (t*{APART}+pred_id)*2 AS pn, (t*{APART}+detect_id)*2+1 AS gn FROM
 (SELECT p.t, p.scene_id, pred_id, detect_id, (p.r-g.r)*(p.r-g.r)+(p.c-g.c)*(p.c-g.c) AS d2 FROM {x}_p p JOIN {x}_g g
 ON p.t = g.t AND p.scene_id = g.scene_id AND abs(p.r-g.r) <= 20 AND abs(p.c-g.c) <= 20) WHERE d2 <= {limit}),
{x}_u AS MATERIALIZED (SELECT pn AS a, gn AS b FROM {x}_e UNION ALL SELECT gn, pn FROM {x}_e),
{x}_l(n, l) AS (SELECT DISTINCT a, a FROM {x}_u UNION SELECT b, l FROM {x}_l JOIN {x}_u ON a = n),
{x}_k AS MATERIALIZED (SELECT n, min(l) AS k FROM {x}_l GROUP BY n),
{x}_o AS MATERIALIZED (SELECT e.*, k, row_number() OVER (PARTITION BY k ORDER BY pred_id, detect_id) - 1 AS i,
 dense_rank() OVER (PARTITION BY k ORDER BY pred_id) - 1 AS pi, dense_rank() OVER (PARTITION BY k ORDER BY detect_id) - 1 AS gi,
 sqrt(d2) + 1e-9*((pred_id*31+detect_id*17)%1009)/1009 AS w FROM {x}_e e JOIN {x}_k ON n = pn),
{x}_s(k, i, ps, gs, size, cost, picked) AS (SELECT DISTINCT k, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0, 0::DOUBLE, 0::HUGEINT FROM {x}_o
 UNION ALL SELECT s.k, s.i+1, CASE WHEN take THEN ps + (1::BIGINT << pi) ELSE ps END, CASE WHEN take THEN gs + (1::BIGINT << gi) ELSE gs END,
 CASE WHEN take THEN size+1 ELSE size END, CASE WHEN take THEN cost + w ELSE cost END, CASE WHEN take THEN picked + (1::HUGEINT << o.i::INT) ELSE picked END
 FROM {x}_s s JOIN {x}_o o ON o.k = s.k AND o.i = s.i, (VALUES (true), (false)) v(take)
 WHERE NOT take OR ((ps >> pi) & 1 = 0 AND (gs >> gi) & 1 = 0)),
{x}_b AS MATERIALIZED (SELECT k, picked FROM (SELECT s.k, picked, row_number() OVER (PARTITION BY s.k ORDER BY size DESC, cost) AS best FROM {x}_s s
 JOIN (SELECT k, count(*) AS n FROM {x}_o GROUP BY k) c ON c.k = s.k AND s.i = c.n) WHERE best = 1),
{x}_m AS MATERIALIZED (SELECT t, scene_id, pred_id, detect_id, d2 FROM {x}_o o JOIN {x}_b b ON o.k = b.k WHERE (picked >> o.i::INT) & 1 = 1 AND d2 < {limit})"""
