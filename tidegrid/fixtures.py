"""Views that derive scenes, labels, detections, pixels and boxes from general-purpose tables.

The same text runs on Spark and on any SQL engine with the tables as views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "gt_fx": """
SELECT o_orderkey AS detect_id, concat('s', CAST(CAST(floor(o_orderkey / 600) AS BIGINT) AS STRING)) AS scene_id,
 (o_orderkey * o_orderkey * 7 + o_orderkey * 13) % 1499 AS detect_scene_row,
 (o_orderkey * o_orderkey * 11 + o_orderkey * 5) % 1511 AS detect_scene_column,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'HIGH' WHEN '5' THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
 CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_vessel,
 CASE WHEN o_orderstatus='F' AND o_orderkey % 3 = 0 THEN true WHEN o_orderstatus='F' AND o_orderkey % 3 = 1 THEN false END AS is_fishing,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST(20 + (o_orderkey*13) % 500 AS DOUBLE) END AS vessel_length_m,
 CAST((o_orderkey*17) % 100 AS DOUBLE) / CAST(10 AS DOUBLE) AS distance_from_shore_km
FROM {orders}""",
    "pred_fx": """
SELECT o_orderkey AS pred_id, concat('s', CAST(CAST(floor(o_orderkey / 600) AS BIGINT) AS STRING)) AS scene_id,
 (o_orderkey * o_orderkey * 7 + o_orderkey * 13) % 1499 + (o_orderkey*31) % 29 - 14 + CASE WHEN o_orderkey % 7 = 0 THEN 2000 ELSE 0 END AS detect_scene_row,
 (o_orderkey * o_orderkey * 11 + o_orderkey * 5) % 1511 + (o_orderkey*37) % 29 - 14 AS detect_scene_column,
 CAST((o_orderkey*53) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS objectness_p,
 CAST((o_orderkey*71) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS is_vessel_p,
 CAST((o_orderkey*89) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS is_fishing_p,
 CAST(20 + (o_orderkey*11) % 500 AS DOUBLE) AS vessel_length_m
FROM {orders}""",
    "pix_fx": """
SELECT concat('s', CAST(CAST(floor(event_id / 2500) AS BIGINT) AS STRING)) AS scene_id,
 CAST(floor((event_id % 2500) / 50) AS BIGINT) AS px_row, event_id % 50 AS px_col,
 CASE WHEN event_type = 'error' THEN CAST(-32768 AS DOUBLE) ELSE value - CAST(60 AS DOUBLE) END AS vv_db,
 CAST((event_id*7919) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS heat
FROM {events}""",
    "box_fx": """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS box_no, (min(l_partkey)*13) % 60 AS x1, (min(l_suppkey)*7) % 60 AS y1,
 (min(l_partkey)*13) % 60 + 10 + l_linenumber AS x2, (min(l_suppkey)*7) % 60 + CAST(min(l_quantity) AS BIGINT) AS y2
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "hole_fx": """
SELECT DISTINCT l_orderkey AS image_id, (l_suppkey*11) % 64 AS hx1, (l_partkey*17) % 64 AS hy1,
 (l_suppkey*11) % 64 + 1 + l_partkey % 24 AS hx2, (l_partkey*17) % 64 + 1 + l_suppkey % 24 AS hy2
FROM {lineitem}""",
    "scn_fx": """
SELECT c_custkey AS scene_key, concat('s', CAST(c_custkey AS STRING)) AS scene_id, n_name AS location,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'validation' WHEN 'MACHINERY' THEN 'test' ELSE 'train' END AS official_split,
 CAST(1000 + c_custkey % 700 AS BIGINT) AS scene_rows, CAST(1100 + c_custkey % 600 AS BIGINT) AS scene_cols,
 CAST(c_custkey % 5 AS BIGINT) - 1 AS fold
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "shore_fx": """
SELECT p_partkey AS point_id, concat('s', CAST(CAST(floor(p_partkey / 80) AS BIGINT) AS STRING)) AS scene_id,
 (p_partkey*6271) % 1499 AS pt_row, (p_partkey*4513) % 1511 AS pt_col FROM {part}""",
}
TABLES = ("orders", "events", "lineitem", "customer", "nation", "part")


def view_sql(name: str) -> str:
    """Text of a view over tables that carry their own names."""
    return VIEWS[name].format(**{t: t for t in TABLES}).strip()


class Fixtures:
    """The views as DataFrames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name + "_fx" in VIEWS:
            return self.view(name + "_fx")
        raise AttributeError(name)
