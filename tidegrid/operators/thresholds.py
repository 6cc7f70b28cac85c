"""Cutting detections by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBABILITY_COLUMNS = ("objectness_threshold", "objectness_p", "is_vessel_p", "is_fishing_p")


def at_least(p: Column, t: Column | float) -> Column:
    """``p >= t`` with a missing or NaN score counting as "no"."""
    return F.coalesce((p >= t) & ~F.isnan(p), F.lit(False))


def apply_thresholds(
    df: DataFrame, objectness: float | None = None, vessel: float | None = None, fishing: float | None = None
) -> DataFrame:
    """Keep detections with a high enough score and add the class flags; each threshold is optional."""
    if objectness is not None:
        df = df.filter(at_least(F.col("objectness_p"), F.lit(float(objectness))))
    flags = {}
    if vessel is not None:
        flags["is_vessel"] = at_least(F.col("is_vessel_p"), F.lit(float(vessel)))
    if fishing is not None:
        flags["is_fishing"] = at_least(F.col("is_fishing_p"), F.lit(float(fishing)))
    return df.withColumns(flags) if flags else df


def apply_coupled_thresholds(df: DataFrame, objectness: float, vessel: float, fishing: float) -> DataFrame:
    """Fishing needs both class scores, vessel needs either."""
    v = at_least(F.col("is_vessel_p"), F.lit(float(vessel)))
    f = at_least(F.col("is_fishing_p"), F.lit(float(fishing)))
    kept = df.filter(at_least(F.col("objectness_p"), F.lit(float(objectness))))
    return kept.withColumns({"is_fishing": f & v, "is_vessel": v | f})


def floor_scores(df: DataFrame, floor: float) -> DataFrame:
    return df.filter(at_least(F.col("objectness_p"), F.lit(float(floor))))


def threshold_tables(df: DataFrame, triples: Sequence[tuple[float, float, float]]) -> DataFrame:
    """One thresholded copy of the detections per triple, in one pass over them.

    The list of triples is a handful of literals from a configuration, so each row
    unfolds only into the triples it passes.
    """
    rows = F.array(
        *[F.struct(F.lit(float(o)).alias("obj_t"), F.lit(float(v)).alias("vsl_t"), F.lit(float(f)).alias("fsh_t")) for o, v, f in triples]
    )
    passed = F.filter(rows, lambda t: at_least(F.col("objectness_p"), t["obj_t"]))
    cut = df.withColumn("t", F.explode(passed)).select("*", "t.*").drop("t")
    return cut.withColumns(
        {
            "is_vessel": at_least(F.col("is_vessel_p"), F.col("vsl_t")),
            "is_fishing": at_least(F.col("is_fishing_p"), F.col("fsh_t")),
        }
    ).drop(*PROBABILITY_COLUMNS)
