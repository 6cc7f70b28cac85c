"""Row weights that balance classes, scenes, crowds and shores.

Class counts are small aggregates joined back (or read as scalar subqueries), never a
window over a class: one class may hold most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.constants import IGNORE_LABEL
from tidegrid.functions.labels import four_class, near_shore_balance, near_shore_target, unknown_to_code
from tidegrid.operators.spatial import neighbour_counts, square_neighbours

POINT = ("detect_scene_row", "detect_scene_column")


def _class_counts(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """``_n_class``, ``_n`` and ``_k`` of each label: its rows, all rows, number of labels (within ``keys``)."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("_n_class"))
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("_n_class").alias("_n"), F.count("*").alias("_k"))
        return counts.join(totals, list(keys))
    totals = counts.agg(F.struct(F.sum("_n_class").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.withColumn("_t", totals).select("*", F.col("_t.n").alias("_n"), F.col("_t.k").alias("_k")).drop("_t")


def _with_class_counts(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.join(_class_counts(df, label, keys), [*keys, label])


def _label_weights(df: DataFrame, label: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced weight of each label, one row per label."""
    weight = F.col("_n") / (F.col("_k") * F.col("_n_class"))
    return _class_counts(df, label, keys).select(*keys, label, weight.alias(name), F.col("_k").alias(name + "_k"))


def balanced_weight(df: DataFrame, label: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows / (labels * rows of the label)``."""
    weight = F.col("_n") / (F.col("_k") * F.col("_n_class"))
    return _with_class_counts(df, label, keys).withColumn(name, weight).drop("_n", "_k", "_n_class")


def _known_weight(code: Column, totals: Column) -> Column:
    own = F.when(code == 0, totals["n0"]).when(code == 1, totals["n1"])
    return F.when(code == IGNORE_LABEL, 0.0).otherwise(F.try_divide(totals["n"].cast("double"), own * 2.0))


def _known_totals(df: DataFrame, code: Column) -> Column:
    counts = F.struct(F.count("*").alias("n"), F.count_if(code == 0).alias("n0"), F.count_if(code == 1).alias("n1"))
    return df.agg(counts.alias("t")).scalar()


def known_balanced_weight(df: DataFrame, code: str, name: str) -> DataFrame:
    """Two known classes share the weight evenly over all rows; an unknown class has weight 0."""
    marked = df.withColumn("_t", _known_totals(df, F.col(code)))
    return marked.withColumn(name, _known_weight(F.col(code), F.col("_t"))).drop("_t")


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse counts of classes ``0 .. classes-1``, an empty class counting as one row, summing to 1."""
    counts = df.groupBy(F.col(label).cast("bigint").alias("label")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").alias("label"))
    inverse = every.join(counts, "label", "left").select("label", (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("w"))
    total = inverse.agg(F.sum("w")).scalar()
    return inverse.select("label", (F.col("w") / total).alias("class_weight"))


def image_weights(df: DataFrame, image: str, label: str, classes: int) -> DataFrame:
    """Sum of the class weights of each image's rows."""
    weights = class_weights(df, label, classes)
    counts = df.groupBy(image, F.col(label).cast("bigint").alias("label")).agg(F.count("*").alias("n"))
    return counts.join(weights, "label").groupBy(image).agg(F.sum(F.col("n") * F.col("class_weight")).alias("image_weight"))


def bounded_balancing_weight(
    df: DataFrame,
    label: str,
    name: str,
    num_samples: int,
    min_samples: int | None = None,
    max_samples: int | None = None,
    sqrt: bool = False,
) -> DataFrame:
    """Balanced weights whose expected number of draws per class stays within bounds."""
    n, k, own = F.col("_n"), F.col("_k"), F.col("_n_class")
    weight = n / (k * own)
    if sqrt:
        weight = F.sqrt(weight)
    expected = weight * own * F.lit(float(num_samples)) / n

    def pinned(count: int) -> Column:
        return F.lit(float(count)) * n / F.lit(float(num_samples)) / own

    result = weight
    if min_samples:
        result = F.when(expected < min_samples, pinned(min_samples)).otherwise(result)
    if max_samples:
        result = F.when(expected > max_samples, pinned(max_samples)).otherwise(result)
    return _with_class_counts(df, label).withColumn(name, result).drop("_n", "_k", "_n_class")


def crowd_weight(df: DataFrame, half: int, name: str) -> DataFrame:
    """One over the number of labels in the square around each label."""
    return square_neighbours(df, half, POINT, "_near").withColumn(name, F.lit(1.0) / F.col("_near")).drop("_near")


def combined_weight(
    labels: DataFrame,
    crop: int,
    location: bool = False,
    crowd: bool = False,
    scene: bool = False,
    vessel: bool = False,
    fishing: bool = False,
    by_type: bool = False,
    near_shore: bool = False,
    name: str = "weight",
) -> DataFrame:
    """``(1 + sum of the chosen parts) / number of parts``.

    The shore part only counts when a near-shore row exists.
    """
    # every count comes from the labels themselves, so the parts do not build on each other's plans
    base = labels.withColumns(
        {
            "_type": four_class(F.col("is_vessel"), F.col("is_fishing")),
            "_near": near_shore_balance(F.col("distance_from_shore_km")),
        }
    )
    df, total, number = base, F.lit(1.0), F.lit(0.0)
    for use, column in ((location, "location"), (scene, "scene_id"), (by_type, "_type"), (near_shore, "_near")):
        if not use:
            continue
        part = "_w_" + column
        df = df.join(_label_weights(base, column, part), column)
        # the shore part needs a near-shore row: among two kinds of rows there is one
        counts = (F.col(part + "_k") > 1) | F.col("_near") if column == "_near" else F.lit(True)
        total = total + F.when(counts, F.col(part)).otherwise(0.0)
        number = number + counts.cast("double")
    for use, column in ((vessel, "is_vessel"), (fishing, "is_fishing")):
        if use:
            code = unknown_to_code(F.col(column))
            df = df.withColumn("_t_" + column, _known_totals(base, code))
            total = total + _known_weight(code, F.col("_t_" + column))
            number = number + F.lit(1.0)
    if crowd:
        df = _join_crowd(df, base, crop // 2)
        total, number = total + F.lit(1.0) / F.col("_neighbours"), number + F.lit(1.0)
    weighted = df.withColumn(name, total / F.greatest(number, F.lit(1.0)))
    return weighted.select(*labels.columns, name)


def _join_crowd(df: DataFrame, base: DataFrame, half: int) -> DataFrame:
    """Add ``_neighbours``, counted per pixel of the base rows."""
    return df.join(neighbour_counts(base, half, POINT, "_neighbours"), ["scene_id", *POINT])


def per_scene_weight(
    labels: DataFrame, crop: int, near_shore: bool = False, crowd: bool = False, by_type: bool = False, name: str = "weight"
) -> DataFrame:
    """The weight used inside one scene: shore and crowd parts sum to 1 per scene, the type part does not."""
    base = labels.withColumns(
        {
            "_type": four_class(F.col("is_vessel"), F.col("is_fishing")),
            "_near": near_shore_target(F.col("distance_from_shore_km")),
        }
    )
    df, total, number = base, F.lit(1.0), F.lit(0.0)
    if near_shore:
        # balanced weights of a scene add up to its row count
        shares = _class_counts(base, "_near", ["scene_id"]).select(
            "scene_id",
            "_near",
            F.when((F.col("_k") > 1) | F.col("_near"), F.lit(1.0) / (F.col("_k") * F.col("_n_class"))).otherwise(0.0).alias("_w_shore"),
            ((F.col("_k") > 1) | F.col("_near")).cast("double").alias("_c_shore"),
        )
        df = df.join(shares, ["scene_id", "_near"])
        total, number = total + F.col("_w_shore"), number + F.col("_c_shore")
    if crowd:
        near = neighbour_counts(base, crop // 2, POINT, "_neighbours")
        pixels = base.groupBy("scene_id", *POINT).agg(F.count("*").alias("_rows")).join(near, ["scene_id", *POINT])
        sums = pixels.groupBy("scene_id").agg(F.sum(F.col("_rows") / F.col("_neighbours")).alias("_s_crowd"))
        df = _join_crowd(df, base, crop // 2).join(sums, "scene_id")
        total, number = total + F.lit(1.0) / F.col("_neighbours") / F.col("_s_crowd"), number + F.lit(1.0)
    if by_type:
        df = df.join(_label_weights(base, "_type", "_w_type", ["scene_id"]), ["scene_id", "_type"])
        total, number = total + F.col("_w_type"), number + F.lit(1.0)
    weighted = df.withColumn(name, total / F.greatest(number, F.lit(1.0)))
    return weighted.select(*labels.columns, name)


def scene_pick_weight(scenes: DataFrame, location: bool = False, folder: bool = False, apply: bool = True, name: str = "weight") -> DataFrame:
    """Weight of drawing a whole scene: geometric mean of the balanced parts; all ones unless ``apply``."""
    df, parts = scenes, []
    for use, column in ((location, "location"), (folder, "folder")):
        if use and apply:
            df, parts = balanced_weight(df, column, "_w_" + column), [*parts, "_w_" + column]
    weight = F.lit(1.0)
    for part in parts:
        weight = weight * F.col(part)
    if parts:
        weight = F.pow(weight, F.lit(1.0 / len(parts)))
    return df.withColumn(name, weight).drop(*parts)
