"""Leak-free folds: scenes are never split, strata stay near equal."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.constants import SINK_LOCATION, TINY_TRAIN_SCENES, TINY_VALID_SCENES
from tidegrid.functions.labels import near_shore_balance, scene_path
from tidegrid.operators.ranking import chunked_rank, first_by


class Split(NamedTuple):
    train: DataFrame
    valid: DataFrame
    holdout: DataFrame


def attach_split(labels: DataFrame, split: DataFrame, columns: Sequence[str] = ("fold", "location")) -> DataFrame:
    """Fold and location of listed scenes; labels of other scenes are dropped."""
    return labels.join(split.select("scene_id", *columns), "scene_id")


def attach_location(labels: DataFrame, locations: DataFrame, sink_as_scene: bool = False) -> DataFrame:
    """Location of every label; a scene without one is an error.

    With ``sink_as_scene`` the gathering location counts as one location per scene.
    """
    joined = labels.join(locations.select("scene_id", "location"), "scene_id", "left")
    missing = F.concat(F.lit("no location for scene "), F.col("scene_id"))
    known = F.coalesce("location", F.raise_error(missing).cast("string"))
    joined = joined.withColumn("location", known)
    return split_sink(joined) if sink_as_scene else joined


def split_sink(df: DataFrame) -> DataFrame:
    return df.withColumn("location", F.when(F.col("location") == SINK_LOCATION, F.col("scene_id")).otherwise(F.col("location")))


def attach_size(df: DataFrame, sizes: DataFrame) -> DataFrame:
    return df.join(sizes, "scene_id")


def exclude_scenes(df: DataFrame, scenes: DataFrame) -> DataFrame:
    return df.join(scenes.select("scene_id").distinct(), "scene_id", "left_anti")


def restrict_scenes(df: DataFrame, scenes: DataFrame) -> DataFrame:
    return df.join(scenes.select("scene_id").distinct(), "scene_id", "left_semi")


def first_scene_per_location(df: DataFrame) -> DataFrame:
    """One scene per location, the first in the order of scene ids."""
    return df.groupBy("location").agg(F.min("scene_id").alias("scene_id"))


def stratified_group_folds(df: DataFrame, group: str, stratum: Column, folds: int) -> DataFrame:
    """``group -> fold``.

    Every group gets its most frequent stratum.  Within a stratum the groups are dealt
    out from large to small (sizes by powers of two, then by the hash of the
    name) in a snake: 0 .. k-1, k-1 .. 0, and so on.
    """
    counts = df.groupBy(F.col(group).alias("_g"), stratum.cast("bigint").alias("_s")).agg(F.count("*").alias("_n"))
    main = first_by(counts, ["_g"], [F.desc("_n"), F.col("_s")])
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("_size"))
    groups = main.select("_g", "_s").join(sizes, "_g")
    big = (-F.floor(F.log2("_size"))).cast("bigint")
    digest = F.md5(F.col("_g").cast("string").cast("binary"))
    groups = groups.withColumns({"_big": big, "_h": digest})
    chunk = F.struct(F.col("_big"), F.substring("_h", 1, 2))
    ranked = chunked_rank(groups, [F.col("_h"), F.col("_g")], chunk, "_rank", ["_s"])
    place = (F.col("_rank") - 1) % (2 * folds)
    fold = F.when(place < folds, place).otherwise(2 * folds - 1 - place)
    return ranked.select(F.col("_g").alias(group), fold.cast("bigint").alias("fold"))


def _shore_folds(labels: DataFrame, folds: int) -> DataFrame:
    stratum = near_shore_balance(F.col("distance_from_shore_km")).cast("int")
    return labels.join(stratified_group_folds(labels, "scene_id", stratum, folds), "scene_id")


def _check(fold: int, folds: int) -> None:
    if folds <= 0:
        raise ValueError(f"number of folds must be positive, not {folds}")


def precomputed_split(labels: DataFrame, split: DataFrame, fold: int) -> Split:
    """Folds from a table: -1 is the holdout."""
    df = attach_split(labels, split)
    f = F.col("fold")
    return Split(df.filter((f >= 0) & (f != fold)), df.filter(f == fold), df.filter(f == -1))


def holdout_scenes(train: DataFrame, locations: DataFrame) -> DataFrame:
    located = attach_location(train, locations)
    return restrict_scenes(located, first_scene_per_location(located))


def validation_split(train: DataFrame, validation: DataFrame, locations: DataFrame, fold: int, folds: int) -> Split:
    """Folds over the validation labels; one training scene per location is the holdout."""
    _check(fold, folds)
    main = _shore_folds(attach_location(validation, locations), folds)
    return Split(main.filter(F.col("fold") != fold), main.filter(F.col("fold") == fold), holdout_scenes(train, locations))


def validation_holdout_split(validation: DataFrame, locations: DataFrame, fold: int, folds: int) -> Split:
    """One fold more than asked for; the last one is the holdout."""
    _check(fold, folds)
    main = _shore_folds(attach_location(validation, locations), folds + 1)
    f = F.col("fold")
    return Split(main.filter((f != fold) & (f != folds)), main.filter(f == fold), main.filter(f == folds))


def full_split(train: DataFrame, validation: DataFrame, locations: DataFrame, fold: int, folds: int) -> Split:
    """Folds over validation labels, with the rest of the training labels, stratified by fishing, added to the training part."""
    part = validation_split(train, validation, locations, fold, folds)
    extra = exclude_scenes(attach_location(train, locations, sink_as_scene=True), part.holdout)
    stratum = F.coalesce(F.col("is_fishing").cast("int"), F.lit(2))
    extra = extra.join(stratified_group_folds(extra, "scene_id", stratum, folds), "scene_id")
    return Split(
        extra.filter(F.col("fold") != fold).unionByName(part.train, allowMissingColumns=True), part.valid, part.holdout
    )


def tiny_split(
    train: DataFrame,
    validation: DataFrame,
    train_scenes: Sequence[str] = TINY_TRAIN_SCENES,
    valid_scenes: Sequence[str] = TINY_VALID_SCENES,
) -> Split:
    """A fixed short list of scenes; each scene is its own location."""
    t = train.filter(F.col("scene_id").isin(*train_scenes)).withColumn("location", F.col("scene_id"))
    v = validation.filter(F.col("scene_id").isin(*valid_scenes)).withColumn("location", F.col("scene_id"))
    return Split(t, v, v)


def split_by_name(
    name: str,
    train: DataFrame,
    validation: DataFrame,
    split: DataFrame | None = None,
    fold: int = 0,
    folds: int = 4,
    data_root: str = "data",
) -> Split:
    """Dispatch on the splitter's name; every part carries ``folder`` and ``scene_path``."""

    def prepared(df: DataFrame, folder: str) -> DataFrame:
        df = df.withColumn("folder", F.lit(folder))
        return df.withColumn("scene_path", scene_path(data_root, F.col("folder"), F.col("scene_id")))

    train, validation = prepared(train, "train"), prepared(validation, "validation")
    if name == "precomputed":
        return precomputed_split(train.unionByName(validation), split, fold)
    if name == "tiny":
        return tiny_split(train, validation)
    if name == "valid_only":
        return validation_split(train, validation, split, fold, folds)
    if name == "valid_only_with_holdout":
        return validation_holdout_split(validation, split, fold, folds)
    if name == "full":
        return full_split(train, validation, split, fold, folds)
    raise ValueError(f"unknown splitter {name!r}")
