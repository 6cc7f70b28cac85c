"""Statistics of rasters, scenes, labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.labels import near_shore_target
from tidegrid.operators.ranking import chunked_running_sum


def raster_stats(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Size and min/max/mean/std of each channel per scene; missing pixels (NULL) do not count."""
    stats = [F.max(F.col("r") + 1).alias("rows"), F.max(F.col("c") + 1).alias("cols")]
    for ch in channels:
        stats += [F.min(ch).alias(ch + "_min"), F.max(ch).alias(ch + "_max"), F.avg(ch).alias(ch + "_mean")]
        stats += [F.stddev_pop(ch).alias(ch + "_std")]
    return pixels.groupBy("scene_id").agg(*stats)


def _tile_sums(tiles: DataFrame) -> DataFrame:
    """Per tile and channel: ends, count, smallest, largest, sum and sum of squares of its pixels."""
    real = F.transform(F.filter("pixels", lambda v: v.isNotNull()), lambda v: v.cast("double"))
    zero = F.lit(0.0).cast("double")
    return tiles.select(
        "scene_id",
        "channel",
        (F.col("tile_row") + F.col("h")).alias("bottom"),
        (F.col("tile_col") + F.col("w")).alias("right"),
        F.size(real).alias("n"),
        F.array_min(real).alias("lo"),
        F.array_max(real).alias("hi"),
        F.aggregate(real, zero, lambda a, v: a + v).alias("s"),
        F.aggregate(real, zero, lambda a, v: a + v * v).alias("s2"),
    )


def _mean_and_std() -> tuple[Column, Column]:
    n, s, s2 = F.sum("n"), F.sum("s"), F.sum("s2")
    mean = F.try_divide(s, n)
    return mean, F.sqrt(F.greatest(F.try_divide(s2, n) - mean * mean, F.lit(0.0)))


def tile_stats(tiles: DataFrame) -> DataFrame:
    """The same from tile arrays, without unfolding them: sums per tile, then per scene and channel."""
    mean, std = _mean_and_std()
    return _tile_sums(tiles).groupBy("scene_id", "channel").agg(
        F.max("bottom").alias("rows"),
        F.max("right").alias("cols"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
        mean.alias("mean"),
        std.alias("std"),
    )


def tile_channel_stats(tiles: DataFrame) -> DataFrame:
    """Mean and deviation of each channel over all scenes, from sums per tile."""
    mean, std = _mean_and_std()
    return _tile_sums(tiles).groupBy("channel").agg(mean.alias("mean"), std.alias("std"))


def size_mismatches(sizes: DataFrame) -> DataFrame:
    """Scenes whose channels differ in size."""
    seen = sizes.groupBy("scene_id").agg(F.count_distinct("rows", "cols").alias("n"))
    return seen.filter("n > 1").select("scene_id")


def channel_stats(pixels: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    return pixels.groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def scenes_per_location(scenes: DataFrame) -> DataFrame:
    """Scenes of each location by split."""
    split = F.col("official_split")
    train, valid = F.count_if(split == "train"), F.count_if(split == "validation")
    return scenes.groupBy("location").agg(
        train.alias("scenes_count_in_train"),
        valid.alias("scenes_count_in_valid"),
        F.count_if(split == "test").alias("scenes_count_in_test"),
        (train + valid).alias("scenes_count_in_train_and_valid"),
    )


def attach_location_counts(scenes: DataFrame) -> DataFrame:
    return scenes.join(scenes_per_location(scenes), "location")


def labels_per_scene(labels: DataFrame) -> DataFrame:
    v, f = F.col("is_vessel"), F.col("is_fishing")
    return labels.groupBy("scene_id").agg(
        F.count_if(~v).alias("platform_instances"),
        F.count_if(v).alias("vessel_instances"),
        F.count_if(f).alias("fishing_instances"),
        F.count_if(v.isNull()).alias("unknown_vessel"),
        F.count_if(v.isNotNull() & f.isNull()).alias("unknown_fishing"),
    )


def recommend_split(counted: DataFrame) -> DataFrame:
    """A lone validation scene of its location, or a lone training scene of a pure location, becomes holdout."""
    split, train = F.col("official_split"), F.col("scenes_count_in_train")
    valid, test = F.col("scenes_count_in_valid"), F.col("scenes_count_in_test")
    lone_valid = (valid == 1) & (split == "validation")
    lone_train = (train == 1) & (valid == 0) & (test == 0) & (split == "train")
    return counted.withColumn("recommended_split", F.when(lone_valid | lone_train, "holdout").otherwise(split))


def location_averages(scenes: DataFrame, names: Sequence[str] = ("platform", "vessel", "fishing")) -> DataFrame:
    """Mean number of objects per scene of the location, on every scene row."""
    means = scenes.groupBy("location").agg(*[F.avg(f"{n}_instances").alias(f"average_{n}_instances") for n in names])
    return scenes.join(means, "location")


def class_balance(labels: DataFrame, by: str) -> DataFrame:
    v, f, near = F.col("is_vessel"), F.col("is_fishing"), F.col("distance_from_shore_km") < 2
    return labels.groupBy(by).agg(
        F.count_if(~v).alias("non_vessel"),
        F.count_if(v).alias("vessel"),
        F.count_if(~f).alias("non_fishing"),
        F.count_if(f).alias("fishing"),
        F.count_if(~near).alias("offshore"),
        F.count_if(near).alias("near_shore"),
        F.count_if(near & v).alias("near_shore_vessel"),
        F.count_if(near & f).alias("near_shore_fishing"),
    )


def value_counts(labels: DataFrame, by: str) -> DataFrame:
    """Rows of each value of confidence, near-shore flag, vessel and fishing, in one long table."""
    texts = {
        "confidence": F.col("confidence"),
        "near_shore": near_shore_target(F.col("distance_from_shore_km")).cast("string"),
        "is_vessel": F.col("is_vessel").cast("string"),
        "is_fishing": F.col("is_fishing").cast("string"),
    }
    wide = labels.select(by, *[c.alias(n) for n, c in texts.items()])
    long = wide.unpivot([by], list(texts), "field", "value")
    return long.groupBy(by, "field", "value").agg(F.count("*").alias("n"))


def objects_per_scene_stats(labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("scene_id").agg(F.count("*").alias("n"))
    return counts.agg(
        F.min("n").alias("n_min"), F.avg("n").alias("n_mean"), F.stddev_pop("n").alias("n_std"), F.max("n").alias("n_max")
    )


def histogram(df: DataFrame, value: Column, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin includes its right end."""
    x = df.select(*keys, value.alias("_x")).filter(F.col("_x").isNotNull())
    ends = x.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("e")).scalar()
    placed = x.withColumn("_e", ends)
    share = F.try_divide(F.col("_x") - F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo"))
    b = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("bigint")
    return placed.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def fixed_histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, keys: Sequence[str]) -> DataFrame:
    """Equal-width bins between fixed ends."""
    width = (hi - lo) / bins
    b = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    return df.filter(value.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def auc(df: DataFrame, score: Column, positive: Column, name: str) -> DataFrame:
    """Area under the ROC curve; a missing score counts as 0.5 and rows without a label are left out.

    Rows are first counted per distinct score, then negatives below each score are
    summed in score chunks, so no task ever ranks all rows.
    """
    known = F.coalesce(F.when(~F.isnan(score), score), F.lit(0.5))
    rows = df.select(known.alias("s"), positive.alias("y")).filter(F.col("y").isNotNull())
    per_score = rows.groupBy("s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    summed = chunked_running_sum(per_score, F.col("neg"), [F.col("s")], F.floor(F.col("s") * 4096), "upto")
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2.0))
    return summed.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias(name))


def plain_length_score(pairs: DataFrame, predicted: Column, actual: Column, name: str) -> DataFrame:
    """One minus the mean relative length error, without caps, not below 0; an actual length of 0 makes it 0."""
    error = F.when(actual == 0, F.lit(float("inf"))).otherwise(F.abs(predicted - actual) / F.nullif(actual, F.lit(0.0)))
    return pairs.agg((F.lit(1.0) - F.least(F.lit(1.0), F.avg(error))).alias(name))
