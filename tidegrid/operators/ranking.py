"""Ranks, running sums and top-k that never need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_running_sum(
    df: DataFrame, value: Column, order: Sequence[Column], chunk: Column, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Running sum of ``value`` within ``keys``, in the order of (chunk, order), the row itself included.

    ``chunk`` must not decrease along ``order`` if the order matters.  Only the chunk
    totals meet in one place; the rows are summed chunk by chunk.
    """
    marked = df.withColumns({"_chunk": chunk, "_value": value})
    totals = marked.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, F.col("_chunk").alias("_c"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("_within", F.sum("_value").over(inner))
    on = summed["_chunk"].eqNullSafe(totals["_c"])
    for key in keys:
        on = on & summed[key].eqNullSafe(totals[key])
    joined = summed.join(totals, on)
    return joined.select(*[summed[c] for c in df.columns], (F.col("_before") + F.col("_within")).alias(name))


def chunked_rank(
    df: DataFrame, order: Sequence[Column], chunk: Column, name: str = "rank", keys: Sequence[str] = ()
) -> DataFrame:
    """Row number from 1 in the order of (chunk, order)."""
    return chunked_running_sum(df, F.lit(1).cast("bigint"), order, chunk, name, keys)


def hash_chunk(*ids: Column, chunks: int = 256) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(chunks))


def top_k(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[Column], name: str | None = None) -> DataFrame:
    """First ``k`` rows of each group.

    Spark cuts every input partition to ``k`` rows per group before the shuffle
    (a window group limit), so even the busiest group brings few rows to its task.
    """
    rank = name or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return kept if name else kept.drop(rank)


def top_k_by(df: DataFrame, limits: DataFrame, key: str, limit: str, score: str, order: Sequence[Column], bins: int = 4096) -> DataFrame:
    """First rows of each group, by descending ``score`` in [0, 1] and then ``order``; ``limits(key, limit)`` has the number.

    A histogram of each group's scores gives the bin in which the limit is reached; rows below it never leave their
    partition, and only the rows from there on are ranked.  Groups without a limit have no rows.
    """
    marked = df.withColumn("_bin", F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * bins))
    counts = marked.groupBy(key, "_bin").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(key).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0))).join(limits.select(key, F.col(limit).alias("_k")), key)
    lowest = before.filter(F.col("_before") < F.col("_k")).groupBy(key).agg(F.min("_bin").alias("_cut"), F.first("_k").alias("_k"))
    near = marked.join(lowest, key).filter(F.col("_bin") >= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *order))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_k")).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, 1, keys, order)
