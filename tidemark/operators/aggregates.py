"""Aggregates whose ties and means are defined by the order of the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cols = Sequence[str]


def mode_first_seen(df: DataFrame, keys: Cols, value: str, order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones that seen first. Columns: keys, value, n. Two combined aggregations."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__o"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("__o")).alias("o"), value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def distinct_first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the order at which each is first seen."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def _ranks(df: DataFrame, keys: Cols, value: str) -> DataFrame:
    """Distinct values of each key with ``__upto``, how many rows are not greater, and ``__all``. Rows are counted by key and value before they move, so
    a hot key costs its distinct values; nulls are left out."""
    from pyspark.sql import Window as W

    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    summed = counted.withColumn("__upto", F.sum("__c").over(upto))
    return summed.withColumn("__all", F.sum("__c").over(W.partitionBy(*keys)))


def upper_median(df: DataFrame, keys: Cols, value: str) -> DataFrame:
    """The element at position n // 2 of the sorted values, exactly. Keys without a value have no row."""
    at = F.floor(F.col("__all") / 2)
    return _ranks(df, keys, value).groupBy(*keys).agg(F.min(F.when(F.col("__upto") > at, F.col(value))).alias("upper_median"))


def percentile_report(df: DataFrame, keys: Cols, value: str) -> DataFrame:
    """Median and 90th percentile with linear interpolation between ranks, exactly. Keys without a value have no row."""
    ranked = _ranks(df, keys, value)
    ends = {}
    for name, p in (("median", 0.5), ("p90", 0.9)):
        at = F.lit(p) * (F.col("__all") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends[f"{name}_{side}"] = F.min(F.when(F.col("__upto") > rank, F.col(value))).cast("double")
        ends[f"{name}_t"] = F.max(at - F.floor(at))
    found = ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()])
    between = lambda n: (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_t")).alias(n)
    return found.select(*keys, between("median"), between("p90"))


def active_rms(df: DataFrame, keys: Cols, value: str, threshold: float) -> DataFrame:
    """Root mean square of the values above the threshold in size; 1 if there are none."""
    return df.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(F.when(F.abs(value) > threshold, F.col(value) * F.col(value)))), F.lit(1.0)).alias("rms"))


def frame_rms(df: DataFrame, keys: Cols, index: str, value: str, size: int) -> DataFrame:
    """Root mean square of each whole block of ``size`` rows; the last, partial one is dropped."""
    blocks = df.withColumn("frame", F.floor(F.col(index) / size))
    return blocks.groupBy(*keys, "frame").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")


def conditional_report(df: DataFrame, keys: Cols, **conditions: Column) -> DataFrame:
    """How many rows satisfy each condition."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def extremes(df: DataFrame, keys: Cols, value: str, default: float) -> DataFrame:
    """Least and greatest value, the default where there is none."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(value), F.lit(default)).alias("lowest"), F.coalesce(F.max(value), F.lit(default)).alias("highest"))


def weighted_blend(df: DataFrame, keys: Cols, vector: str, weight: Column, fallback: Column | None = None) -> DataFrame:
    """Weighted mean of vectors by position: keys, pos, blend. A vector that is null is skipped, but its weight counts in the normaliser. Keys whose
    vectors are all null, or whose weights sum to 0, get the ``fallback`` vector (an expression over the keys); without one they have no row."""
    weighed = df.withColumn("__x", weight)
    total = weighed.groupBy(*keys).agg(F.sum("__x").alias("__w"), F.count(vector).alias("__n"))
    parts = weighed.select(*keys, "__x", F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum(F.col("__x") * F.col("v")).alias("__s"))
    known = (F.col("__w") != 0) & (F.col("__n") > 0)
    blend = parts.join(total.where(known), list(keys)).select(*keys, "pos", (F.col("__s") / F.col("__w")).alias("blend"))
    if fallback is None:
        return blend
    return blend.unionByName(total.where(~F.coalesce(known, F.lit(False))).select(*keys, F.posexplode(fallback).alias("pos", "blend")))


def overlap_add(df: DataFrame, start: Column, value: Column, taps: Sequence[int]) -> DataFrame:
    """Adds value * tap at start, start + 1, ...: idx, amount. Whole numbers give the same sums in any order."""
    spread = df.select(start.alias("__t"), value.alias("__v"), F.posexplode(F.array(*[F.lit(x) for x in taps])).alias("k", "tap"))
    return spread.groupBy((F.col("__t") + F.col("k")).alias("idx")).agg(F.sum(F.col("__v") * F.col("tap")).alias("amount"))


def mix_bus(parts: DataFrame, gains: DataFrame, part: str, index: str, value: str) -> DataFrame:
    """Sum of all parts' samples, each by its gain (a row for each part; missing: 0)."""
    return parts.join(gains, part).groupBy(index).agg(F.sum(F.col(value) * F.col("gain")).alias(value))


def loudness_gain(samples: DataFrame, track: str, channel: str, index: str, value: str, target: float = 0.2, active: float = 0.01) -> DataFrame:
    """For each track the gain that brings its louder channel's root mean square to the target, over the places where some channel exceeds ``active`` of the peak. A silent track counts as
    of level 1. Levels below 1e-6 count as that."""
    peaks = samples.groupBy(track).agg(F.max(F.abs(F.col(value))).alias("__peak"))
    places = samples.groupBy(track, index).agg(F.max(F.abs(F.col(value))).alias("__most")).join(peaks, track)
    loud = places.where(F.col("__most") > active * F.when(F.col("__peak") > 0, F.col("__peak")).otherwise(1.0)).select(track, index)
    heard = samples.join(loud, [track, index])
    by_channel = heard.groupBy(track, channel).agg(F.sqrt(F.avg((F.col(value) * F.col(value)).cast("double"))).alias("__rms")).groupBy(track).agg(F.max("__rms").alias("__rms"))
    return peaks.join(by_channel, track, "left").select(track, (F.lit(target) / F.greatest(F.coalesce("__rms", F.lit(1.0)), F.lit(1e-6))).alias("gain"))
