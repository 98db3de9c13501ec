"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a long, b long); the component is its smallest node.

    Each step groups by a node for the least neighbour (combined before the shuffle, so a hub costs one row for each
    task) and joins that back to the edges (sort-merge with adaptive skew splitting, no broadcast is asked for). After a
    large-star step all greater neighbours of a node hang on its least one, after a small-star step the smaller ones do; the number of
    rounds is logarithmic in practice. Every step is written to the shared folder, so a lost executor costs one step. Self-loops and
    repeated edges are harmless; no edges give no rows; rows with a null are ignored. ``discard`` of the result deletes its table.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    if not seen[0]:
        discard(now)
        return edges.sparkSession.createDataFrame([], "node long, component long")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        under = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        # of a node's smaller neighbours the least stays its own; the others hang on the least instead
        small = large.join(under, F.col("a") == F.col("k")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = materialize(small, "small-star")
        discard(large)
        discard(now)
        now, before = after, seen
        seen = _signature(now)
        if seen == before:
            # every edge is now node -> component; distinct() of the step left one for each node
            labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
            out.materialized_path = now.materialized_path
            return out
