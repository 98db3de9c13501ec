"""As-of, nearest, interval and anti joins without nested loops: a window over the union of both sides, or buckets of the axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Cols = Sequence[str]


def edges(right: DataFrame, keys: Cols, block: Column, rows: DataFrame, first: Column, last: Column, default_first: bool = False) -> DataFrame:
    """For blocks of an axis that are handled apart: keys, __block, __before (the ``last`` of the nearest earlier block with right rows; with ``default_first`` the first of the keys where there is none), __after (the ``first`` of the nearest later one). One row for each block that
    ``rows`` or ``right`` has (column __block), so what is gathered for a key is in proportion to its blocks."""
    own = right.withColumn("__block", block).groupBy(*keys, "__block").agg(first.alias("__first"), last.alias("__last"))
    every = own.unionByName(rows.select(*keys, "__block").distinct(), allowMissingColumns=True).groupBy(*keys, "__block").agg(F.max("__first").alias("__first"), F.max("__last").alias("__last"))
    w = W.partitionBy(*keys).orderBy("__block")
    back = F.last("__last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    if default_first:
        back = F.coalesce(back, F.first("__first", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ahead = F.last("__first", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(W.unboundedPreceding, -1))
    return every.select(*keys, "__block", back.alias("__before"), ahead.alias("__after"))


def asof(left: DataFrame, right: DataFrame, keys: Cols, at: str, order: Cols, take: Cols, strict: bool = False, default_first: bool = False, width: float | None = None) -> DataFrame:
    """For each left row the ``take`` columns of the last right row with the same keys and ``at`` not after its own (``strict``: before), null without one.
    Of equal ``at`` the greatest by ``order`` counts. One union and one sort, linear in both sides; ``default_first`` takes the
    first right row where none is before. ``width``: cut the axis into blocks of it, so that a key (or no key at all) is not one task; each block also gets the last right row before it.

    Repeated left rows stay. Null keys match each other; right rows with a null ``at`` are left out, and left rows with one find nothing (``default_first``: the first)."""
    there = right.where(F.col(at).isNotNull())
    cols = [c for c in left.columns]
    taken, ranks = F.struct(*take), [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    r = there.select(*keys, at, taken.alias("__r"), *ranks, F.lit(1 if strict else 0).alias("__side"))
    types = dict(zip(r.columns, (f.dataType for f in r.schema.fields), strict=True))
    l = left.select(*keys, at, F.struct(*cols).alias("__l"), F.lit(0 if strict else 1).alias("__side"))  # noqa: E741
    parts = [*keys]
    if width is not None:
        block = F.coalesce(F.floor(F.col(at) / width), F.lit(-(1 << 62)))
        l, r, parts = l.withColumn("__block", block), r.withColumn("__block", block), [*keys, "__block"]  # noqa: E741
        place = F.struct(F.col(at), *[F.col(c) for c in order])
        carried = edges(there, keys, block, l, F.min_by(taken, place), F.max_by(taken, place), default_first).where("__before is not null")
        none = [F.lit(None).cast(types[f"__o{i}"]).alias(f"__o{i}") for i in range(len(order))]
        r = r.unionByName(carried.select(*keys, F.lit(None).cast(types[at]).alias(at), F.col("__before").alias("__r"), *none, F.lit(-1).alias("__side"), "__block"))
    both = l.select("*", F.lit(None).cast(types["__r"]).alias("__r"), *[F.lit(None).cast(types[f"__o{i}"]).alias(f"__o{i}") for i in range(len(order))]).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*parts).orderBy(at, "__side", *[f"__o{i}" for i in range(len(order))])
    found = F.last("__r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if default_first and width is None:
        found = F.coalesce(found, F.first("__r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return both.withColumn("__f", found).where("__l is not null").select("__l.*", *[F.col(f"__f.{c}").alias(c) for c in take])


def nearest(left: DataFrame, right: DataFrame, keys: Cols, at: str, left_id: str, take: Cols, right_order: str, limit: float | None = None, width: float | None = None) -> DataFrame:
    """For each left row the right row of the same keys nearest along ``at``; of equal distances the smallest ``right_order``. Looks back
    and ahead once each in a sort of both sides (not at all pairs). ``width``: cut the axis into blocks of it, so that a key is not one task; each block also gets the nearest right rows before and after it.

    Left rows without a partner, with a null ``at``, or beyond ``limit``, are dropped; repeated ones stay. Null keys match each other."""
    there = right.where(F.col(at).isNotNull())
    r = there.groupBy(*keys, at).agg(F.min(F.struct(right_order, *[c for c in take if c != right_order])).alias("__r")).withColumn("__s", F.struct(F.col(at).alias("__at"), "__r")).drop("__r")
    l = left.where(F.col(at).isNotNull()).select(*keys, at, F.struct(*left.columns).alias("__l"))  # noqa: E741
    parts = [*keys]
    if width is not None:
        block = F.floor(F.col(at) / width)
        l, r, parts = l.withColumn("__block", block), r.withColumn("__block", block), [*keys, "__block"]  # noqa: E741
        around = edges(r.drop("__block"), keys, block, l, F.min("__s"), F.max("__s"))
        ends = around.select(*keys, "__block", F.explode(F.array_compact(F.array("__before", "__after"))).alias("__s"))
        r = r.unionByName(ends.select(*keys, F.col("__s.__at").alias(at), "__s", "__block"))
    both = l.unionByName(r, allowMissingColumns=True)
    back = W.partitionBy(*parts).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    # looking ahead is looking back in descending order: a frame that ends at the current row grows row by row
    ahead = W.partitionBy(*parts).orderBy(F.col(at).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__b", F.last("__s", ignorenulls=True).over(back)).withColumn("__a", F.last("__s", ignorenulls=True).over(ahead)).where("__l is not null")
    near = lambda c: F.struct(F.abs(F.col(at) - F.col(f"{c}.__at")).alias("d"), F.col(f"{c}.__r").alias("r"))
    best = found.withColumn("__n", F.array_min(F.filter(F.array(near("__b"), near("__a")), lambda s: s["d"].isNotNull()))).where("__n is not null")
    if limit is not None:
        best = best.where(F.col("__n.d") < limit)
    return best.select("__l.*", F.col("__n.d").alias("distance"), *[F.col(f"__n.r.{c}").alias(c) for c in take])


def k_nearest(left: DataFrame, right: DataFrame, keys: Cols, at: str, right_at: str, right_order: str, k: int) -> DataFrame:
    """Each left row with the k right rows of the same keys nearest along the axis (``at`` and ``right_at``): distance and rank from 1, of equal
    distances the smallest ``right_order`` first. Right rows are numbered along the axis, once with equal places in descending and once in
    ascending order, so the k nearest are among the last k at or before a left row's place and the first k after it: two
    numbers to join by, never all pairs of a key. Null places and keys meet nothing; left rows without a partner have no row; repeated left rows stay."""
    w = W.partitionBy(*keys)
    present = right.where(F.col(right_at).isNotNull() & F.col(right_order).isNotNull())
    back = F.row_number().over(w.orderBy(F.col(right_at), F.col(right_order).desc())).alias("__n")
    ahead = F.row_number().over(w.orderBy(F.col(right_at), F.col(right_order))).alias("__n")
    places = present.groupBy(*keys, F.col(right_at).alias("__at")).agg(F.count("*").alias("__c"))
    mine = left.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__at"), F.struct(*left.columns).alias("__l"), F.monotonically_increasing_id().alias("__id"))
    upto = w.orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = mine.unionByName(places, allowMissingColumns=True).withColumn("__p", F.coalesce(F.sum("__c").over(upto), F.lit(0)))
    found = counted.where("__l is not null").drop("__c")
    side = lambda name, lo: F.transform(F.sequence(lo, lo + (k - 1)), lambda n: F.struct(F.lit(name).alias("__s"), n.alias("__n")))
    wanted = found.withColumn("__w", F.explode(F.concat(side(0, F.col("__p") - (k - 1)), side(1, F.col("__p") + 1)))).select(*keys, "__id", "__l", "__w.__s", "__w.__n")
    numbered = present.select("*", F.lit(0).alias("__s"), back).unionByName(present.select("*", F.lit(1).alias("__s"), ahead))
    pairs = wanted.join(numbered, [*keys, "__s", "__n"]).withColumn("distance", F.abs(F.col(f"__l.{at}") - F.col(right_at)))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("__id").orderBy("distance", right_order))).where(F.col("rank") <= k)
    return ranked.select("__l.*", *[c for c in right.columns if c not in keys], "distance", "rank")


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def interval_overlap(left: DataFrame, right: DataFrame, keys: Cols, width: float, tolerance: float = 0.0, how: str = "inner") -> DataFrame:
    """Rows whose intervals [l_start, l_end) and [r_start, r_end) overlap by more than ``tolerance``, within the same keys.

    ``inner``: both sides are cut into buckets of ``width`` along the axis and meet by equality of key and bucket; a pair is looked at in the bucket where
    the later of the two starts lies. ``left_semi`` and ``left_anti``: a row is overlapped if the greatest end of the right rows that start before
    its end lies after its start, a running maximum over one sort of both sides. Repeated left rows stay; rows with a null key, start or end overlap
    nothing, so the anti join keeps them."""
    if how != "inner":
        on = [F.col(k).isNotNull() for k in keys]
        mine = left.select(*keys, (F.col("l_end") - tolerance).alias("__at"), F.lit(0).alias("__side"), F.struct(*left.columns).alias("__l"))
        other = right.select(*keys, F.col("r_start").alias("__at"), F.lit(1).alias("__side"), (F.col("r_end") - tolerance).alias("__end")).where("__at is not null")
        upto = W.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
        swept = mine.unionByName(other, allowMissingColumns=True).withColumn("__most", F.max("__end").over(upto)).where("__l is not null")
        hit = reduce(lambda x, y: x & y, [F.col("__at").isNotNull(), F.coalesce(F.col("__l.l_start") < F.col("__most"), F.lit(False)), *on])
        return swept.where(hit if how == "left_semi" else ~hit).select("__l.*")
    l = left.withColumn("__b", _buckets(F.col("l_start"), F.col("l_end"), width))  # noqa: E741
    r = right.withColumn("__b", _buckets(F.col("r_start"), F.col("r_end"), width))
    hit = (F.col("l_start") < F.col("r_end") - tolerance) & (F.col("r_start") < F.col("l_end") - tolerance)
    first = F.floor(F.greatest("l_start", "r_start") / width) == l["__b"]
    cond = reduce(lambda x, y: x & y, [*(l[k] == r[k] for k in keys), l["__b"] == r["__b"], hit, first])
    return l.join(r, cond).drop(r["__b"], *[r[k] for k in keys]).drop("__b")


def interval_lookup(points: DataFrame, spans: DataFrame, keys: Cols, at: str, start: str, end: str, order: Cols, take: Cols, else_last: bool = False) -> DataFrame:
    """The span [start, end) that holds each point, spans not overlapping within keys: as-of on the start, then a check of the end. ``else_last``: a
    point in no span gets the last span of its keys (that of the greatest start, then ``order``), wherever the point lies. Else a point in no span has
    nulls; so has one of keys without spans, or with a null place."""
    renamed = spans.withColumnRenamed(start, at) if start != at else spans
    found = asof(points, renamed, keys, at, order, [*take, end])
    ok = F.col(at) < F.col(end)
    inside = found.select(*points.columns, ok.alias("__ok"), *[F.when(ok, F.col(c)).alias(c) for c in take])
    if not else_last:
        return inside.drop("__ok")
    last = spans.groupBy(*keys).agg(F.max_by(F.struct(*take), F.struct(start, *order)).alias("__last"))
    both = inside.join(last, list(keys), "left")
    return both.select(*points.columns, *[F.when(F.coalesce("__ok", F.lit(False)), F.col(c)).otherwise(F.col(f"__last.{c}")).alias(c) for c in take])


def greedy_claim(left: DataFrame, right: DataFrame, keys: Cols, left_order: str, right_order: str, accepts):
    """Left rows in their order each claim the first free right row that ``accepts(left, right)`` (of dicts). Claims depend on earlier
    claims, so each key's rows are folded in one task; keys are small units, as a staff of a system."""
    import pandas as pd

    lcols, rcols = left.columns, right.columns
    schema = ", ".join([f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys] + [f"`{left_order}` {left.schema[left_order].dataType.simpleString()}", f"`{right_order}` {right.schema[right_order].dataType.simpleString()}"])

    def fold(key, a, b):
        free, out = b[rcols].sort_values(right_order).to_dict("records"), []
        for row in a[lcols].sort_values(left_order).to_dict("records"):
            k = next((i for i, x in enumerate(free) if accepts(row, x)), None)
            if k is not None:
                out.append((*key, row[left_order], free.pop(k)[right_order]))
        return pd.DataFrame(out, columns=[*keys, left_order, right_order])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fold, schema)
