"""Operators on ordered events. Every one is partitioned by key columns and ordered by explicit columns (give a tiebreak)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Cols = Sequence[str]


def _w(keys: Cols, order: Cols):
    return W.partitionBy(*keys).orderBy(*order)


def gap_islands(df: DataFrame, keys: Cols, order: Cols, start: Column, end: Column, gap: float, name: str = "island") -> DataFrame:
    """Number the runs of rows in which each starts at most ``gap`` after the one before ends (a larger gap starts a new run)."""
    w = _w(keys, order)
    new = F.coalesce((start - F.lag(end).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def islands_where(df: DataFrame, keys: Cols, order: Cols, joins_previous: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows that each satisfy ``joins_previous``, a condition with window functions over ``window(keys, order)``."""
    w = _w(keys, order)
    return df.withColumn("__new", F.when(F.coalesce(joins_previous, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def merge_ties(df: DataFrame, keys: Cols, order: Cols, tie: str, same: Cols, start: str, dur: str, blocked: Column, tolerance: float = 1e-6) -> DataFrame:
    """Join each row to the one before if that one's ``tie`` is set, ``same`` columns are equal, it ends where this starts and ``blocked`` is false.

    Returns keys, ``same``, start, summed dur and the last row's tie."""
    w = _w(keys, order)
    joins = F.lag(tie).over(w) & (F.abs(F.lag(F.col(start) + F.col(dur)).over(w) - F.col(start)) < tolerance) & ~blocked
    for c in same:
        joins = joins & (F.lag(c).over(w) == F.col(c))
    runs = islands_where(df, keys, order, joins)
    last = F.struct(*order)
    return runs.groupBy(*keys, "island").agg(*[F.first(c).alias(c) for c in same], F.min(start).alias(start), F.sum(dur).alias(dur), F.max_by(tie, last).alias(tie)).drop("island")


def fold(df: DataFrame, keys: Cols, order: Cols, columns: Cols, schema: str, make) -> DataFrame:
    """Rows of each key, in their order, through a fold: ``make()`` gives a fresh step for each key, and step(row) a list of output rows, where a
    row is the tuple of ``columns`` and None marks the end of the key. For what depends on all rows before and no window can say. Rows are
    sorted by key and streamed in batches, so a task holds a batch and a state, however many rows a key has. Output: keys, then ``schema``."""
    n, kinds = len(keys), [df.schema[k].dataType.simpleString() for k in keys]
    rows = df.select(*keys, *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    whole = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), schema])
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)

    def run(batches):
        import pyarrow as pa

        kind, now, step = None, None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(n + len(columns))), strict=True):
                if step is None or row[:n] != now:
                    if step is not None:
                        out += [(*now, *r) for r in step(None)]
                    now, step = row[:n], make()
                out += [(*now, *r) for r in step(row[n:])]
            kind = kind or to_arrow_schema(target)
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)
        if step is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*now, *r), strict=True)) for r in step(None)], schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(whole)
    return dealt.sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))]).mapInArrow(run, whole)


def anchored_clusters(df: DataFrame, keys: Cols, order: Cols, x: str, width: float, name: str = "cluster") -> DataFrame:
    """Clusters, numbered from 0, whose rows lie within ``width`` of their first row along ``x``: keys, the columns of ``order``, the number. The
    anchor depends on all rows before, so this is a ``fold``. ``order`` starts with ``x`` (nulls first, in a cluster with the first row after them)."""
    columns = list(dict.fromkeys([*order, x]))
    at, parts = columns.index(x), ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def make():
        anchor, n = None, -1

        def step(row):
            nonlocal anchor, n
            if row is None:
                return []
            if n < 0 or (row[at] is not None and anchor is not None and row[at] - anchor >= width):
                anchor, n = row[at], n + 1
            elif anchor is None:
                anchor = row[at]
            return [(*row, n)]

        return step

    return fold(df, keys, order, columns, f"{parts}, `{name}` int", make)


def chain_count(df: DataFrame, keys: Cols, order: Cols, near: Column) -> DataFrame:
    """How many rows from the first on satisfy ``near`` without a break: keys, n."""
    w = _w(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(F.coalesce(near, F.lit(False)).cast("int")).over(w)).groupBy(*keys).agg(F.sum("__ok").alias("n"))


def prefix_sum(df: DataFrame, keys: Cols, order: Cols, value: Column, name: str = "start") -> DataFrame:
    """Sum of all rows before (0 for the first)."""
    return df.withColumn(name, F.coalesce(F.sum(value).over(_w(keys, order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))


def forward_fill(df: DataFrame, keys: Cols, order: Cols, value: Column, name: str) -> DataFrame:
    """The last value that is not null, this row included."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_w(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def change_detect(df: DataFrame, keys: Cols, order: Cols, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before (null is a value); the first of a key counts as a change."""
    w = _w(keys, order)
    return df.withColumn("__first", F.row_number().over(w) == 1).withColumn("__same", F.lag(value).over(w).eqNullSafe(F.col(value))).where(F.col("__first") | ~F.col("__same")).drop("__first", "__same")


def unroll_repeats(df: DataFrame, keys: Cols, order: Cols, opens: str, closes: str, times: str, name: str = "pass") -> DataFrame:
    """Rows in performance order: a section starts at a row that ``opens`` or follows one that ``closes``, and is played as often as its closing
    row's ``times`` (at least once; without a closing row once). Adds section, pass and position."""
    w = _w(keys, order)
    new = F.col(opens) | F.coalesce(F.lag(closes).over(w), F.lit(False))
    cut = df.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("section", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    n = F.max(F.when(F.col(closes), F.greatest(F.lit(1), F.col(times))).otherwise(1)).over(W.partitionBy(*keys, "section"))
    played = cut.withColumn("__n", n).withColumn(name, F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    return played.withColumn("position", F.row_number().over(_w(keys, ["section", name, *order])))


def repeat_times(df: DataFrame, keys: Cols, order: Cols, opens: str, closes: str, written: str) -> DataFrame:
    """For each section the last written repeat count in it, 2 without one, as ``times`` of its rows."""
    w = _w(keys, order)
    new = F.col(opens) | F.coalesce(F.lag(closes).over(w), F.lit(False))
    cut = df.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("section", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    whole = _w([*keys, "section"], order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return cut.withColumn("times", F.coalesce(F.last(written, ignorenulls=True).over(whole), F.lit(2)))


def beat_grid(df: DataFrame, start: str, length: str, unit: str, beat: int, phase: Column | None = None) -> DataFrame:
    """A row for each multiple of ``unit`` within the bar: t and level (2 bar, 1 beat, 0 between); all in whole ticks. ``beat``: units of a beat;
    ``phase``: ticks by which a pickup bar is short."""
    shift = F.lit(0) if phase is None else phase
    steps = F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("long"), F.col(length) - 1, F.col(unit))).otherwise(F.array().cast("array<bigint>"))
    at = df.withColumn("__p", F.explode(steps))
    where = F.col("__p") + shift
    level = F.when(where == 0, 2).when(where % (F.col(unit) * beat) == 0, 1).otherwise(0)
    return at.withColumn("level", level).withColumn("t", F.col(start) + F.col("__p")).drop("__p")


def sliding(df: DataFrame, keys: Cols, order: Cols, value: Column, before: int, after: int, how: str, name: str) -> DataFrame:
    """``max``, ``min``, ``avg`` or ``sum`` over a frame of rows, cut at the borders."""
    w = _w(keys, order).rowsBetween(-before, after)
    return df.withColumn(name, {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}[how](value).over(w))


def continue_words(df: DataFrame, keys: Cols, order: Cols, text: str, hyphen: str, t: str, dur: str, pitch: str, gap: float = 0.05) -> DataFrame:
    """Sung text of each note: its own; without one, after a rest of more than ``gap`` or on a repeated pitch, the last whole syllable again; else
    null (the vowel goes on). Adds ``sung`` and ``word`` (number of the word that the syllable belongs to)."""
    w = _w(keys, order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    whole = F.last(F.when(F.col(text).isNotNull() & ~F.col(hyphen), F.col(text)), ignorenulls=True).over(upto)
    again = (F.col(t) - F.lag(F.col(t) + F.col(dur)).over(w) > gap) | (F.lag(pitch).over(w) == F.col(pitch))
    out = df.withColumn("sung", F.when(F.col(text).isNotNull(), F.col(text)).when(again, whole))
    ends = F.when(F.col("sung").isNotNull() & ~F.coalesce(F.col(hyphen), F.lit(False)), 1).otherwise(0)
    return out.withColumn("__e", ends).withColumn("word", F.coalesce(F.sum("__e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__e")


def persist_in_bar(df: DataFrame, keys: Cols, order: Cols, mark: Column, default: Column, name: str) -> DataFrame:
    """A mark holds for the rows after it with the same keys (bar and pitch class), until the next mark; before any, ``default`` holds."""
    return forward_fill(df, keys, order, mark, name).withColumn(name, F.coalesce(F.col(name), default))


def pickup_numbers(df: DataFrame, keys: Cols, order: Cols, number: str, short: Column) -> DataFrame:
    """Numbers count from 0 where the first row of a key is ``short`` (a pickup bar): all of the key's are lowered by one."""
    first = F.first(F.coalesce(short, F.lit(False))).over(_w(keys, order))
    return df.withColumn(number, F.col(number) - first.cast("int"))


def rescale_to_first(df: DataFrame, keys: Cols, order: Cols, value: str, wanted: Column) -> DataFrame:
    """All values of a key times wanted / first value, so the first becomes ``wanted``; null where the first is null or 0."""
    first = F.first(value).over(_w(keys, order))
    return df.withColumn(value, F.try_divide(F.col(value) * wanted, first))


def chord_voices(df: DataFrame, pitches: str, name: str = "midi") -> DataFrame:
    """A row for each pitch of a chord (array), the highest first: adds ``voice`` from 1 and the pitch. Empty and null chords have no row."""
    return df.select(*[c for c in df.columns if c != pitches], F.posexplode(F.sort_array(F.col(pitches), asc=False)).alias("__p", name)).withColumn("voice", F.col("__p") + 1).drop("__p")


def stacked_numbers(df: DataFrame, keys: Cols, order: Cols, x: str, text: str, upper: Column, width: float) -> DataFrame:
    """Digits in columns of ``width`` (x to the nearest column, halves to the even one): keys, place, and the digits above and below put together in order."""
    read = lambda side: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(side, F.struct(*order, F.col(text).alias("__t"))))), lambda s: s["__t"]))
    cut = df.withColumn("place", F.bround(F.col(x) / width).cast("int"))
    return cut.groupBy(*keys, "place").agg(read(upper).alias("above"), read(~upper).alias("below"))


def top_k(df: DataFrame, keys: Cols, order: Sequence, k: int, name: str | None = None) -> DataFrame:
    """The first k rows of each key, cut down before they are shuffled; ``name``: a column for their rank from 1."""
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k)
    return ranked.withColumnRenamed("__n", name) if name else ranked.drop("__n")


def melisma_groups(df: DataFrame, keys: Cols, order: Cols, syllable: str, t: str, dur: str, name: str = "group", within: float = 0.02) -> DataFrame:
    """Number the groups of a note with a syllable and the notes after it without one, each of which starts (within ``within``) where the one before ends."""
    w = _w(keys, order)
    follows = F.col(syllable).isNull() & (F.abs(F.lag(F.col(t) + F.col(dur)).over(w) - F.col(t)) < within)
    return islands_where(df, keys, order, follows, name)
