"""Operators that build bars and voices: pieces, rests, clusters, shared budgets, best candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import interval_overlap
from .ordered import fold, gap_islands, top_k

Cols = Sequence[str]


def split_at_bars(notes: DataFrame, bars: DataFrame, keys: Cols, width: float) -> DataFrame:
    """Pieces of notes [l_start, l_end) by the bars [r_start, r_end) of the same keys that they cross, with ``start``, ``stop`` and whether the piece is
    the note's ``first``. Time outside all bars gives no piece. ``width``: a usual bar, for the buckets of the join."""
    met = interval_overlap(notes, bars, keys, width)
    return met.withColumns({"start": F.greatest("l_start", "r_start"), "stop": F.least("l_end", "r_end"), "first": F.col("l_start") >= F.col("r_start")})


def fill_rests(df: DataFrame, keys: Cols, order: Cols, start: str, end: str, until: Column) -> DataFrame:
    """Notes in their order with the rests between them: keys, start, stop, is_rest. A note that starts before the last kept one ends is left out;
    what lies before the first note (from 0) and after the last one (to the ``until`` of the last row) is rest. What is kept depends on all notes
    before, so this is a ``fold``: a task holds a batch of rows, whatever a key has."""
    number = df.schema[start].dataType.simpleString()

    def make():
        at, upto = 0, 0

        def step(row):
            nonlocal at, upto
            if row is None:
                return [(at, upto, True)] if at < upto else []
            s, e, upto = row
            if s < at:
                return []
            out = [(at, s, True)] if at < s else []
            at = e
            return [*out, (s, e, False)]

        return step

    rows = df.withColumn("__until", until)
    return fold(rows, keys, order, [start, end, "__until"], f"start {number}, stop {number}, is_rest boolean", make)


def keep_apart(df: DataFrame, keys: Cols, order: Cols, x: str, least: float) -> DataFrame:
    """Keys and ``x`` of the rows, in their order, that lie at least ``least`` from every row kept before (equal texts printed on each other count
    once). Nearness to kept rows is not transitive, so this is a ``fold``; kept places are held in sorted order and the two next to a row looked
    at, so a row costs a binary search."""

    def make():
        from bisect import bisect_left, insort

        kept: list = []

        def step(row):
            if row is None or row[0] is None:
                return []
            i = bisect_left(kept, row[0])
            if any(abs(k - row[0]) < least for k in kept[max(0, i - 1) : i + 1]):
                return []
            insort(kept, row[0])
            return [row]

        return step

    return fold(df, keys, order, [x], f"`{x}` {df.schema[x].dataType.simpleString()}", make)


def best_scoring(candidates: Sequence[DataFrame], keys: Cols, score: str, order: str, limit: Column | None = None) -> DataFrame:
    """Of all candidate tables (same columns) the row with the least ``score`` for each key, the first in ``order`` if equal; ``limit``: a
    condition that candidates must meet. Least rows are found before the shuffle."""
    every = reduce(DataFrame.unionByName, candidates)
    if limit is not None:
        every = every.where(limit)
    rest = [c for c in every.columns if c not in {*keys, score, order}]
    return every.groupBy(*keys).agg(F.min(F.struct(score, order, *rest)).alias("__b")).select(*keys, "__b.*")


def bar_lengths(df: DataFrame, keys: Cols, bar: str, voice: str, dur: str, meter: Column) -> DataFrame:
    """Length of each bar: the longest voice's sum; but the meter where the most frequent sum (the first voice's if tied) equals it, except
    in the first bar of the keys."""
    sums = df.groupBy(*keys, bar, voice).agg(F.sum(dur).alias("__sum"), F.max(meter).alias("__meter"))
    by_sum = sums.groupBy(*keys, bar, "__sum").agg(F.count("*").alias("__n"), F.min(voice).alias("__v"), F.max("__meter").alias("__meter"))
    bars = by_sum.groupBy(*keys, bar).agg(F.max("__sum").alias("__most"), F.min(F.struct((-F.col("__n")).alias("n"), "__v", "__sum")).alias("__mode"), F.max("__meter").alias("__meter"))
    first = F.min(bar).over(W.partitionBy(*keys)) == F.col(bar)
    return bars.select(*keys, bar, F.when(~first & (F.col("__mode.__sum") == F.col("__meter")), F.col("__meter")).otherwise(F.col("__most")).alias("length"))


def share_evenly(df: DataFrame, start: str, dur: str, parts: Column) -> DataFrame:
    """Each row cut into so many equal parts, with ``part`` from 0; less than one part counts as one."""
    n = F.greatest(F.coalesce(parts, F.lit(1)).cast("int"), F.lit(1))
    cut = df.withColumn("__n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return cut.withColumns({start: F.col(start) + F.col(dur) * F.col("part") / F.col("__n"), dur: F.col(dur) / F.col("__n")}).drop("__n")


def cluster_extents(df: DataFrame, keys: Cols, order: Cols, x: str, gap: float, **flags: Column) -> DataFrame:
    """Runs of rows no farther than ``gap`` from the one before, as one row each: the greatest ``x``, and each flag set if a member has it."""
    runs = gap_islands(df, keys, order, F.col(x), F.col(x), gap)
    return runs.groupBy(*keys, "island").agg(F.max(x).alias(x), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in flags.items()])


def share_budget(df: DataFrame, keys: Cols, order: Cols, onset: str, coda: str, budget: Column) -> DataFrame:
    """Onset and coda lengths scaled so that a row's coda and the next row's onset fit in the row's budget. An onset is looked at by the row before
    only, and a coda by its own row, so one window pass settles all."""
    w = W.partitionBy(*keys).orderBy(*order)
    need = F.col(coda) + F.coalesce(F.lead(onset).over(w), F.lit(0))
    scaled = df.withColumn("__scale", F.when(need > budget, budget / need).otherwise(F.lit(1.0)))
    return scaled.withColumns({onset: F.col(onset) * F.coalesce(F.lag("__scale").over(w), F.lit(1.0)), coda: F.col(coda) * F.col("__scale")}).drop("__scale")


def pitch_errors(notes: DataFrame, frames: DataFrame, keys: Cols, note: str, target: str, width: float, least: int = 3, part: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Cents between the median of the voiced frames (``hz`` > 0, at ``t``) in the middle part of each note [start, start + dur) and its target.
    Notes with fewer than ``least`` such frames give no row. ``width``: a usual note, for the buckets that notes and frames meet in."""
    lo, hi = F.col("start") + part[0] * F.col("dur"), F.col("start") + part[1] * F.col("dur")
    spans = notes.select(*keys, note, target, lo.alias("__lo"), hi.alias("__hi")).withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    voiced = frames.where("hz > 0").select(*keys, "t", "hz", F.floor(F.col("t") / width).alias("__b"))
    met = spans.join(voiced, [*keys, "__b"]).where("t >= __lo and t < __hi")
    found = met.groupBy(*keys, note, target).agg(F.median("hz").alias("__m"), F.count("*").alias("n")).where(F.col("n") >= least)
    return found.select(*keys, note, "n", (1200 * F.log2(F.col("__m") / F.col(target))).alias("cents"))


def copy_words(notes: DataFrame, others: DataFrame, keys: Cols, start: str, lyrics: str, merge: bool = False) -> DataFrame:
    """Notes with the lyrics (maps by verse) of another voice at the same time, to four digits: where they have none, or (``merge``) for each verse that they lack. Of several
    others at a time the one of the greatest start counts, then any."""
    from ..functions.scalars import map_union

    sung = others.where(F.size(lyrics) > 0)
    there = sung.groupBy(*keys, F.bround(start, 4).alias("__t")).agg(F.max_by(F.col(lyrics), F.col(start)).alias("__other"))
    both = notes.withColumn("__t", F.bround(start, 4)).join(there, [*keys, "__t"], "left")
    none = F.col(lyrics).isNull() | (F.size(lyrics) == 0)
    copied = F.when(none, F.coalesce("__other", F.col(lyrics))).otherwise(map_union(F.col(lyrics), F.col("__other")) if merge else F.col(lyrics))
    return both.withColumn(lyrics, copied).drop("__t", "__other")


def with_fill(own: DataFrame, other: DataFrame, keys: Cols, start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """Rows of a part and, as ``filled``, those of another that none of its own overlaps."""
    span = lambda df, side: df.withColumns({f"{side}_start": F.col(start), f"{side}_end": F.col(end)})
    free = interval_overlap(span(other, "l"), span(own, "r").select(*keys, "r_start", "r_end"), keys, 1.0, tolerance, "left_anti").drop("l_start", "l_end")
    return own.withColumn("filled", F.lit(False)).unionByName(free.withColumn("filled", F.lit(True)))


def select_parts(parts: DataFrame, keys: Cols, wanted: str, order: str, name: str = "name") -> DataFrame:
    """The parts (``name``, display_name) that are asked for: ``all``, or the first in order that has the name, whatever its case and with or without a dot behind it, or the
    display name. ``tutti`` asks for no part in particular: none."""
    asked = wanted.strip().lower()
    if asked == "all":
        return parts
    bare = lambda c: F.rtrim(F.lower(c), F.lit("."))
    fits = (bare(F.col(name)) == asked.rstrip(".")) | (F.lower("display_name") == asked)
    return top_k(parts.where(fits if asked != "tutti" else F.lit(False)), keys, [order], 1)


def judged_notes(notes: DataFrame, least: float, part: str | None = None, parts: Sequence[str] | None = None, bars: tuple[int, int] | None = None) -> DataFrame:
    """Notes of at least ``least`` seconds, of some parts only and (``bar``) from one bar to another, where given."""
    kept = notes.where(F.col("dur") >= least)
    if parts is not None:
        kept = kept.where(F.col(part).isin(*parts))
    return kept if bars is None else kept.where(F.col("bar").between(*bars))


def choose_singers(kinds: DataFrame, banks: DataFrame) -> DataFrame:
    """For each voice kind its bank, modes (array of struct name, weight), gender, and whether it is a ``stand_in``: the first installed one of the same sex, in its plain mode,
    where its own is not there. A kind without any raises."""
    from ..functions.constants import SINGERS, STAND_INS

    spark = kinds.sparkSession
    own = [(kind, 0, bank, [list(m) for m in modes], gender) for kind, (bank, modes, gender) in SINGERS.items()]
    other = [(kind, 1 + i, bank, [["standard", 1.0]], SINGERS[kind][2]) for kind, names in STAND_INS.items() for i, bank in enumerate(names) if bank != SINGERS[kind][0]]
    wanted = spark.createDataFrame([(k, p, b, [(m, float(w)) for m, w in ms], float(g)) for k, p, b, ms, g in own + other], "kind string, place int, bank string, modes array<struct<name:string,weight:double>>, gender double")
    best = wanted.join(F.broadcast(banks.select("bank").distinct()), "bank", "left_semi").groupBy("kind").agg(F.min_by(F.struct("bank", "modes", "gender", (F.col("place") > 0).alias("stand_in")), "place").alias("s"))
    found = kinds.join(F.broadcast(best), "kind", "left")
    checked = F.coalesce(F.col("s.bank"), F.raise_error(F.concat(F.lit("no voice bank for the "), F.col("kind"))).cast("string"))
    return found.withColumns({"bank": checked, "modes": F.col("s.modes"), "gender": F.col("s.gender"), "stand_in": F.col("s.stand_in")}).drop("s")


def first_printed(words: DataFrame, keys: Cols, order: Cols, least: float = 1.0) -> DataFrame:
    """Words (text, x0, y) but those that are printed within ``least`` of an equal one kept before, both ways. Nearness to kept words is not transitive: a ``fold`` over the words of equal text."""
    columns = [c for c in words.columns if c not in {*keys, "text"}]
    parts = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in columns)
    x, y = columns.index("x0"), columns.index("y")

    def make():
        kept: list = []

        def step(row):
            if row is None or any(abs(a - row[x]) < least and abs(b - row[y]) < least for a, b in kept):
                return []
            kept.append((row[x], row[y]))
            return [row]

        return step

    return fold(words, [*keys, "text"], order, columns, parts, make)
