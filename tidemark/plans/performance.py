"""A score's tables to a timed performance and a quality report. Tables are described in FIXTURES.md."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import beat_unit
from ..functions.text import split_glued, verse_of_pass
from ..operators import aggregates, joins, ordered, structure


def performed_measures(measures: DataFrame, tempos: DataFrame) -> DataFrame:
    """Measures (score_id, idx, start, length, repeat_start, repeat_end, repeat_times) in performance order with pass, position, qpm, t (seconds) and seconds.
    A bar's tempo is that in force at its start, the first one before any mark."""
    played = ordered.unroll_repeats(measures, ["score_id"], ["idx"], "repeat_start", "repeat_end", "repeat_times")
    marks = tempos.select("score_id", (F.col("start") - 1e-6).alias("start"), "qpm")
    timed = joins.asof(played, marks, ["score_id"], "start", ["qpm"], ["qpm"], default_first=True)
    timed = timed.withColumn("seconds", F.col("length") * 60.0 / F.col("qpm"))
    return ordered.prefix_sum(timed, ["score_id"], ["position"], F.col("seconds"), "t").withColumn("t", F.col("t").cast("double"))


def performed_notes(notes: DataFrame, played: DataFrame) -> DataFrame:
    """Notes (score_id, part, voice, start, dur, midi, lyrics map verse -> struct(text, hyphen_after), measure) of every pass in seconds, with the
    syllable of the pass's verse, the sung text and the number of its word."""
    bar = played.select("score_id", F.col("idx").alias("measure"), "pass", "position", F.col("start").alias("__bar"), F.col("t").alias("__t"), "qpm")
    at = notes.join(bar, ["score_id", "measure"])
    rate = F.lit(60.0) / F.col("qpm")
    timed = at.withColumn("t", F.col("__t") + (F.col("start") - F.col("__bar")) * rate).withColumn("seconds", F.col("dur") * rate)
    timed = timed.withColumn("__s", verse_of_pass(F.col("lyrics"), F.col("pass"))).withColumns({"text": split_glued(F.col("__s.text")), "hyphen_after": F.coalesce(F.col("__s.hyphen_after"), F.lit(False))})
    sung = ordered.continue_words(timed, ["score_id", "part", "voice"], ["position", "t", "midi"], "text", "hyphen_after", "t", "seconds", "midi")
    return sung.select("score_id", "part", "voice", "position", "pass", "t", F.col("seconds").alias("dur"), "midi", "text", "hyphen_after", "sung", "word")


def beats_of(played: DataFrame, measures: DataFrame, click: float | None = None) -> DataFrame:
    """score_id, t, level: the metronome's clicks over the performance, every beat of a bar (``click``: every so many quarters): 2 at a bar's start, 1 on its beats, 0 between. A short bar counts from the end of a full one. Places are whole 960ths of a quarter."""
    unit = beat_unit(F.col("num"), F.col("den"))["unit"]
    ticks = lambda c: F.bround(c * 960).cast("long")
    rows = played.drop("num", "den").join(measures.select("score_id", "idx", "num", "den"), ["score_id", "idx"]).withColumn("__beat", ticks(unit))
    step = F.col("__beat") if click is None else F.lit(round(click * 960)).cast("long")
    full = F.col("num") * 4 / F.col("den")
    rows = rows.withColumns({"__len": ticks(F.col("length")), "__step": step, "__phase": F.greatest(F.lit(0), ticks(full - F.col("length"))), "__t": F.col("t"), "__rate": 60.0 / F.col("qpm") / 960})
    steps = F.when(F.col("__len") > 0, F.sequence(F.lit(0).cast("long"), F.col("__len") - 1, F.col("__step"))).otherwise(F.array().cast("array<bigint>"))
    at = rows.withColumn("__p", F.explode(steps))
    place = F.col("__p") + F.col("__phase")
    level = F.when(place == 0, 2).when(place % F.col("__beat") == 0, 1).otherwise(0)
    return at.select("score_id", (F.col("__t") + F.col("__p") * F.col("__rate")).alias("t"), level.alias("level"))


def first_tempo(measures: DataFrame, tempos: DataFrame, click: float | None = None) -> DataFrame:
    """score_id, seconds of a click, clicks in a bar, by the second measure (or the only one) and the tempo at the start: for the count-in."""
    bar = measures.groupBy("score_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("idx", "num", "den"))), 1, 2).alias("b")).select("score_id", F.element_at("b", -1).alias("b"))
    qpm = tempos.groupBy("score_id").agg(F.min_by("qpm", "start").alias("qpm"))
    unit = beat_unit(F.col("b.num"), F.col("b.den"))["unit"] if click is None else F.lit(click)
    return bar.join(qpm, "score_id").select("score_id", (unit * 60 / F.col("qpm")).alias("seconds"), F.round(F.col("b.num") * 4 / F.col("b.den") / unit).cast("int").alias("clicks"))


def judged_notes(notes: DataFrame, frames: DataFrame, rate: float = 100.0) -> DataFrame:
    """notes (part, voice, t, dur, syllable: whether it starts one, or null if unknown) of at least 0.15 s with ``silent``, ``late`` and ``delay``: silent if the mean level from 30 to 80 % of the note is under 0.15 of the median of active frames (above 5 % of the peak); else the
    delay is that of the first frame up to there from 150 ms before the note on that reaches half of that mean. A note is late by more than 70 ms, unless the one before still sounds (ends less than 30 ms before it) or it goes on a syllable. frames: part, voice, frame_idx, level."""
    keys = ["part", "voice"]
    has = "syllable" in notes.columns
    w = W.partitionBy(*keys).orderBy("t", "dur")
    known = notes.withColumn("__sounding", F.coalesce(F.col("t") - F.lag(F.col("t") + F.col("dur")).over(w) < 0.03, F.lit(False)))
    known = known.withColumn("__goes_on", ~F.coalesce(F.col("syllable"), F.lit(True)) if has else F.lit(False)).withColumn("__id", F.row_number().over(w))
    peak = frames.groupBy(*keys).agg(F.max("level").alias("__peak"))
    active = frames.join(peak, keys).where(F.col("level") > 0.05 * F.col("__peak"))
    medians = aggregates.percentile_report(active, keys, "level").select(*keys, F.col("median").alias("__median"))
    spans = known.where("dur >= 0.15").select(*known.columns, F.floor((F.col("t") - 0.15) * rate).alias("l_start"), F.floor((F.col("t") + 0.8 * F.col("dur")) * rate).alias("l_end"))
    cells = frames.select(*keys, "frame_idx", "level", F.col("frame_idx").alias("r_start"), (F.col("frame_idx") + 1).alias("r_end"))
    hit = joins.interval_overlap(spans, cells, keys, width=2 * rate)
    middle = F.col("frame_idx") >= F.floor((F.col("t") + 0.3 * F.col("dur")) * rate)
    means = hit.groupBy(*keys, "__id").agg(F.avg(F.when(middle, F.col("level"))).alias("__mid"))
    first = hit.join(means, [*keys, "__id"]).where(F.col("level") >= F.col("__mid") / 2).groupBy(*keys, "__id").agg(F.min("frame_idx").alias("__first"))
    judged = spans.drop("l_start", "l_end").join(means, [*keys, "__id"], "left").join(first, [*keys, "__id"], "left").join(medians, keys, "left")
    silent = F.coalesce(F.col("__mid") < 0.15 * F.col("__median"), F.lit(True))
    delay = F.when(~silent, F.col("__first") / rate - F.col("t"))
    late = F.coalesce(delay > 0.07, F.lit(False)) & ~F.col("__sounding") & ~F.col("__goes_on")
    return judged.withColumns({"silent": silent, "delay": delay, "late": late}).drop("__id", "__mid", "__first", "__median", "__sounding", "__goes_on")


def quality_report(notes: DataFrame, frames: DataFrame, rate: float = 100.0, listed: int = 8) -> DataFrame:
    """For each part and voice: how many notes were judged, how many are silent and late, and the first ``listed`` starts of each (``judged_notes``)."""
    judged = judged_notes(notes, frames, rate)
    starts = lambda c: F.slice(F.array_sort(F.collect_list(F.when(F.col(c), F.col("t")))), 1, listed).alias(f"{c}_at")
    # of a voice at most the first few starts of each kind are gathered
    few = reduce(DataFrame.unionByName, [ordered.top_k(judged.where(c), ["part", "voice"], ["t"], listed) for c in ("silent", "late")]).distinct()
    lists = few.groupBy("part", "voice").agg(starts("silent"), starts("late"))
    counts = aggregates.conditional_report(judged, ["part", "voice"], silent=F.col("silent"), late=F.col("late")).withColumnRenamed("n", "notes")
    none = F.array().cast("array<double>")
    return counts.join(lists, ["part", "voice"], "left").withColumns({"silent_at": F.coalesce("silent_at", none), "late_at": F.coalesce("late_at", none)})


def pitch_report(notes: DataFrame, frames: DataFrame, width: float = 1.0) -> DataFrame:
    """For each part and voice: notes judged, the median and 90th percentile of their pitch errors in cents, and how many are more than 50 cents off. Notes (part, voice, note, t, dur, target in hertz) of at least 0.25 s count; frames: part, voice, t, hz."""
    asked = notes.where("dur >= 0.25").withColumnRenamed("t", "start")
    errors = structure.pitch_errors(asked, frames, ["part", "voice"], "note", "target", width).withColumn("cents", F.abs("cents"))
    spread = aggregates.percentile_report(errors, ["part", "voice"], "cents")
    return aggregates.conditional_report(errors, ["part", "voice"], off=F.col("cents") > 50).withColumnRenamed("n", "notes").join(spread, ["part", "voice"])
