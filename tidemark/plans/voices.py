"""Performed notes to sung sounds: syllables, the text of diphone synthesis, and the segments of neural voices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants
from ..functions.phonetics import SYLLABLE, syllabify
from ..functions.scalars import consonant_lead, consonant_seconds, lookup, midi_hz
from ..operators import ordered, singing

VOICE = ["score_id", "part", "voice"]


def sung_notes(performed: DataFrame, dictionary: frozenset[str], lexicon: DataFrame, lang: str = "en-us") -> DataFrame:
    """Performed notes (``plans.performance.performed_notes``) with ``syllable`` and ``extra``: what each note sings; null where the vowel before goes on. A note that sings a syllable again counts as a word of its own."""
    own = performed.withColumn("hyphen", F.col("text").isNotNull() & F.coalesce(F.col("hyphen_after"), F.lit(False)))
    return syllabify(own, VOICE, ["position", "t", "midi"], "sung", "hyphen", dictionary, lexicon, lang)


def sung_groups(notes: DataFrame, detune: float = 0.0) -> DataFrame:
    """VOICE, grp, syllable, extra, start, end, notes (array of struct t, dur, midi): a syllable's note with those that it goes on over. A voice that starts without one sings A."""
    numbered = ordered.melisma_groups(notes, VOICE, ["t", "midi"], "syllable", "t", "dur", "grp")
    note = F.struct(F.col("t").cast("double").alias("t"), F.col("dur").cast("double").alias("dur"), (F.col("midi") + detune / 100).cast("double").alias("midi"))
    first = F.struct("t", "midi")
    vowel = F.struct(F.array().cast("array<string>").alias("onset"), F.lit("A").alias("nucleus"), F.array().cast("array<string>").alias("coda"))
    groups = numbered.groupBy(*VOICE, "grp").agg(F.array_sort(F.collect_list(note)).alias("notes"), F.min_by("syllable", first).alias("syllable"), F.min_by("extra", first).alias("extra"))
    last = F.element_at("notes", -1)
    return groups.withColumns({"syllable": F.coalesce("syllable", vowel), "extra": F.coalesce("extra", F.array().cast(f"array<{SYLLABLE}>")), "start": F.get("notes", F.lit(0))["t"], "end": last["t"] + last["dur"]})


def sung_sounds(notes: DataFrame, detune: float = 0.0, seed: int = 0) -> DataFrame:
    """VOICE, grp, sub, at, slot, phone, start, end, points: the sounds of each voice, laid end to end, with their pitch. A group ends where the next one's consonants start, or breathes for up to 40 ms before a rest; several syllables share it evenly, and only
    the first comes before the beat."""
    w = W.partitionBy(*VOICE).orderBy("grp")
    groups = sung_groups(notes, detune)
    lead = consonant_lead(F.transform("syllable.onset", consonant_seconds))
    follows = F.coalesce(F.lead("start").over(w) - F.col("end") < 0.02, F.lit(False))
    stop = F.when(follows, F.lead(F.col("start") - lead).over(w)).otherwise(F.col("end") - F.least(F.lit(0.04), (F.col("end") - F.col("start")) * 0.1))
    ended = groups.withColumn("__stop", stop).withColumn("__all", F.concat(F.array("syllable"), "extra"))
    parts = ended.select("*", F.posexplode("__all").alias("sub", "__s"), F.size("__all").alias("__n"))
    span = (F.col("__stop") - F.col("start")) / F.col("__n")
    units = parts.select(
        *VOICE, "grp", "sub", "__s.onset", "__s.nucleus", "__s.coda", "notes", (F.col("start") + span * F.col("sub")).alias("start"), (F.col("start") + span * (F.col("sub") + 1)).alias("end"), (F.col("sub") == 0).alias("lead"),
        F.array_max(F.transform("notes", lambda n: n["midi"])).alias("midi_high"),
    )
    order = ["grp", "sub"]
    placed = singing.place_syllables(units, VOICE, order)
    laid = singing.lay_out(placed, VOICE, [*order, "at"], "phone", "start", "end", "dur")
    known = laid.join(units.select(*VOICE, *order, "notes", F.size("onset").alias("__on")), [*VOICE, *order])
    first, last = midi_hz(F.get("notes", F.lit(0))["midi"]), midi_hz(F.element_at("notes", -1)["midi"])
    flat = lambda hz: F.array(F.struct(F.col("start").alias("t"), hz.alias("hz")), F.struct(F.col("end").alias("t"), hz.alias("hz")))
    curve = F.array_sort(singing.pitch_column(F.col("notes"), F.col("start"), F.col("end"), (F.col("grp") - 1 + seed).cast("int")))
    points = F.when(F.col("slot") == 0, F.array().cast("array<struct<t:double,hz:double>>")).when(F.col("at") < F.col("__on"), flat(first)).when(F.col("at") > F.col("__on"), flat(last)).otherwise(curve)
    return known.withColumn("points", points).select(*VOICE, *order, "at", "slot", "phone", "start", "end", "points")


def pho_text(sounds: DataFrame, total: float, self_joins: Sequence[str] = ()) -> DataFrame:
    """VOICE, text: each voice's sounds as the file that a diphone synthesiser reads: a short silence, then a line a sound, with silence up to 0.2 s after ``total``."""
    end = sounds.groupBy(*VOICE).agg(F.max("end").alias("start"), (F.max("grp") + 1).alias("grp")).where(F.col("start") < total)
    none = F.array().cast("array<struct<t:double,hz:double>>")
    rest = end.select(*VOICE, "grp", F.lit(0).alias("sub"), F.lit(0).alias("at"), F.lit(0).alias("slot"), F.lit("_").alias("phone"), "start", F.lit(total + 0.2).alias("end"), none.alias("points"))
    order = ["grp", "sub", "at", "slot"]
    lines = singing.pho_lines(sounds.unionByName(rest), VOICE, order, "points", self_joins)
    whole = lines.groupBy(*VOICE).agg(F.array_sort(F.collect_list(F.struct(*order, "piece", "line", "text"))).alias("l"))
    return whole.select(*VOICE, F.concat(F.lit("_ 20\n"), F.array_join(F.transform("l", lambda s: s["text"]), "\n"), F.lit("\n")).alias("text"))


def neural_segments(notes: DataFrame, model=None) -> DataFrame:
    """VOICE, phrase, seq, phone, start, end: the segments that a neural voice sings. Groups become units (several syllables share one evenly) in the other phone alphabet, a hum for a syllable without a vowel; units over 0.3 s apart are phrases; consonant lengths come from
    the model (70 ms without one), clipped and squeezed (``consonant_plan``); a phrase starts 0.32 s before its first sound."""
    groups = sung_groups(notes).withColumn("__all", F.concat(F.array("syllable"), "extra"))
    parts = groups.select(*VOICE, "grp", "notes", "start", "end", F.size("__all").alias("__n"), F.posexplode("__all").alias("sub", "__s"))
    span = (F.col("end") - F.col("start")) / F.col("__n")
    a, b = F.col("start") + span * F.col("sub"), F.col("start") + span * (F.col("sub") + 1)
    hum = F.when(F.col("__s.nucleus").isin(*constants.VOWELS), F.coalesce(lookup(F.col("__s.nucleus"), constants.ARPABET), F.lit("ah"))).otherwise(F.coalesce(lookup(F.col("__s.nucleus"), constants.ARPABET), F.lit("m")))
    inside = F.filter("notes", lambda n: (n["t"] < F.col("__b") - 1e-6) & (n["t"] + n["dur"] > F.col("__a") + 1e-6))
    units = parts.withColumns({"__a": a, "__b": b}).withColumn("__mine", inside)
    units = units.select(
        *VOICE, "grp", "sub", singing.arpabet(F.col("__s.onset")).alias("onset"), hum.alias("vowel"), singing.arpabet(F.col("__s.coda")).alias("coda"), F.col("__a").alias("t"), F.col("__b").alias("end"),
        F.coalesce(F.element_at(F.when(F.size("__mine") > 0, F.col("__mine")), -1)["t"], F.element_at("notes", -1)["t"]).alias("last_t"),
    )
    phrased = ordered.gap_islands(units, VOICE, ["grp", "sub"], F.col("t"), F.col("end"), 0.3, "phrase")
    keys, order = [*VOICE, "phrase"], ["grp", "sub"]
    proposed = singing.predicted_seconds(singing.predicted_seconds(phrased, "onset", model).withColumnRenamed("predicted", "onset_p"), "coda", model).withColumnRenamed("predicted", "coda_p")
    planned = singing.consonant_plan(proposed, keys, order)
    total = F.aggregate("on_d", F.lit(0.0), lambda acc, x: acc + x)
    opening = planned.withColumn("__t0", F.first(F.col("t") - total).over(W.partitionBy(*keys).orderBy(*order)) - constants.HEAD - 0.2)
    return singing.phrase_segments(opening.withColumnRenamed("__t0", "t0"), keys, order)
