"""Score tables to MusicXML 4.0 (partwise): a note, a measure, a part, a score a row, without a driver loop over notes. Tables are described in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import DIVISIONS, note_shapes
from ..functions.scalars import clef, lookup, spelling, split_duration
from ..functions.text import escape_xml
from ..operators.aggregates import extremes
from ..operators.ordered import fold
from ..operators.structure import split_at_bars

VOICE = ["score_id", "part", "voice"]
HEADER = '<?xml version="1.0" encoding="UTF-8" standalone="no"?>\n<!DOCTYPE score-partwise PUBLIC "-//Recordare//DTD MusicXML 4.0 Partwise//EN" "http://www.musicxml.org/dtds/partwise.dtd">\n<score-partwise version="4.0">'
TRIPLET = "<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification>"


def _tag(name: str, *content, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *[c if isinstance(c, Column) else F.lit(c) for c in content], F.lit(f"</{name}>"))


def _if(condition: Column, text) -> Column:
    return F.when(condition, text).otherwise("")


def _joined(rows: Column, field: str, by: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r[field]), by)


def voice_pieces(notes: DataFrame, measures: DataFrame, width: float = 8.0) -> DataFrame:
    """What each voice writes in each measure, in divisions: score_id, part, voice, idx, at, dur, note (its ordinal; null: a rest), tie_in, tie_out, first. Notes are cut at the barlines that they cross; one that starts before the
    kept one before it ends is left out; gaps are rests, and a measure without notes is one. Kept notes depend on all before them in the measure: a ``fold``."""
    bars = measures.select("score_id", "idx", F.col("start").alias("r_start"), (F.col("start") + F.col("length")).alias("r_end"), F.bround(F.col("length") * DIVISIONS).cast("int").alias("__len"))
    spans = notes.select(*VOICE, "ord", F.col("start").alias("l_start"), (F.col("start") + F.col("dur")).alias("l_end"))
    cut = split_at_bars(spans, bars, ["score_id"], width).where(F.col("stop") - F.col("start") > 1e-6)
    ticks = lambda c: F.bround(c * DIVISIONS).cast("int")
    at = ticks(F.col("start") - F.col("r_start"))
    placed = cut.select(*VOICE, "idx", at.alias("at"), F.least(at + ticks(F.col("stop") - F.col("start")), F.col("__len")).alias("end"), F.col("ord").alias("note"), (~F.col("first")).alias("tie_in"), (F.col("stop") < F.col("l_end") - 1e-6).alias("tie_out"), "first")
    ends = notes.select(*VOICE).distinct().join(bars.select("score_id", "idx", "__len"), "score_id")
    nothing = F.lit(None).cast("boolean")
    closing = ends.select(*VOICE, "idx", F.col("__len").alias("at"), F.col("__len").alias("end"), F.lit(None).cast("long").alias("note"), nothing.alias("tie_in"), nothing.alias("tie_out"), nothing.alias("first"))
    rows = placed.where("at < end").unionByName(closing).withColumn("__last", F.col("note").isNull())

    def make():
        done = 0

        def step(row):
            nonlocal done
            if row is None:
                return []
            start, end, note, *flags = row
            rest = [(done, start - done, None, False, False, False)] if start > done else []
            if note is None:
                return rest
            if start < done:
                return []
            done = end
            return [*rest, (start, end - start, note, *flags)]

        return step

    return fold(rows, [*VOICE, "idx"], ["__last", "at", "note"], ["at", "end", "note", "tie_in", "tie_out", "first"], "at int, dur int, note long, tie_in boolean, tie_out boolean, first boolean", make)


def lyric_xml(notes: DataFrame, pieces: DataFrame) -> DataFrame:
    """VOICE, note, lyrics: the lyric elements of each written note's first piece. Whether a syllable begins, goes on or ends a word depends on the hyphens of its verse in the voice."""
    from ..functions.scalars import syllabic

    kept = pieces.where("first").select(*VOICE, F.col("note").alias("ord"), "idx", "at")
    verses = notes.join(kept, [*VOICE, "ord"]).select(*VOICE, "ord", "idx", "at", F.explode("lyrics").alias("verse", "s"))
    before = F.lag("s.hyphen_after").over(W.partitionBy(*VOICE, "verse").orderBy("idx", "at"))
    text = F.concat(F.format_string('<lyric number="%d">', "verse"), _tag("syllabic", syllabic(before, F.col("s.hyphen_after"))), _tag("text", escape_xml(F.col("s.text"))), F.lit("</lyric>"))
    return verses.withColumn("x", text).groupBy(*VOICE, F.col("ord").alias("note")).agg(_joined(F.collect_list(F.struct("verse", "x")), "x", "").alias("lyrics_xml"))


def note_xml(notes: DataFrame, measures: DataFrame) -> DataFrame:
    """One element for each written note or rest: VOICE, idx, at, piece, xml. Durations that no single note shape has become tied ones. notes: score_id, part, voice (from 1), ord, start, dur, midi, lyrics (map verse -> struct(text, hyphen_after)),
    x_notehead; measures: score_id, idx, number, start, length, num, den, fifths, repeat_start, repeat_end, repeat_times, text."""
    shapes = note_shapes()
    pieces = voice_pieces(notes, measures)
    split = pieces.withColumn("__p", split_duration(F.col("dur"), list(shapes))).select("*", F.size("__p").alias("__n"), F.posexplode("__p").alias("piece", "d")).drop("__p")
    facts = notes.select(*VOICE, F.col("ord").alias("note"), "midi", F.coalesce("x_notehead", F.lit(False)).alias("__cross"))
    rows = split.join(facts, [*VOICE, "note"], "left").join(lyric_xml(notes, pieces), [*VOICE, "note"], "left").join(measures.select("score_id", "idx", "fifths"), ["score_id", "idx"])
    kind = F.coalesce(lookup(F.col("d").cast("int"), {d: name for d, (name, _, _) in shapes.items()}), F.lit("quarter"))
    dots = F.coalesce(lookup(F.col("d").cast("int"), {d: n for d, (_, n, _) in shapes.items()}), F.lit(0))
    triplet = F.col("d").isin(*[d for d, (_, _, t) in shapes.items() if t])
    written = F.col("note").isNotNull()
    stop = written & ((F.col("piece") > 0) | F.col("tie_in"))
    go = written & ((F.col("piece") < F.col("__n") - 1) | F.col("tie_out"))
    p = spelling(F.col("midi"), F.col("fifths"))
    alter = _if(p["alter"] != 0, F.format_string("<alter>%d</alter>", p["alter"]))
    pitch = F.when(written, F.concat(F.lit("<pitch><step>"), p["step"], F.lit("</step>"), alter, F.format_string("<octave>%d</octave></pitch>", p["octave"]))).otherwise("<rest/>")
    ties = F.concat(_if(stop, '<tie type="stop"/>'), _if(go, '<tie type="start"/>'))
    tied = F.concat(_if(stop, '<tied type="stop"/>'), _if(go, '<tied type="start"/>'))
    xml = F.concat(
        F.lit("<note>"), pitch, F.format_string("<duration>%d</duration>", F.col("d")), ties, F.format_string("<voice>%d</voice>", F.col("voice")), _tag("type", kind), F.repeat(F.lit("<dot/>"), dots), _if(triplet, TRIPLET),
        _if(F.coalesce("__cross", F.lit(False)), "<notehead>x</notehead>"), _if(stop | go, _tag("notations", tied)), _if((F.col("piece") == 0) & F.col("lyrics_xml").isNotNull(), F.col("lyrics_xml")), F.lit("</note>"),
    )
    return rows.select(*VOICE, "idx", "at", "piece", xml.alias("xml"))


def measure_xml(notes: DataFrame, measures: DataFrame, parts: DataFrame, tempos: DataFrame) -> DataFrame:
    """(score_id, part, idx, xml): one element for each part's measure. Key and time are written where they change; divisions, clef and a short first measure's mark in the first; the tempo in the first part's first; repeats, texts and the
    final barline where they are. parts: score_id, part, ord, display_name; tempos: score_id, start, qpm."""
    w = W.partitionBy("score_id").orderBy("idx")
    changed = lambda *cs: ~_all([F.lag(c).over(w).eqNullSafe(F.col(c)) for c in cs]) | (F.row_number().over(w) == 1)
    last = F.max("idx").over(W.partitionBy("score_id"))
    bars = measures.withColumns({"__key": changed("fifths"), "__time": changed("num", "den"), "__final": F.col("idx") == last, "__first": F.col("idx") == F.min("idx").over(W.partitionBy("score_id"))})
    body = note_xml(notes, measures).groupBy(*VOICE, "idx").agg(_joined(F.collect_list(F.struct("at", "piece", "xml")), "xml").alias("v"))
    whole = body.join(measures.select("score_id", "idx", F.bround(F.col("length") * DIVISIONS).cast("int").alias("__len")), ["score_id", "idx"])
    lowest = whole.withColumn("__low", F.min("voice").over(W.partitionBy("score_id", "part")))
    back = F.when(F.col("voice") > F.col("__low"), F.concat(F.format_string("<backup><duration>%d</duration></backup>\n", "__len"), "v")).otherwise(F.col("v"))
    voices = lowest.withColumn("v", back).groupBy("score_id", "part", "idx").agg(_joined(F.collect_list(F.struct("voice", "v")), "v").alias("voices"))
    ranges = extremes(notes, ["score_id", "part"], "midi", 60)
    one = parts.join(ranges, ["score_id", "part"]).withColumn("__top", F.col("ord") == F.min("ord").over(W.partitionBy("score_id")))
    c = clef(F.col("lowest"), F.col("highest"), F.col("part"))
    sign = F.concat(F.format_string("<clef><sign>%s</sign><line>%d</line>", c["sign"], c["line"]), _if(c["octave"] != 0, F.format_string("<clef-octave-change>%d</clef-octave-change>", c["octave"])), F.lit("</clef>"))
    start = tempos.groupBy("score_id").agg(F.min_by("qpm", "start").alias("__qpm"))
    rows = bars.join(one, "score_id").join(start, "score_id", "left").join(voices, ["score_id", "part", "idx"], "left")
    attributes = F.concat(_if(F.col("__first"), f"<divisions>{DIVISIONS}</divisions>"), _if(F.col("__key"), F.format_string("<key><fifths>%d</fifths></key>", "fifths")), _if(F.col("__time"), F.format_string("<time><beats>%d</beats><beat-type>%d</beat-type></time>", "num", "den")), _if(F.col("__first"), sign))
    short = F.col("__first") & (F.col("length") < F.col("num") * 4 / F.col("den") - 1e-6)
    from ..functions.scalars import _short

    bpm = _short(F.col("__qpm"), 6)
    mark = F.concat(F.lit('<direction placement="above"><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>'), bpm, F.lit('</per-minute></metronome></direction-type><sound tempo="'), bpm, F.lit('"/></direction>'))
    words = F.concat(F.lit('<direction placement="above"><direction-type><words>'), escape_xml(F.col("text")), F.lit("</words></direction-type></direction>"))
    forward = '<barline location="left"><bar-style>heavy-light</bar-style><repeat direction="forward"/></barline>'
    backward = F.concat(F.lit('<barline location="right"><bar-style>light-heavy</bar-style>'), F.format_string('<repeat direction="backward" times="%d"/></barline>', F.coalesce("repeat_times", F.lit(2))))
    lines = [
        F.concat(F.format_string('<measure number="%d"', "number"), _if(short, ' implicit="yes"'), F.lit(">")),
        F.when(F.col("repeat_start"), forward),
        F.when(attributes != "", _tag("attributes", attributes)),
        F.when(F.col("__top") & F.col("__first") & F.col("__qpm").isNotNull(), mark),
        F.when(F.coalesce("text", F.lit("")) != "", words),
        F.col("voices"),
        F.when(F.col("repeat_end"), backward).when(F.col("__final"), '<barline location="right"><bar-style>light-heavy</bar-style></barline>'),
        F.lit("</measure>"),
    ]
    return rows.select("score_id", "part", "ord", "idx", F.concat_ws("\n", *lines).alias("xml"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def score_xml(scores: DataFrame, notes: DataFrame, measures: DataFrame, parts: DataFrame, tempos: DataFrame) -> DataFrame:
    """(score_id, xml): a whole document for each score (score_id, title). Ready for ``write.text`` or a file each."""
    bars = measure_xml(notes, measures, parts, tempos).groupBy("score_id", "part", "ord").agg(_joined(F.collect_list(F.struct("idx", "xml")), "xml").alias("__m"))
    place = F.row_number().over(W.partitionBy("score_id").orderBy("ord"))
    named = bars.join(parts.select("score_id", "part", "display_name"), ["score_id", "part"]).withColumn("__i", place)
    entry = F.concat(F.format_string('<score-part id="P%d">', "__i"), _tag("part-name", escape_xml(F.coalesce("display_name", "part"))), _tag("part-abbreviation", escape_xml(F.col("part"))), F.lit("</score-part>"))
    body = F.concat(F.format_string('<part id="P%d">\n', "__i"), "__m", F.lit("\n</part>"))
    whole = named.select("score_id", "__i", entry.alias("e"), body.alias("b")).groupBy("score_id").agg(F.collect_list(F.struct("__i", "e", "b")).alias("__p"))
    title = F.concat(F.lit("<work>"), _tag("work-title", escape_xml(F.coalesce("title", F.lit("Score")))), F.lit("</work>"))
    text = F.concat_ws("\n", F.lit(HEADER), title, F.lit("<part-list>"), _joined(F.col("__p"), "e"), F.lit("</part-list>"), _joined(F.col("__p"), "b"), F.lit("</score-partwise>"))
    return scores.join(whole, "score_id").select("score_id", text.alias("xml"))
