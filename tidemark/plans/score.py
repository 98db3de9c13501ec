"""The symbols of drawn pages to a score: staves, systems, measures, chords, voices, lyrics, parts. Each step is one of the page operators over whole tables; a score, a page or a staff is a key.

Tables (``sources.landing``): glyphs, words, lines, beams, curves, by score_id, page and ord. ``read_score`` returns tables by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import ACCIDENTALS, CHORD_FONT, CLEFS, DOT, MUSIC_FONT, NOTEHEADS, RESTS, SPECIAL_FONT, STEP_SEMITONES, TEXT_FONT, TUPLETS, X_HEADS
from ..functions.scalars import beam_y_range, chord_duration, lookup, lyric_anchor, voice_rank
from ..operators import joins, ordered, pages, structure
from .steps import settle

SCORE, PAGE = ["score_id"], ["score_id", "page"]
SYSTEM = [*PAGE, "system"]
STAFF = [*SYSTEM, "staff"]


def page_layout(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """staves (numbered within their system, with geometry), glyphs and stems by staff, words by system, barlines."""
    lines, glyphs, words = t["lines"], t["glyphs"], t["words"]
    found = pages.with_geometry(pages.find_staves(pages.staff_line_candidates(lines, PAGE), PAGE))
    staves = settle(pages.number_systems(found, lines, PAGE), "staves")
    systems = staves.select(*SYSTEM).distinct()
    geometry = staves.select(*STAFF, "top", "bottom", "space", "mid")
    symbols = glyphs.where(~F.col("font").isin(TEXT_FONT, CHORD_FONT)).join(systems, PAGE)
    placed = pages.nearest_staff(symbols, staves, SYSTEM, ["ord"], *pages.glyph_band())
    on_staff = settle(symbols.join(placed, [*SYSTEM, "ord"]).join(geometry, STAFF), "glyphs")
    strokes = lines.join(systems, PAGE)
    upright = pages.stem_lines(strokes)
    stems = settle(upright.join(pages.nearest_staff(upright, staves, SYSTEM, ["ord"], *pages.stem_band()), [*SYSTEM, "ord"]).join(geometry, STAFF), "stems")
    first = on_staff.where((F.col("font") == MUSIC_FONT) & F.col("ch").isin(*NOTEHEADS, *RESTS)).groupBy(*SYSTEM).agg(F.min("x").alias("x"))
    bars = pages.barlines(pages.barline_lines(strokes, staves, SYSTEM), pages.repeat_dots(on_staff), staves, first, SYSTEM)
    space = staves.groupBy(*PAGE).agg(F.min_by("space", "top").alias("__sp"))
    bands = staves.groupBy(*SYSTEM).agg(F.min("top").alias("__top"), F.max("bottom").alias("__bottom")).join(space, PAGE)
    inside = words.join(bands, PAGE).where((F.col("y") > F.col("__top") - 12 * F.col("__sp")) & (F.col("y") < F.col("__bottom") + 8 * F.col("__sp"))).drop("__top", "__bottom", "__sp")
    clefs = on_staff.where((F.col("font") == MUSIC_FONT) & F.col("ch").isin(*CLEFS)).groupBy(*STAFF).agg(F.min_by("ch", F.struct("x", "ord")).alias("clef"))
    printed = pages.staff_names(words.join(systems, PAGE), staves, SYSTEM)
    names = pages.inherit_names(printed.join(clefs, STAFF, "left"), SCORE, ["page", "system"])
    return {"staves": settle(staves.join(names, STAFF), "named"), "glyphs": on_staff, "stems": stems, "words": settle(inside, "words"), "bars": settle(bars, "bars"), "systems": systems}


def title_of(words: DataFrame) -> DataFrame:
    """score_id, title: the words of the first page in the largest size (within 0.1), on the line (within 2) of the first of them."""
    first = words.where("page = 0")
    big = first.groupBy("score_id").agg(F.min(F.struct((-F.col("size")).alias("n"), F.col("ord"), F.col("y").alias("y"))).alias("b")).select("score_id", (-F.col("b.n")).alias("__size"), F.col("b.y").alias("__y"))
    same = first.join(big, "score_id").where((F.abs(F.col("size") - F.col("__size")) < 0.1) & (F.abs(F.col("y") - F.col("__y")) < 2))
    read = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda w: w["text"])
    return same.groupBy("score_id").agg(F.array_join(read, " ").alias("title"))


def chords_of(page: dict[str, DataFrame], beams: DataFrame, curves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chords and rests of each staff (STAFF, chord, x, heads, stem_x, up, base, beams, dots, tuplet, is_rest, full_bar, y, tie_start, dur), and warnings."""
    music = page["glyphs"].where(F.col("font") == MUSIC_FONT)
    heads = music.where(F.col("ch").isin(*NOTEHEADS) & (F.col("size") > 13)).withColumn("base", lookup(F.col("ch"), NOTEHEADS))
    claimed = settle(pages.claim_heads(heads.where("ch <> 'w'"), page["stems"], STAFF), "claims")
    taken = heads.join(claimed.withColumnRenamed("head", "ord"), [*STAFF, "ord"])
    one = F.array_sort(F.collect_list(F.struct("ord", "x", "x0", "x1", "y", "ch")))
    stemmed = taken.groupBy(*STAFF, "stem").agg(one.alias("heads"), F.max("base").alias("base"), F.min("x0").alias("x"), F.first("up").alias("up"))
    lines = page["stems"].select(*STAFF, F.col("ord").alias("stem"), F.col("x0").alias("stem_x"), "y0", "y1", "space", "mid")
    full = stemmed.join(lines, [*STAFF, "stem"])
    tips = full.where("base <= 1").select(*STAFF, F.col("stem").alias("ord"), F.col("stem_x").alias("x0"), "y0", "y1", F.when(F.col("up"), F.col("y0")).otherwise(F.col("y1")).alias("tip"), "space")
    counts = pages.beam_counts(tips, beams, music.select(*STAFF, "ch", "x", "y"), PAGE, STAFF).withColumnRenamed("ord", "stem")
    full = settle(full.join(counts, [*STAFF, "stem"], "left").withColumn("beams", F.coalesce("beams", F.lit(0))), "stemmed")
    loose = heads.join(claimed.select(*STAFF, F.col("head").alias("ord")), [*STAFF, "ord"], "left_anti")
    warnings = loose.where("ch <> 'w'").join(page["staves"].select(*STAFF, "name"), STAFF).select("score_id", F.format_string("page %d staff %s: notehead without stem at x=%.0f", F.col("page") + 1, "name", "x").alias("text"))
    unknown = pages.unknown_symbols(music, PAGE).select("score_id", F.format_string("page %d: unknown music glyph '%s' x%d", F.col("page") + 1, "ch", "n").alias("text"))
    whole = _whole_notes(loose.where("ch = 'w'"), full, one)
    rests = pages.rest_rows(page["glyphs"])
    none = lambda kind: F.lit(None).cast(kind)
    lone = F.array(F.struct("ord", "x", "x0", "x1", "y", "ch"))
    parts = [
        full.select(*STAFF, F.lit(0).alias("k"), F.col("stem").alias("o"), "x", "heads", "stem_x", "up", "base", "beams", F.lit(False).alias("is_rest"), F.lit(False).alias("full_bar"), F.lit(0.0).alias("y"), "space", "mid"),
        whole.select(*STAFF, F.lit(1).alias("k"), F.col("cluster").cast("long").alias("o"), "x", "heads", none("double").alias("stem_x"), "up", F.lit(4.0).alias("base"), F.lit(0).alias("beams"), F.lit(False).alias("is_rest"), F.lit(False).alias("full_bar"), F.lit(0.0).alias("y"), "space", "mid"),
        rests.select(*STAFF, F.lit(2).alias("k"), F.col("ord").alias("o"), F.col("x0").alias("x"), lone.alias("heads"), none("double").alias("stem_x"), (F.col("y") < F.col("mid")).alias("up"), "base", F.lit(0).alias("beams"), F.lit(True).alias("is_rest"), "full_bar", "y", "space", "mid"),
    ]
    every = settle(reduce(DataFrame.unionByName, parts).withColumn("chord", F.row_number().over(W.partitionBy(*STAFF).orderBy("x", "k", "o"))).drop("k", "o"), "chords")
    thick = page["bars"].where("thick").select(*SYSTEM, F.col("x").alias("__bar"))
    dots = page["glyphs"].where((F.col("font") == SPECIAL_FONT) & (F.col("ch") == DOT))
    close = dots.join(thick, SYSTEM).where(F.abs(F.col("x") - F.col("__bar")) < 7).select(*STAFF, "ord").distinct()
    dotted = pages.dot_counts(every.where("not full_bar"), dots.join(close, [*STAFF, "ord"], "left_anti"), STAFF)
    ties = pages.tied_chords(every, curves, PAGE, STAFF).withColumn("tie_start", F.lit(True))
    tuplets = tuplet_factors(every, page["words"], beams, page["staves"])
    known = every.join(dotted, [*STAFF, "chord"], "left").join(ties, [*STAFF, "chord"], "left").join(tuplets, [*STAFF, "chord"], "left")
    filled = known.withColumns({"dots": F.coalesce("dots", F.lit(0)), "tie_start": F.coalesce("tie_start", F.lit(False)), "tuplet": F.coalesce("tuplet", F.lit(1.0))})
    return settle(filled.withColumn("dur", chord_duration(F.col("base"), F.col("beams"), F.col("dots"), F.col("tuplet"))), "timed-chords"), warnings.unionByName(unknown)


def _whole_notes(heads: DataFrame, stemmed: DataFrame, one: Column) -> DataFrame:
    """Clusters of stemless whole notes with their direction: next to a stemmed chord they are the other voice, above it unless they sit lower; alone by the middle of the staff."""
    groups = heads.join(pages.whole_note_groups(heads.select(*STAFF, "ord", "x0", "space"), STAFF).drop("x0"), [*STAFF, "ord"])
    clusters = groups.groupBy(*STAFF, "cluster").agg(one.alias("heads"), F.min("x0").alias("x"), F.min("y").alias("__top"), F.first("space").alias("space"), F.first("mid").alias("mid"))
    ys = lambda f: f(F.transform("heads", lambda h: h["y"]))
    s = stemmed.select(*STAFF, F.col("stem").alias("__stem"), F.col("x").alias("__x"), F.col("up").alias("__up"), ys(F.array_min).alias("__lo"), ys(F.array_max).alias("__hi"))
    beside = clusters.select(*STAFF, "cluster", "x", "space").join(s, STAFF).where(F.abs(F.col("__x") - F.col("x")) < 2.2 * F.col("space"))
    near = beside.groupBy(*STAFF, "cluster").agg(F.min_by(F.struct("__up", "__lo", "__hi"), "__stem").alias("__n"))
    both = clusters.join(near, [*STAFF, "cluster"], "left")
    up = F.when(F.col("__n").isNull(), F.col("__top") < F.col("mid")).when(F.col("__n.__up"), F.col("__top") < F.col("__n.__lo") - 0.5).otherwise(F.col("__top") < F.col("__n.__hi") + 0.5)
    return both.withColumn("up", up)


def tuplet_factors(chords: DataFrame, words: DataFrame, beams: DataFrame, staves: DataFrame) -> DataFrame:
    """STAFF, chord, tuplet: italic digits near a staff, at most six spaces from a chord, over the chords of the first beam that passes them within three spaces; without such a beam over as many nearest chords as the digit says. Of several
    digits the last one counts."""
    digits = words.where(F.col("font").contains("Italic") & F.col("text").isin(*TUPLETS)).select(*SYSTEM, F.col("ord").alias("w"), "text", ((F.col("x0") + F.col("x1")) / 2).alias("wx"), F.col("x0").alias("wx0"), F.col("y").alias("wy"))
    near = digits.join(staves.select(*STAFF, "top", "bottom", F.col("space").alias("sp"), F.col("x0").alias("sx0")), SYSTEM)
    near = near.where((F.col("wy") > F.col("top") - 5 * F.col("sp")) & (F.col("wy") < F.col("bottom") + 5 * F.col("sp")) & (F.col("wx0") >= F.col("sx0") + 25)).select(*STAFF, "w", "text", "wx", "wy", "sp")
    places = chords.select(*STAFF, "chord", F.col("x").alias("cx"), "stem_x")
    near = settle(near, "digits")
    ranked = joins.k_nearest(near, places.select(*STAFF, "cx", "chord"), STAFF, "wx", "cx", "chord", max(map(int, TUPLETS)))
    ranked = settle(ranked, "near-digits")
    asked = near.join(ranked.where((F.col("rank") == 1) & (F.col("distance") <= 6 * F.col("sp"))).select(*STAFF, "w"), [*STAFF, "w"])
    b = beams.select(*PAGE, F.col("ord").alias("__b"), "pts", F.col("x0").alias("__x0"), F.col("x1").alias("__x1"))
    passes = asked.join(b, PAGE).where(F.col("wx").between(F.col("__x0") - 2, F.col("__x1") + 2)).withColumn("__r", beam_y_range(F.col("pts"), F.col("wx")))
    over = passes.where(F.abs((F.col("__r.lo") + F.col("__r.hi")) / 2 - F.col("wy")) < 3 * F.col("sp")).groupBy(*STAFF, "w", "text").agg(F.min_by(F.struct("__x0", "__x1"), "__b").alias("__g"))
    beamed = over.join(places, STAFF).where(F.col("stem_x").between(F.col("__g.__x0") - 1, F.col("__g.__x1") + 1)).select(*STAFF, "w", "text", "chord")
    rest = ranked.join(asked.select(*STAFF, "w"), [*STAFF, "w"], "left_semi").join(beamed.select(*STAFF, "w").distinct(), [*STAFF, "w"], "left_anti").where(F.col("rank") <= F.col("text").cast("int")).select(*STAFF, "w", "text", "chord")
    return beamed.unionByName(rest).groupBy(*STAFF, "chord").agg(F.max_by(lookup(F.col("text"), TUPLETS), "w").alias("tuplet"))


def pitches(chords: DataFrame, page: dict[str, DataFrame], bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STAFF, chord, midis (of its heads from below); and the key signatures of each staff (STAFF, x, alterations). The clef in force at a head gives its step; its alteration is that of an accidental before it, else of the last one in the bar at the same
    step, else of the key."""
    music = page["glyphs"].where(F.col("font") == MUSIC_FONT)
    clefs = pages.clef_events(page["glyphs"], STAFF)
    marks = clefs.withColumn("x", F.col("x") - 1)
    step = F.bround((F.col("bottom") - F.col("y")) / (F.col("space") / 2)).cast("int")
    clef_at = lambda df: joins.asof(df, marks, STAFF, "x", ["ord"], ["bottom_step"]).withColumn("dia", F.coalesce("bottom_step", F.lit(30)) + step)
    signs = clef_at(pages.key_accidentals(music, STAFF)).select(*STAFF, "x", "ord", F.pmod("dia", F.lit(7)).alias("letter"), lookup(F.col("ch"), ACCIDENTALS).alias("alteration"), "space")
    keys = settle(pages.key_signatures(signs, STAFF), "keys")
    flat = chords.where("not is_rest").select(*STAFF, "chord", F.col("x").alias("cx"), "space", F.inline("heads"))
    geometry = page["staves"].select(*STAFF, "bottom")
    read = settle(clef_at(flat.join(geometry, STAFF)).withColumns({"letter": F.pmod("dia", F.lit(7)), "octave": F.floor(F.col("dia") / 7).cast("int")}), "heads")
    accidentals = music.where(F.col("ch").isin(*ACCIDENTALS)).select(*STAFF, F.col("x").alias("__ax"), F.col("x1").alias("__x1"), F.col("y").alias("__ay"), lookup(F.col("ch"), ACCIDENTALS).alias("__alt"))
    gap = F.col("x0") - F.col("__x1") + 1
    own = read.join(accidentals, STAFF).where((gap > 0) & (gap < 3.2 * F.col("space")) & (F.abs(F.col("y") - F.col("__ay")) < 0.3 * F.col("space"))).groupBy(*STAFF, "chord", "ord").agg(F.max_by("__alt", "__ax").alias("own"))
    starts = bars.where("bar > 0").select(*SYSTEM, F.col("x0").alias("cx"), F.col("bar").alias("__bar"))
    placed = joins.asof(read.join(own, [*STAFF, "chord", "ord"], "left"), starts, SYSTEM, "cx", ["__bar"], ["__bar"], strict=True).withColumn("__bar", F.coalesce("__bar", F.lit(0)))
    signed = joins.asof(placed, keys.withColumnRenamed("x", "cx"), STAFF, "cx", ["cx"], ["alterations"], strict=True)
    in_key = F.coalesce(F.try_element_at("alterations", F.col("letter")), F.lit(0))
    held = ordered.persist_in_bar(signed.withColumn("__up", -F.col("y")), [*STAFF, "__bar", "octave", "letter"], ["chord", "__up", "ord"], F.col("own"), in_key, "alter")
    semitone = F.element_at(F.array(*[F.lit(s) for s in STEP_SEMITONES]), F.col("letter") + 1)
    midi = 12 * (F.col("octave") + 1) + semitone + F.col("alter")
    found = held.withColumn("midi", midi.cast("int")).groupBy(*STAFF, "chord").agg(F.transform(F.array_sort(F.collect_list(F.struct("__up", "ord", "midi"))), lambda s: s["midi"]).alias("midis"))
    return found, keys


def number_bars(page: dict[str, DataFrame]) -> DataFrame:
    """Bars of each system: SYSTEM, bar (from 0), idx (from 0 over the score), x0, x1, opens (whether the barline before starts a repeat), closes."""
    w = W.partitionBy(*SYSTEM).orderBy("x")
    left = page["staves"].where("staff = 0").select(*SYSTEM, F.col("x0").alias("__left"))
    rows = page["bars"].join(left, SYSTEM).withColumns({"bar": F.row_number().over(w) - 1, "x0": F.coalesce(F.lag("x").over(w), F.col("__left")), "x1": F.col("x")})
    along = W.partitionBy("score_id").orderBy("page", "system", "x")
    opens = F.coalesce(F.lag("repeat_start").over(along), F.lit(False)) | ((F.col("bar") == 0) & F.col("leading_repeat"))
    return settle(rows.withColumns({"idx": F.row_number().over(along) - 1, "opens": opens, "closes": F.col("repeat_end")}).select(*SYSTEM, "bar", "idx", "x0", "x1", "opens", "closes"), "numbered")


def split_voices(chords: DataFrame) -> DataFrame:
    """Chords of staff and bar (STAFF, idx) with ``voice`` 0 or 1. A staff has two voices in a bar where an upward and a downward chord stand within 1.6 spaces (2.2 if one has no stem), or where both directions and rests off the middle occur and all durations
    together exceed 1.9 times those of the longer direction; then directions and the heights of rests tell them apart."""
    keys = [*STAFF, "idx"]
    notes = chords.where("not is_rest")
    side = lambda up, name: notes.where("up" if up else "not up").select(*keys, F.col("x").alias(f"x_{name}"), F.col("stem_x").isNull().alias(f"bare_{name}"), "space")
    reach = F.col("space") * F.when(F.col("bare_a") | F.col("bare_b"), 2.2).otherwise(1.6)
    against = side(True, "a").join(side(False, "b").drop("space"), keys).where(F.abs(F.col("x_a") - F.col("x_b")) < reach).select(*keys).distinct().withColumn("__near", F.lit(True))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("dur"))), F.lit(0.0))
    up, note = F.col("up"), ~F.col("is_rest")
    off = F.col("is_rest") & (F.abs(F.col("y") - F.col("mid")) > 1.2 * F.col("space"))
    sums = chords.groupBy(*keys).agg(total(~F.col("full_bar")).alias("__all"), total(note & up).alias("__up"), total(note & ~up).alias("__down"), F.max(note & up).alias("__u"), F.max(note & ~up).alias("__d"), F.max(off).alias("__off"))
    long = F.col("__u") & F.col("__d") & F.col("__off") & (F.col("__all") > 1.9 * F.greatest("__up", "__down"))
    flags = sums.join(against, keys, "left").select(*keys, (F.coalesce("__near", F.lit(False)) | long).alias("__two"))
    lower = F.when(F.col("is_rest"), F.col("y") > F.col("mid")).otherwise(~F.col("up"))
    return chords.join(flags, keys).withColumn("voice", F.when(F.col("__two") & lower, 1).otherwise(0)).drop("__two")


def measures_of(bars: DataFrame, voiced: DataFrame, page: dict[str, DataFrame], keys: DataFrame, glyphs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """measures (score_id, idx, number, start, length, num, den, repeat_start, repeat_end, repeat_times, fifths, text), tempos, warnings."""
    first = page["staves"].where("staff = 0").select(*STAFF)
    signs = pages.time_signatures(page["glyphs"].join(first, STAFF, "left_semi"), STAFF).drop("staff")
    met = bars.join(signs.select(*SYSTEM, F.col("x").alias("__x"), "num", "den"), SYSTEM).where((F.col("__x") < F.col("x1") - 2) & ((F.col("bar") == 0) | (F.col("__x") > F.col("x0") - 2)))
    latest = met.groupBy("score_id", "idx").agg(F.max_by(F.struct("num", "den"), F.struct("__x", "num", "den")).alias("__sig"))
    key = keys.join(first, STAFF, "left_semi").select(*SYSTEM, F.col("x").alias("__x"), pages.fifths(F.col("alterations")).alias("__f"))
    keyed = bars.join(key, SYSTEM).where(F.col("__x") < F.col("x1") - 2).groupBy("score_id", "idx").agg(F.max_by("__f", "__x").alias("__fifths"))
    rows = bars.join(latest, ["score_id", "idx"], "left").join(keyed, ["score_id", "idx"], "left")
    rows = ordered.forward_fill(ordered.forward_fill(rows, SCORE, ["idx"], F.col("__sig"), "__ts"), SCORE, ["idx"], F.col("__fifths"), "__key")
    rows = rows.withColumns({"num": F.coalesce("__ts.num", F.lit(4)), "den": F.coalesce("__ts.den", F.lit(4)), "fifths": F.coalesce("__key", F.lit(0))}).withColumn("full", F.col("num") * 4.0 / F.col("den"))
    sums = voiced.withColumn("__order", F.struct("staff", "voice")).groupBy("score_id", "idx", "__order").agg(F.sum("dur").alias("dur"), F.max("full_bar").alias("__rest")).where("not __rest")
    rows, sums = settle(rows, "signed"), settle(sums, "sums")
    lengths = structure.bar_lengths(sums.join(rows.select("score_id", "idx", "full"), ["score_id", "idx"]).withColumn("dur", F.bround("dur", 6)), SCORE, "idx", "__order", "dur", F.bround("full", 6))
    rows = rows.join(lengths, ["score_id", "idx"], "left").withColumn("length", F.coalesce("length", F.col("full")))
    rows = ordered.prefix_sum(rows, SCORE, ["idx"], F.col("length"), "start").withColumn("start", F.col("start").cast("double"))
    longest = sums.groupBy("score_id", "idx").agg(F.max("dur").alias("__most")).join(rows.select("score_id", "idx", "full"), ["score_id", "idx"]).where(F.col("__most") > F.col("full") + 1e-6)
    warnings = longest.select("score_id", F.format_string("measure %d: notes add up to %s quarters, time signature says %s", F.col("idx") + 1, F.col("__most").cast("string"), F.col("full").cast("string")).alias("text"))
    texts = page["words"].where(F.col("text").rlike("^[0-9]+x$")).select(*SYSTEM, F.col("ord").alias("__o"), F.col("x0").alias("__wx"), F.regexp_extract("text", "^([0-9]+)x$", 1).cast("int").alias("__times"))
    counts = bars.join(texts, SYSTEM).where((F.col("__wx") > F.col("x0") - 5) & (F.col("__wx") < F.col("x1"))).groupBy("score_id", "idx").agg(F.max_by("__times", "__o").alias("written"))
    rows = rows.join(counts, ["score_id", "idx"], "left").withColumn("number", F.col("idx") + 1)
    rows = ordered.repeat_times(rows, SCORE, ["idx"], "opens", "closes", "written")
    rows = ordered.pickup_numbers(rows, SCORE, ["idx"], "number", (F.col("length") < F.col("full") - 1e-6) & (F.count("*").over(W.partitionBy(*SCORE)) > 1))
    rows = settle(rows, "rows")
    measures = rows.select("score_id", "idx", "number", "start", "length", "num", "den", F.col("opens").alias("repeat_start"), F.col("closes").alias("repeat_end"), F.col("times").alias("repeat_times"), "fifths", F.when(F.col("written").isNotNull(), F.format_string("sing %dx", "written")).otherwise("").alias("text"))
    marks = pages.tempo_marks(glyphs.join(page["systems"], PAGE), words.join(page["systems"], PAGE), page["staves"], SYSTEM)
    at = rows.select(*SYSTEM, "idx", "start", "x0", "x1").join(marks.select(*SYSTEM, "ord", F.col("x").alias("__x"), "qpm"), SYSTEM).where((F.col("__x") > F.col("x0") - 30) & (F.col("__x") < F.col("x1") - 5))
    tempos = at.groupBy("score_id", "start").agg(F.min_by("qpm", F.struct("page", "system", "ord")).alias("qpm"))
    opening = tempos.groupBy("score_id").agg(F.min(F.struct("start", "qpm")).alias("b"))
    added = measures.select("score_id").distinct().join(opening, "score_id", "left").where(F.col("b").isNull() | (F.col("b.start") > 0)).select("score_id", F.lit(0.0).alias("start"), F.coalesce("b.qpm", F.lit(90.0)).alias("qpm"))
    no_mark = measures.select("score_id").distinct().join(tempos.select("score_id").distinct(), "score_id", "left_anti").select("score_id", F.lit("no tempo marking found, using 90 bpm").alias("text"))
    return measures, tempos.unionByName(added), warnings.unionByName(no_mark)


def timed_chords(voiced: DataFrame, measures: DataFrame) -> DataFrame:
    """Chords with their start and dur in quarters. A voice starts with its bar and each chord follows the one before; in a voice that does not fill the bar a chord takes the time of the nearest chord, less than 3 away, of a voice that does, if that is not before it
    (the system is aligned). A cursor that depends on all chords before: a ``fold``."""
    keys = [*STAFF, "idx", "voice"]
    bar = measures.select("score_id", "idx", F.col("start").alias("__start"), F.col("length").alias("__length"))
    rows = voiced.join(bar, ["score_id", "idx"])
    whole = rows.groupBy(*keys).agg(F.sum("dur").alias("__sum"), F.max("full_bar").alias("__rest"), F.max("__length").alias("__length"))
    filled = whole.where((~F.col("__rest")) & (F.abs(F.col("__sum") - F.col("__length")) < 1e-6)).select(*keys)
    at = F.col("__start") + F.coalesce(F.sum("dur").over(W.partitionBy(*keys).orderBy("x", "chord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    grid = rows.join(filled, keys, "left_semi").select(*SYSTEM, "idx", "staff", "voice", "chord", "x", at.alias("__t")).withColumn("__o", F.struct("staff", "voice", "chord"))
    partial = whole.where((~F.col("__rest")) & (F.col("__sum") < F.col("__length") - 1e-6)).select(*keys).withColumn("__partial", F.lit(True))
    lacking = rows.join(partial, keys, "left_semi").select(*keys, "chord", "x")
    near = joins.k_nearest(lacking, grid.select(*SYSTEM, "idx", F.col("x").alias("__gx"), "__o", "__t"), [*SYSTEM, "idx"], "x", "__gx", "__o", 1).where("distance < 3").select(*keys, "chord", "__t")
    every = rows.join(near, [*keys, "chord"], "left").withColumn("__d", F.when(F.col("full_bar"), F.col("__length")).otherwise(F.col("dur")))

    def make():
        t = None

        def step(row):
            nonlocal t
            if row is None:
                return []
            chord, start, aligned, d = row
            t = start if t is None else t
            if aligned is not None and aligned >= t - 1e-6:
                t = aligned
            at, t = t, t + d
            return [(chord, at, d)]

        return step

    every = settle(every, "aligned")
    placed = ordered.fold(every, keys, ["x", "chord"], ["chord", "__start", "__t", "__d"], "chord int, start double, sung double", make)
    return voiced.join(placed, [*keys, "chord"]).withColumn("dur", F.col("sung")).drop("sung")


def lyrics_of(page: dict[str, DataFrame], chords: DataFrame) -> DataFrame:
    """STAFF, chord, lyrics (map verse -> struct(text, hyphen_after)): words of the size that most words below staves have, each on the staff above it or, if that is shared or has two voices there, the one below, whichever fits better, on the chord nearest along the
    staff; verses are lines of text; several words on a chord are joined."""
    staves = page["staves"]
    plain = page["words"].where(~(F.col("font").contains("Opus") | F.col("font").contains("Italic") | F.col("font").contains("Bold")))
    space = staves.where("staff = 0").select(*SYSTEM, F.col("space").alias("sp"), F.col("x0").alias("sx0"))
    texts = plain.join(space, SYSTEM)
    b = staves.select(*SYSTEM, F.col("bottom").alias("__b"), F.col("x0").alias("__x"))
    below = texts.join(b, SYSTEM).where((F.col("y") > F.col("__b") + F.col("sp")) & (F.col("y") < F.col("__b") + 7 * F.col("sp")) & (F.col("x0") > F.col("__x"))).select(*SYSTEM, "ord", "size")
    counted = below.withColumn("__m", F.bround("size", 1))
    from ..operators.aggregates import mode_first_seen

    mode = mode_first_seen(counted, SYSTEM, "__m", "ord").drop("n")
    sized = texts.join(mode, SYSTEM).where((F.abs(F.col("size") - F.col("__m")) < 0.15) & (F.col("x0") > F.col("sx0") - 5))
    kept = settle(structure.first_printed(sized, SYSTEM, ["ord"]), "printed")
    is_hyphen = F.col("text").isin("-", "–")
    words = settle(pages.hyphenated(kept.where(~is_hyphen), kept.where(is_hyphen).select(*SYSTEM, "x0", "y"), SYSTEM), "hyphenated")
    hosts = staves.select(*STAFF, "top", "bottom", "name")
    over = words.join(hosts, SYSTEM).where(F.col("bottom") < F.col("y"))
    under = words.join(hosts, SYSTEM).where(F.col("top") > F.col("y"))
    pick = lambda df, by: df.groupBy(*SYSTEM, "ord").agg(by(F.struct("staff", "bottom", "top", "name"), "staff").alias("h"))
    sides = [words.join(pick(over, F.max_by), [*SYSTEM, "ord"]).withColumn("above", F.lit(False)), words.join(pick(under, F.min_by), [*SYSTEM, "ord"]).withColumn("above", F.lit(True))]
    cand = sides[0].unionByName(sides[1]).withColumns({"staff": F.col("h.staff"), "name": F.col("h.name"), "gap": F.when(F.col("above"), F.col("h.top") - F.col("y")).otherwise(F.col("y") - F.col("h.bottom"))}).drop("h")
    centre = F.aggregate("heads", F.lit(0.0), lambda a, h: a + (h["x0"] + h["x1"]) / 2) / F.size("heads")
    left = F.array_min(F.transform("heads", lambda h: h["x0"]))
    notes = chords.where("not is_rest").select(*STAFF, "chord", F.col("x").alias("cx"), "up", "base", "stem_x", "idx", centre.alias("centre"), left.alias("left"))
    fits = cand.join(notes, STAFF).withColumn("dx", F.abs(F.col("centre") - lyric_anchor(F.col("x0"), F.col("x1"), F.col("centre"), F.col("left"))))
    nearest = fits.groupBy(*STAFF, "ord", "above", "text", "x0", "y", "sp", "gap", "name", "hyphen").agg(F.min(F.struct("dx", "cx", "chord", "up", "idx")).alias("n")).select("*", "n.*").drop("n")
    nearest = settle(nearest, "nearest")
    other = notes.where("not up").select(*STAFF, F.col("chord").alias("__c"), F.col("cx").alias("__ox"), (F.col("stem_x").isNull() & (F.col("base") == 4)).alias("__whole"), F.col("idx").alias("__idx"))
    near_other = (F.abs(F.col("__ox") - F.col("cx")) < 1.6 * F.col("sp")) | (F.col("__whole") & (F.col("__idx") == F.col("idx")))
    two = nearest.where("above and up").join(other, STAFF).where((F.col("__c") != F.col("chord")) & near_other).select(*STAFF, "ord").distinct().withColumn("__two", F.lit(True))
    allowed = nearest.join(two, [*STAFF, "ord"], "left").where(~F.col("above") | F.col("name").contains("/") | F.coalesce("__two", F.lit(False)))
    scored = allowed.withColumn("score", pages.lyric_score(F.col("dx"), F.col("gap"), F.col("sp"), F.col("above"))).where(F.col("dx") < 6 * F.col("sp"))
    best = structure.best_scoring([scored.drop("__two")], [*SYSTEM, "ord"], "score", "above")
    versed = settle(pages.verse_rows(settle(best, "best"), [*STAFF, "above"], F.col("sp")), "verses")
    ups = notes.where("up").select(*STAFF, F.col("chord").alias("__u"), F.col("cx").alias("__ux"))
    upper = versed.where("above").join(ups, STAFF).where(F.abs(F.col("__ux") - F.col("cx")) < 1.6 * F.col("sp")).groupBy(*STAFF, "ord").agg(F.min_by("__u", F.struct("__ux", "__u")).alias("__u"))
    aimed = versed.join(upper, [*STAFF, "ord"], "left").withColumn("chord", F.coalesce("__u", F.col("chord")))
    cut = F.col("text").endswith("-")
    shown = aimed.withColumns({"text": F.when(cut, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")), "hyphen": F.col("hyphen") | cut})
    one = F.array_sort(F.collect_list(F.struct("ord", "text", "hyphen")))
    joined = shown.groupBy(*STAFF, "chord", "above", "verse").agg(one.alias("ws"))
    entry = F.struct(F.col("verse").alias("key"), F.struct(F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), F.element_at("ws", -1)["hyphen"].alias("hyphen_after")).alias("value"))
    maps = joined.withColumn("e", entry).groupBy(*STAFF, "chord").agg(F.collect_list(F.when(~F.col("above"), F.col("e"))).alias("b"), F.collect_list(F.when(F.col("above"), F.col("e"))).alias("a"))
    return maps.select(*STAFF, "chord", F.map_from_entries(F.when(F.size("b") > 0, F.col("b")).otherwise(F.col("a"))).alias("lyrics"))


def part_names(staves: DataFrame) -> DataFrame:
    """score_id, printed (the name at a staff), part, display_name, ord. A full name of the first systems goes by the abbreviation that later ones have; parts come in the order of the systems, one that is new before the next known part below it, else after the one
    above. Some dozens of names a score: a ``fold`` over the systems."""
    names = staves.select("score_id", "page", "system", "staff", "name")
    seen = names.groupBy("score_id", "name").agg(F.min(F.struct("page", "system", "staff")).alias("o"))
    from ..functions.text import abbreviates

    full, short = seen.where(~F.col("name").contains(".")).select("score_id", F.col("name").alias("f"), "o"), seen.where(F.col("name").contains(".")).select("score_id", F.col("name").alias("a"), F.col("o").alias("ao"))
    canon = full.join(short, "score_id").where(abbreviates(F.col("a"), F.col("f"))).groupBy("score_id", "f").agg(F.max_by("a", "ao").alias("a"), F.first("o").alias("o"))
    mapped = names.join(canon.select("score_id", F.col("f").alias("name"), "a"), ["score_id", "name"], "left").withColumn("part", F.coalesce("a", "name"))

    def make():
        order, held, now = [], [], None

        def close():
            for i, name in enumerate(held):
                if name in order:
                    continue
                below = [x for x in held[i + 1 :] if x in order]
                above = [x for x in held[:i] if x in order]
                order.insert(order.index(below[0]) if below else order.index(above[-1]) + 1 if above else len(order), name)
            held.clear()

        def step(row):
            nonlocal now
            if row is None:
                close()
                return [(name, i) for i, name in enumerate(order)]
            if row[:2] != now:
                close()
                now = row[:2]
            held.append(row[2])
            return []

        return step

    order = ordered.fold(mapped, SCORE, ["page", "system", "staff"], ["page", "system", "part"], "part string, ord int", make)
    shown = canon.groupBy("score_id", F.col("a").alias("part")).agg(F.max_by("f", "o").alias("display_name"))
    printed = mapped.select("score_id", F.col("name").alias("printed"), "part").distinct()
    return settle(printed.join(order, ["score_id", "part"]).join(shown, ["score_id", "part"], "left").select("score_id", "printed", "part", F.coalesce("display_name", "part").alias("display_name"), "ord"), "names")


def shared_staves(chords: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A staff that two parts share (``B./Bar.``) as two: the higher kind of voice takes the upper voice's top notes, the other the lower voice's lowest, and each sings the other voice where its own is silent; where one has no words it takes those of the other at that
    time. chords: score_id, part, voice, start, dur, midis, lyrics and more. Returns chords and parts (part, display_name, ord with ``half``)."""
    halves = F.split("part", "/")
    full = F.split("display_name", "/")
    two = parts.select("score_id", "part", "display_name", "ord").distinct().withColumns({"__a": halves, "__f": F.when(F.size(full) == 2, full).otherwise(halves)})
    split = two.where(F.size("__a") == 2)
    first_up = voice_rank(F.get("__f", F.lit(0))) >= voice_rank(F.get("__f", F.lit(1)))
    sides = []
    for upper in (True, False):
        at = F.when(first_up, F.lit(0 if upper else 1)).otherwise(F.lit(1 if upper else 0))
        sides.append(split.select("score_id", F.col("part").alias("__shared"), F.trim(F.get("__a", at)).alias("part"), F.trim(F.get("__f", at)).alias("display_name"), "ord", F.lit(not upper).cast("int").alias("half")))
    rows = []
    for upper, side in zip((True, False), sides, strict=True):
        mine = chords.withColumnRenamed("part", "__shared").join(side, ["score_id", "__shared"])
        own, other = (mine.where(f"voice = {v}").withColumn("end", F.col("start") + F.col("dur")) for v in ((0, 1) if upper else (1, 0)))
        sung = structure.with_fill(own, other.where(F.size("midis") > 0), ["score_id", "part"], "start", "end", 1e-6).where(F.size("midis") > 0)
        pick = F.array_max if upper else F.array_min
        rows.append(sung.withColumn("midis", F.array(pick("midis"))).drop("end", "filled", "__shared", "display_name", "ord", "half").withColumns({"voice": F.lit(0), "__of": F.concat_ws("/", F.lit("x"))}).drop("__of"))
    names = sides[0].unionByName(sides[1])
    names = settle(names, "halves")
    link = lambda df, there: df.join(names.select("score_id", "part", F.col("__shared"), "half"), ["score_id", "part"]).drop("half") if there else df
    up, low = (settle(link(r, True), "shared") for r in rows)
    low = settle(structure.copy_words(low, up, ["score_id", "__shared"], "start", "lyrics"), "lower")
    up = structure.copy_words(up, low, ["score_id", "__shared"], "start", "lyrics")
    alone = chords.join(split.select("score_id", "part"), ["score_id", "part"], "left_anti")
    kept = two.join(split.select("score_id", "part"), ["score_id", "part"], "left_anti").select("score_id", "part", "display_name", "ord", F.lit(0).alias("half"))
    return alone.unionByName(up.drop("__shared")).unionByName(low.drop("__shared")), kept.unionByName(names.drop("__shared"))


def build_notes(chords: DataFrame) -> DataFrame:
    """notes (score_id, ord, part, voice from 1, start, dur, midi, lyrics, measure, tie_start, x_notehead): the top pitch of every chord sings in its voice's first line, lower ones in further lines; tied notes are one; the main line takes the words of the others at a
    time, lines without words those of the main line."""
    lines = chords.where(F.size("midis") > 0).withColumn("midis", F.col("midis")).withColumn("__x", F.exists("heads", lambda h: h["ch"].isin(*X_HEADS)))
    sung = ordered.chord_voices(lines.withColumn("__v", F.col("voice")).drop("voice"), "midis")
    numbered = sung.withColumn("voice", F.dense_rank().over(W.partitionBy("score_id", "part").orderBy("__v", "voice")))
    keys, order = ["score_id", "part", "voice"], ["start", "idx", "chord"]
    none = F.col("lyrics").isNull() | (F.size("lyrics") == 0)
    w = W.partitionBy(*keys).orderBy(*order)
    follows = F.lag("tie_start").over(w) & (F.lag("midi").over(w) == F.col("midi")) & (F.abs(F.lag(F.col("start") + F.col("dur")).over(w) - F.col("start")) < 1e-6) & none
    runs = ordered.islands_where(numbered, keys, order, follows)
    one = F.struct(*order)
    merged = runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.sum("dur").alias("dur"), F.min("midi").alias("midi"), F.min_by("lyrics", one).alias("lyrics"), F.min_by("idx", one).alias("measure"), F.max_by("tie_start", one).alias("tie_start"), F.min_by("__x", one).alias("x_notehead"))
    numbered = merged.withColumn("ord", F.row_number().over(W.partitionBy("score_id", "part").orderBy("voice", "island")).cast("long")).drop("island")
    numbered = settle(numbered, "lines")
    main, others = numbered.where("voice = 1"), numbered.where("voice > 1")
    main = settle(structure.copy_words(main, others, ["score_id", "part"], "start", "lyrics", merge=True), "main")
    return main.unionByName(structure.copy_words(others, main, ["score_id", "part"], "start", "lyrics"))


def read_score(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """scores (score_id, title), parts, notes, measures, tempos, warnings of all scores whose drawn symbols the tables hold. The steps write
    their tables as they go (``settle``), so plans stay short. Scores without staves have no rows."""
    page = page_layout(tables)
    bars = number_bars(page)
    chords, warnings = chords_of(page, tables["beams"], tables["curves"])
    found, keys = pitches(chords, page, bars)
    spans = bars.select(*SYSTEM, (F.col("x0") - 1).alias("x"), (F.col("x1") - 1).alias("__stop"), "idx")
    in_bar = joins.asof(chords, spans, SYSTEM, "x", ["idx"], ["idx", "__stop"], strict=True).where(F.col("x") < F.col("__stop")).drop("__stop")
    in_bar = settle(in_bar, "in-bars")
    voiced = settle(split_voices(in_bar), "voices")
    measures, tempos, more = measures_of(bars, voiced, page, keys, tables["glyphs"], tables["words"])
    measures, tempos = settle(measures, "measures"), settle(tempos, "tempos")
    timed = timed_chords(voiced, measures)
    names = part_names(page["staves"])
    sung = timed.join(found, [*STAFF, "chord"], "left").join(lyrics_of(page, in_bar), [*STAFF, "chord"], "left").join(page["staves"].select(*STAFF, F.col("name").alias("printed")), STAFF).join(names.select("score_id", "printed", "part"), ["score_id", "printed"])
    flat = sung.select("score_id", "part", "voice", "idx", "chord", "start", "dur", F.coalesce("midis", F.array().cast("array<int>")).alias("midis"), "lyrics", "heads", "tie_start")
    split, parts = shared_staves(settle(flat, "flat"), names)
    notes = settle(build_notes(settle(split, "split")), "notes")
    sounding = parts.join(notes.select("score_id", "part").distinct(), ["score_id", "part"], "left_semi")
    place = F.row_number().over(W.partitionBy("score_id").orderBy("ord", "half")) - 1
    scores = page["systems"].select("score_id").distinct().join(title_of(tables["words"]), "score_id", "left").withColumn("title", F.coalesce("title", F.lit("Score")))
    return {"scores": scores, "parts": sounding.select("score_id", "part", "display_name", place.alias("ord")), "notes": notes, "measures": measures, "tempos": tempos, "warnings": warnings.unionByName(more)}


def find_documents(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, length of the PDF files of folders, in the order of the folders and of names in them, with ``ord``; their contents are not read."""
    found = []
    for i, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length", F.lit(i).alias("__folder"))
        found.append(files)
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("ord", F.row_number().over(W.orderBy("__folder", "path"))).drop("__folder")
