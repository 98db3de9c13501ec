"""Symbols of a drawn page to staves, systems, bars and chords. A page, a system or a staff is a small unit: symbols meet within one by equality of
its keys and a band condition, and only folds look at rows in order. Every table has an ordinal ``ord`` that breaks ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import ACCIDENTALS, CLEFS, DOT, FLAGS, MUSIC_FONT, NOTEHEADS, OCTAVE_MARK, OTHER_SYMBOLS, RESTS, SPECIAL_FONT, TEMPO_UNITS, TEXT_FONT
from ..functions.scalars import beam_y_range, lookup
from .aggregates import mode_first_seen
from .ordered import anchored_clusters, chain_count, fold, gap_islands

Cols = Sequence[str]


def near_mode(df: DataFrame, keys: Cols, value: str, order: str, digits: int, within: float, among: Column | None = None) -> DataFrame:
    """Rows whose value lies within ``within`` of the most frequent rounded value of their keys (the first seen if tied), counted over the rows ``among``.
    Keys without such rows have none left."""
    counted = (df if among is None else df.where(among)).select(*keys, F.bround(F.col(value), digits).alias("__mode"), order)
    modes = mode_first_seen(counted, keys, "__mode", order).drop("n")
    return df.join(modes, list(keys)).where(F.abs(F.col(value) - F.col("__mode")) < within).drop("__mode")


def staff_line_candidates(lines: DataFrame, keys: Cols) -> DataFrame:
    """Level lines of more than 60 points, of the width that most of them on the page have."""
    level = lines.where((F.abs(F.col("y0") - F.col("y1")) < 0.05) & (F.col("x1") - F.col("x0") > 60))
    return near_mode(level, keys, "width", "ord", 2, 0.05)


def find_staves(lines: DataFrame, keys: Cols, spread: float = 0.3, least: float = 2.0) -> DataFrame:
    """Keys, x0, x1, lines: five neighbouring lines of the same ends, evenly apart (gaps differ by less than ``spread`` and exceed ``least``). Lines are
    looked at from above; five that fit are used up, else the upper one is passed over."""
    ends = lines.select(*keys, F.bround("x0", 0).alias("x0"), F.bround("x1", 0).alias("x1"), F.bround("y0", 2).alias("y")).distinct()

    def make():
        held: list = []

        def step(row):
            if row is None:
                return []
            held.append(row[0])
            if len(held) < 5:
                return []
            gaps = [b - a for a, b in zip(held, held[1:], strict=False)]
            if max(gaps) - min(gaps) < spread and min(gaps) > least:
                five = held.copy()
                held.clear()
                return [(five,)]
            del held[0]
            return []

        return step

    return fold(ends, [*keys, "x0", "x1"], ["y"], ["y"], "lines array<double>", make)


def with_geometry(staves: DataFrame) -> DataFrame:
    """Staves with top, bottom, space and mid of their five lines."""
    line = lambda k: F.element_at("lines", k)
    return staves.withColumns({"top": line(1), "bottom": line(5), "space": (line(5) - line(1)) / 4, "mid": line(3)})


def number_systems(staves: DataFrame, lines: DataFrame, keys: Cols) -> DataFrame:
    """Staves (with top, bottom, x0) of each page from above, with ``system`` (from 0) and ``staff`` (its place in the system, from 0): a staff joins the one before if
    an upright line near its left edge covers both and their edges meet within 1.5."""
    w = W.partitionBy(*keys).orderBy("top", "x0")
    numbered = staves.withColumns({"__n": F.row_number().over(w), "__top": F.lag("top").over(w), "__x0": F.lag("x0").over(w)})
    upright = lines.where(F.abs(F.col("x0") - F.col("x1")) < 0.05).select(*keys, F.col("x0").alias("__x"), F.col("y0").alias("__a"), F.col("y1").alias("__b"))
    covers = (F.abs(F.col("__x") - F.col("x0")) < 1.5) & (F.col("__a") <= F.col("__top") + 0.5) & (F.col("__b") >= F.col("bottom") - 0.5)
    joined = numbered.where(F.abs(F.col("__x0") - F.col("x0")) < 1.5).join(upright, list(keys)).where(covers).select(*keys, "__n").distinct().withColumn("__joined", F.lit(0))
    flagged = numbered.join(joined, [*keys, "__n"], "left").withColumn("__new", F.coalesce("__joined", F.lit(1)))
    upto = W.partitionBy(*keys).orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    placed = flagged.withColumn("system", (F.sum("__new").over(upto) - 1).cast("int"))
    return placed.withColumn("staff", F.row_number().over(W.partitionBy(*keys, "system").orderBy("__n")) - 1).drop("__n", "__top", "__x0", "__joined", "__new")


def nearest_staff(symbols: DataFrame, staves: DataFrame, keys: Cols, symbol: Cols, reaches: Column, distance: Column) -> DataFrame:
    """Each symbol with the ``staff`` of its keys that it ``reaches`` and that is nearest by ``distance`` (the first if tied), if less than seven spaces away. Both are
    expressions over the symbol's columns and the staff's x0, x1, top, bottom, space as s_x0 and so on."""
    bands = staves.select(*keys, "staff", *[F.col(c).alias(f"s_{c}") for c in ("x0", "x1", "top", "bottom", "space")])
    found = symbols.join(bands, list(keys)).where(reaches).withColumn("__d", distance)
    best = found.groupBy(*keys, *symbol).agg(F.min(F.struct(F.col("__d").alias("d"), F.col("staff").alias("staff"), F.col("s_space").alias("space"))).alias("__b"))
    return best.where(F.col("__b.d") < 7 * F.col("__b.space")).select(*keys, *symbol, F.col("__b.staff").alias("staff"))


def glyph_band() -> tuple[Column, Column]:
    """What ``nearest_staff`` asks of a glyph: x from 30 left of the staff to 5 right of it; no distance within a space of the staff."""
    x, y, top, bottom, space = (F.col(c) for c in ("x", "y", "s_top", "s_bottom", "s_space"))
    inside = (y >= top - space) & (y <= bottom + space)
    return (x >= F.col("s_x0") - 30) & (x <= F.col("s_x1") + 5), F.when(inside, 0.0).otherwise(F.least(F.abs(y - top), F.abs(y - bottom)))


def stem_band() -> tuple[Column, Column]:
    """What ``nearest_staff`` asks of a stem: x within the staff; no distance if it touches it or misses by at most 1."""
    x, top, bottom = F.col("x0"), F.col("s_top"), F.col("s_bottom")
    touches = (F.col("y1") >= top - 1) & (F.col("y0") <= bottom + 1)
    return (x > F.col("s_x0")) & (x < F.col("s_x1")), F.when(touches, 0.0).otherwise(F.least(F.abs(F.col("y1") - top), F.abs(F.col("y0") - bottom)))


def stem_lines(lines: DataFrame) -> DataFrame:
    """Thin upright lines of at least 5 points."""
    return lines.where((F.abs(F.col("x0") - F.col("x1")) <= 0.05) & (F.col("width") <= 0.55) & (F.col("y1") - F.col("y0") >= 5))


def barline_lines(lines: DataFrame, staves: DataFrame, keys: Cols) -> DataFrame:
    """Upright lines of a width from 0.55 on, from 2 right of the first staff's left edge to 1 right of its right one, that span some staff whole."""
    first = staves.where("staff = 0").select(*keys, F.col("x0").alias("__l"), F.col("x1").alias("__r"))
    wide = lines.where((F.abs(F.col("x0") - F.col("x1")) <= 0.05) & (F.col("width") >= 0.55)).join(first, list(keys))
    within = wide.where((F.col("x0") >= F.col("__l") + 2) & (F.col("x0") <= F.col("__r") + 1)).drop("__l", "__r")
    spans = staves.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("top").alias("__top"), F.col("bottom").alias("__bottom"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    return within.join(spans, [*on, (F.col("y0") <= F.col("__top") + 0.5) & (F.col("y1") >= F.col("__bottom") - 0.5)], "left_semi")


def barlines(candidates: DataFrame, dots: DataFrame, staves: DataFrame, first_events: DataFrame, keys: Cols) -> DataFrame:
    """One row for each cluster of barline strokes less than 5 apart, as the end of a bar: keys, x (the rightmost stroke), thick (one wider than 1.5), repeat_start
    (a repeat dot within 6 right of a thick one), repeat_end (within 7 left), leading_repeat.

    Clusters left of the system's first note or rest (``first_events``: keys, x; else the staff's end) end no bar; ``leading_repeat`` says on all
    rows whether one of them starts a repeat. Where the last cluster lies more than 3 before the staff's end, the end is one more."""
    runs = gap_islands(candidates.withColumn("__gap", F.col("x0")), keys, ["x0", "ord"], F.col("x0"), F.col("x0"), 5 - 1e-9)
    clusters = runs.groupBy(*keys, "island").agg(F.max("x0").alias("x"), F.min("x0").alias("__left"), F.max(F.col("width") > 1.5).alias("thick"))
    near = clusters.where("thick").join(dots.select(*keys, F.col("x").alias("__dot")), list(keys))
    right = (F.col("__dot") > F.col("x")) & (F.col("__dot") < F.col("x") + 6)
    left = (F.col("__dot") > F.col("__left") - 7) & (F.col("__dot") < F.col("__left"))
    marks = near.groupBy(*keys, "island").agg(F.max(right).alias("__s"), F.max(left).alias("__e"))
    no = F.lit(False)
    marked = clusters.join(marks, [*keys, "island"], "left").withColumns({"repeat_start": F.coalesce("__s", no), "repeat_end": F.coalesce("__e", no)})
    ends = staves.where("staff = 0").select(*keys, F.col("x1").alias("__end"))
    starts = ends.join(first_events.select(*keys, F.col("x").alias("__first")), list(keys), "left").select(*keys, "__end", F.coalesce("__first", "__end").alias("__first"))
    placed = marked.join(starts, list(keys))
    kept = placed.where(F.col("x") >= F.col("__first")).select(*keys, "x", "thick", "repeat_start", "repeat_end")
    leads = placed.where(F.col("x") < F.col("__first")).groupBy(*keys).agg(F.max("repeat_start").alias("leading_repeat"))
    last = kept.groupBy(*keys).agg(F.max("x").alias("__last"))
    closing = ends.join(last, list(keys), "left").where(F.col("__last").isNull() | (F.col("__last") < F.col("__end") - 3)).select(*keys, F.col("__end").alias("x"), no.alias("thick"), no.alias("repeat_start"), no.alias("repeat_end"))
    return kept.unionByName(closing).join(leads, list(keys), "left").withColumn("leading_repeat", F.coalesce("leading_repeat", no))


def staff_names(words: DataFrame, staves: DataFrame, keys: Cols) -> DataFrame:
    """Keys, staff, name: the words left of each staff near its middle, from left to right, but numbers; empty without any."""
    bands = staves.select(*keys, "staff", "x0", "mid", "space")
    near = words.select(*keys, "ord", F.col("text").alias("__t"), F.col("x0").alias("__x"), F.col("x1").alias("__x1"), F.col("y").alias("__y")).join(bands, list(keys))
    fits = (F.col("__x1") < F.col("x0") - 2) & (F.abs(F.col("__y") - F.col("mid") - 0.8 * F.col("space")) < 2.5 * F.col("space")) & ~F.col("__t").rlike("^[0-9]+$")
    read = near.where(fits).groupBy(*keys, "staff").agg(F.array_sort(F.collect_list(F.struct("__x", "ord", "__t"))).alias("__ws"))
    named = read.select(*keys, "staff", F.trim(F.array_join(F.transform("__ws", lambda w: w["__t"]), " ")).alias("name"))
    return staves.select(*keys, "staff").join(named, [*keys, "staff"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def inherit_names(staves: DataFrame, score: Cols, order: Cols) -> DataFrame:
    """Names for systems without any. ``staves``: score keys, the system's ``order`` columns, staff, name, clef. Such a system takes the names of the last fully named
    one: those staves, in their order, whose clefs agree, the lowest possible ones; otherwise a staff without a name is ``Staff`` and its
    number. A ``fold`` over the staves of a score, a system at a time."""

    def make():
        from itertools import combinations

        known: list = []
        held: list = []

        def close():
            nonlocal known
            names = [name for _, _, name, _ in held]
            if all(names):
                known = [(name, clef) for _, _, name, clef in held]
            elif not any(names) and 0 < len(held) <= len(known):
                fits = [at for at in combinations(range(len(known)), len(held)) if all(known[i][1] == h[3] for i, h in zip(at, held, strict=True))]
                if fits:
                    names = [known[i][0] for i in max(fits, key=sum)]
            out = [(*at, staff, name or f"Staff{i + 1}") for i, ((at, staff, _, _), name) in enumerate(zip(held, names, strict=True))]
            held.clear()
            return out

        def step(row):
            if row is None:
                return close() if held else []
            *at, staff, name, clef = row
            done = close() if held and held[0][0] != at else []
            held.append((at, staff, name, clef))
            return done

        return step

    parts = ", ".join(f"`{c}` {staves.schema[c].dataType.simpleString()}" for c in order)
    return fold(staves, score, [*order, "staff"], [*order, "staff", "name", "clef"], f"{parts}, staff int, name string", make)


def tempo_marks(glyphs: DataFrame, words: DataFrame, staves: DataFrame, keys: Cols) -> DataFrame:
    """Keys, x, y, qpm: a note symbol of the text font above the first staff (within 14 spaces), dotted if a dot follows within 10, and the first word within 30 right of it
    on its line that, with the words right behind it, has a number."""
    first = staves.where("staff = 0").select(*keys, F.col("top").alias("__top"), F.col("space").alias("__sp"))
    text = glyphs.where(F.col("font") == TEXT_FONT)
    notes = text.where(F.col("ch").isin(*TEMPO_UNITS)).join(first, list(keys)).where((F.col("y") > F.col("__top") - 14 * F.col("__sp")) & (F.col("y") < F.col("__top")))
    notes = notes.select(*keys, "ord", "x", "y", lookup(F.col("ch"), TEMPO_UNITS).alias("__unit"))
    dots = text.where("ch = '.'").select(*keys, F.col("x").alias("__dx"), F.col("y").alias("__dy"))
    dotted = notes.join(dots, list(keys)).where((F.col("__dx") > F.col("x")) & (F.col("__dx") - F.col("x") < 10) & (F.abs(F.col("__dy") - F.col("y")) < 3)).select(*keys, "ord").distinct().withColumn("__dot", F.lit(1.5))
    w = words.select(*keys, F.col("ord").alias("__wo"), F.col("text").alias("__t"), F.col("x0").alias("__x0"), F.col("x1").alias("__x1"), F.col("y").alias("__y"))
    o = words.select(*keys, F.col("ord").alias("__oo"), F.col("text").alias("__ot"), F.col("x0").alias("__ox"), F.col("y").alias("__oy"))
    behind = w.join(o, list(keys)).where((F.col("__oo") != F.col("__wo")) & (F.col("__ox") > F.col("__x1")) & (F.col("__ox") - F.col("__x1") < 8) & (F.abs(F.col("__oy") - F.col("__y")) < 2))
    tails = behind.groupBy(*keys, "__wo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__oo", "__ot"))), lambda s: s["__ot"]), " ").alias("__tail"))
    whole = w.join(tails, [*keys, "__wo"], "left").withColumn("__n", F.regexp_extract(F.concat_ws(" ", "__t", "__tail"), "([0-9]+([.,][0-9]+)?)", 1)).where("__n <> ''")
    met = notes.join(whole, list(keys)).where((F.col("__x0") > F.col("x")) & (F.col("__x0") - F.col("x") < 30) & (F.abs(F.col("__y") - F.col("y")) < 3))
    best = met.groupBy(*keys, "ord", "x", "y", "__unit").agg(F.min_by("__n", "__wo").alias("__n")).join(dotted, [*keys, "ord"], "left")
    number = F.replace(F.col("__n"), F.lit(","), F.lit(".")).cast("double")
    return best.select(*keys, "ord", "x", "y", (number * F.col("__unit") * F.coalesce("__dot", F.lit(1.0))).alias("qpm"))


def claim_heads(heads: DataFrame, stems: DataFrame, keys: Cols) -> DataFrame:
    """Keys, stem (its ord), head (ord), up: each stem in its order takes all free heads beside it that lie along it, if the one at its end is on the side that its
    direction asks for; a stem whose heads are not takes none. heads: ord, x0, x1, y, space; stems: ord, x0, y0, y1. Claims depend on earlier ones,
    so a staff's heads are held and its stems folded over them."""
    both = heads.select(*keys, F.lit(0).alias("side"), "ord", "x0", "x1", F.col("y").alias("a"), F.lit(None).cast("double").alias("b"), "space").unionByName(
        stems.select(*keys, F.lit(1).alias("side"), "ord", "x0", F.lit(None).cast("double").alias("x1"), F.col("y0").alias("a"), F.col("y1").alias("b"), F.lit(None).cast("double").alias("space"))
    )

    def make():
        free: dict = {}

        def step(row):
            if row is None:
                return []
            side, ord_, x0, x1, a, b, space = row
            if side == 0:
                free[ord_] = (x0, x1, a, space)
                return []
            beside = {}
            for k, (left, right, y, sp) in free.items():
                sides = right - 0.6 * sp < x0 < right + 0.15 * sp, left - 0.15 * sp < x0 < left + 0.3 * sp
                if any(sides) and a - 0.7 * sp <= y <= b + 0.7 * sp:
                    beside[k] = y, sides
            if not beside:
                return []
            ys = [y for y, _ in beside.values()]
            up = b - max(ys) < min(ys) - a
            if not any(sides[0 if up else 1] for _, sides in beside.values()):
                return []
            for k in beside:
                del free[k]
            return [(ord_, k, up) for k in beside]

        return step

    return fold(both, keys, ["side", "ord"], ["side", "ord", "x0", "x1", "a", "b", "space"], "stem long, head long, up boolean", make)


def beam_counts(stems: DataFrame, beams: DataFrame, flags: DataFrame, keys: Cols, staff: Cols) -> DataFrame:
    """``staff`` keys, ord, beams of every stem (ord, x0, y0, y1, tip, space): beams (of the same ``keys``; pts, x0, x1) that cross it within 0.8, or the greatest flag (of the same staff; ch, x, y) within
    1.5 of it and one and a half spaces of its tip, whichever is more."""
    b = beams.select(*keys, "pts", F.col("x0").alias("__b0"), F.col("x1").alias("__b1"))
    met = stems.join(b, list(keys)).where((F.col("x0") >= F.col("__b0") - 0.8) & (F.col("x0") <= F.col("__b1") + 0.8)).withColumn("__r", beam_y_range(F.col("pts"), F.col("x0")))
    crossed = met.where((F.col("__r.hi") >= F.col("y0") - 0.8) & (F.col("__r.lo") <= F.col("y1") + 0.8)).groupBy(*staff, "ord").agg(F.count("*").alias("__n"))
    f = flags.where(F.col("ch").isin(*FLAGS)).select(*staff, F.col("x").alias("__fx"), F.col("y").alias("__fy"), lookup(F.col("ch"), FLAGS).alias("__f"))
    near = stems.join(f, list(staff)).where((F.abs(F.col("__fx") - F.col("x0")) < 1.5) & (F.abs(F.col("__fy") - F.col("tip")) < 1.5 * F.col("space")))
    flagged = near.groupBy(*staff, "ord").agg(F.max("__f").alias("__m"))
    every = stems.select(*staff, "ord").join(crossed, [*staff, "ord"], "left").join(flagged, [*staff, "ord"], "left")
    return every.select(*staff, "ord", F.greatest(F.coalesce("__n", F.lit(0)), F.coalesce("__m", F.lit(0))).cast("int").alias("beams"))


def whole_note_groups(heads: DataFrame, keys: Cols) -> DataFrame:
    """Stemless whole notes (ord, x0, space), in clusters of less than 1.6 spaces from their first: keys, x0, ord, cluster."""
    scaled = heads.withColumn("__x", F.col("x0") / F.col("space"))
    found = anchored_clusters(scaled, keys, ["__x", "ord"], "__x", 1.6)
    return heads.select(*keys, "ord", "x0").join(found.drop("__x"), [*keys, "ord"])


def rest_rows(glyphs: DataFrame) -> DataFrame:
    """Glyphs (with the staff's top, bottom, space, mid) that are rests: base (quarters, 0 for a bar rest) and full_bar. A bar rest hangs within 0.3 spaces of the staff, others
    within 2.5; the same symbols farther off are not rests."""
    rests = {k: v or 0.0 for k, v in RESTS.items()}
    full = F.col("ch").isin(*[k for k, v in RESTS.items() if v is None])
    margin = F.col("space") * F.when(full, 0.3).otherwise(2.5)
    fits = F.col("ch").isin(*RESTS) & (F.col("font") == MUSIC_FONT) & (F.col("size") > 13) & (F.col("y") >= F.col("top") - margin) & (F.col("y") <= F.col("bottom") + margin)
    return glyphs.where(fits).withColumns({"base": lookup(F.col("ch"), rests), "full_bar": full})


def unknown_symbols(glyphs: DataFrame, keys: Cols) -> DataFrame:
    """Keys, ch, n: how often each symbol of the music font occurs that has no known meaning."""
    known = [*NOTEHEADS, *RESTS, *FLAGS, *ACCIDENTALS, *CLEFS, *OTHER_SYMBOLS]
    return glyphs.where((F.col("font") == MUSIC_FONT) & ~F.col("ch").isin(*known)).groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def dot_counts(chords: DataFrame, dots: DataFrame, keys: Cols) -> DataFrame:
    """Augmentation dots of each chord (chord, heads: array of struct x0, x1, y; is_rest, space): distinct places of dots (x, y) right of its rightmost head, within 2.6 spaces, level
    with a head (within 0.62 spaces, for a rest 1.6), counted as long as each is less than 1.3 spaces from the one before."""
    right = F.array_max(F.transform("heads", lambda h: h["x1"]))
    level = F.exists("heads", lambda h: F.abs(F.col("__dy") - h["y"]) <= F.col("space") * F.when(F.col("is_rest"), 1.6).otherwise(0.62))
    d = dots.select(*keys, F.col("x").alias("__dx"), F.col("y").alias("__dy"))
    met = chords.withColumn("__right", right).join(d, list(keys)).where((F.col("__dx") > F.col("__right") - 0.5) & (F.col("__dx") < F.col("__right") + 2.6 * F.col("space")) & level)
    places = met.select(*keys, "chord", "__right", "space", F.bround("__dx", 1).alias("__x")).distinct()
    before = F.coalesce(F.lag("__x").over(W.partitionBy(*keys, "chord").orderBy("__x")), F.col("__right"))
    counted = chain_count(places, [*keys, "chord"], ["__x"], F.col("__x") - before < 1.3 * F.col("space"))
    return chords.select(*keys, "chord").join(counted, [*keys, "chord"], "left").select(*keys, "chord", F.coalesce("n", F.lit(0)).cast("int").alias("dots"))


def tied_chords(chords: DataFrame, curves: DataFrame, keys: Cols, staff: Cols) -> DataFrame:
    """Keys of chords (chord, heads, space, is_rest) from which a curve of more than a space starts: left end from 1 left of a head to 1.5 spaces right of it, the head within 1.2 spaces of
    the curve's height."""
    c = curves.select(*keys, F.col("x0").alias("__x0"), F.col("x1").alias("__x1"), F.col("y0").alias("__y0"), F.col("y1").alias("__y1"))
    sp = F.col("space")
    starts = F.exists("heads", lambda h: (F.col("__x0") > h["x0"] - 1) & (F.col("__x0") < h["x1"] + 1.5 * sp) & (h["y"] > F.col("__y0") - 1.2 * sp) & (h["y"] < F.col("__y1") + 1.2 * sp))
    return chords.where("not is_rest").join(c, list(keys)).where((F.col("__x1") - F.col("__x0") > sp) & starts).select(*staff, "chord").distinct()


def clef_events(glyphs: DataFrame, keys: Cols) -> DataFrame:
    """Keys, x, ord, bottom: the diatonic number of the lowest line from each clef on (C4 is 28). A C clef counts from the line that it is centred on; a mark below a clef, within 12 of
    it, means an octave lower. glyphs carry the staff's top, bottom and space."""
    sp = F.col("space")
    clefs = glyphs.where((F.col("font") == MUSIC_FONT) & F.col("ch").isin(*CLEFS) & (F.col("y") > F.col("top") - sp) & (F.col("y") < F.col("bottom") + sp))
    fixed = lookup(F.col("ch"), {k: n for k, (sign, n) in CLEFS.items() if sign != "C"})
    line = F.bround((F.col("bottom") - F.col("y")) / sp).cast("int")
    marks = glyphs.where((F.col("font") == SPECIAL_FONT) & (F.col("ch") == OCTAVE_MARK)).select(*keys, F.col("x").alias("__mx"), F.col("y").alias("__my"))
    lower = clefs.join(marks, list(keys)).where((F.abs(F.col("__mx") - F.col("x")) < 12) & (F.col("__my") > F.col("y"))).select(*keys, "ord").distinct().withColumn("__low", F.lit(7))
    both = clefs.join(lower, [*keys, "ord"], "left")
    return both.select(*keys, "x", "ord", (F.coalesce(fixed, 28 - 2 * line) - F.coalesce("__low", F.lit(0))).cast("int").alias("bottom_step"))


def key_accidentals(glyphs: DataFrame, keys: Cols) -> DataFrame:
    """Accidentals that stand before no head (level within 0.3 spaces, at most 3.2 right of them): those of key signatures."""
    accidentals = glyphs.where((F.col("font") == MUSIC_FONT) & F.col("ch").isin(*ACCIDENTALS))
    heads = glyphs.where((F.col("font") == MUSIC_FONT) & F.col("ch").isin(*NOTEHEADS)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x0").alias("__hx"), F.col("y").alias("__hy"))
    gap = F.col("__hx") - F.col("x1") + 1
    before = (gap > 0) & (gap < 3.2 * F.col("space")) & (F.abs(F.col("__hy") - F.col("y")) < 0.3 * F.col("space"))
    return accidentals.join(heads, [*(F.col(k) == F.col(f"__{k}") for k in keys), before], "left_anti")


def key_signatures(accidentals: DataFrame, keys: Cols) -> DataFrame:
    """Keys, x (of the last one), alterations (map letter -> semitones): accidentals (x, ord, letter, alteration, space) in runs without a gap of more than 2.2 spaces. Of a letter the last
    one counts; a natural takes it out."""
    w = W.partitionBy(*keys).orderBy("x", "ord")
    new = F.coalesce((F.col("x") - F.lag("x").over(w) > 2.2 * F.col("space")).cast("int"), F.lit(0))
    runs = accidentals.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = runs.groupBy(*keys, "__run", "letter").agg(F.max_by("alteration", F.struct("x", "ord")).alias("alteration"), F.max("x").alias("x"))
    entry = F.when(F.col("alteration") != 0, F.struct("letter", "alteration"))
    return last.groupBy(*keys, "__run").agg(F.max("x").alias("x"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("alterations")).drop("__run")


def fifths(alterations: Column) -> Column:
    """Sum of a key signature's alterations."""
    return F.aggregate(F.map_values(alterations), F.lit(0), lambda a, x: a + x)


def hyphenated(words: DataFrame, hyphens: DataFrame, keys: Cols) -> DataFrame:
    """Words (ord, x0, x1, y) with ``hyphen``: whether a hyphen (x0, y) of the same line (within 2) stands within 40 right of the word and before the next word of the line."""
    w = words.select(*keys, F.col("x0").alias("__ox"), F.col("y").alias("__oy"))
    following = words.join(w, list(keys)).where((F.abs(F.col("__oy") - F.col("y")) < 2) & (F.col("__ox") > F.col("x1"))).groupBy(*keys, "ord").agg(F.min("__ox").alias("__next"))
    known = words.join(following, [*keys, "ord"], "left").withColumn("__next", F.coalesce("__next", F.col("x1") + 40))
    h = hyphens.select(*keys, F.col("x0").alias("__hx"), F.col("y").alias("__hy"))
    met = known.join(h, list(keys)).where((F.col("__hx") > F.col("x1")) & (F.col("__hx") - F.col("x1") < 40) & (F.col("__hx") < F.col("__next")) & (F.abs(F.col("__hy") - F.col("y")) < 2))
    return words.join(met.select(*keys, "ord").distinct().withColumn("__h", F.lit(True)), [*keys, "ord"], "left").withColumn("hyphen", F.coalesce("__h", F.lit(False))).drop("__h")


def verse_rows(words: DataFrame, keys: Cols, space: Column) -> DataFrame:
    """Words (ord, y) with ``verse`` from 1: baselines (to whole points) less than 1.2 spaces from the one above are one line."""
    lines = words.select(*keys, F.bround("y", 0).alias("__y"), space.alias("__sp")).groupBy(*keys, "__y").agg(F.min("__sp").alias("__sp"))
    w = W.partitionBy(*keys).orderBy("__y")
    new = F.when(F.col("__y") - F.lag("__y").over(w) < 1.2 * F.col("__sp"), 0).otherwise(1)
    numbered = lines.withColumn("__new", new).withColumn("verse", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).select(*keys, "__y", "verse")
    return words.withColumn("__y", F.bround("y", 0)).join(numbered, [*keys, "__y"]).drop("__y")


def lyric_score(dx: Column, gap: Column, space: Column, above: Column) -> Column:
    """How badly a word fits a note: its distance along the staff and the gap between; below a staff the first five spaces count 0.8 and those from the sixth on a half more, above it all
    count 0.8, and 2 on top."""
    below = dx + 0.8 * F.least(gap, 5 * space) + 0.5 * F.greatest(F.lit(0.0), gap - 6 * space)
    return F.when(above, dx + 0.8 * gap + 2).otherwise(below)


def repeat_dots(glyphs: DataFrame) -> DataFrame:
    """Dots of the special font near the middle of their staff (within 0.8 spaces)."""
    return glyphs.where((F.col("font") == SPECIAL_FONT) & (F.col("ch") == DOT) & (F.abs(F.col("y") - F.col("mid")) < 0.8 * F.col("space")))


def time_signatures(glyphs: DataFrame, keys: Cols) -> DataFrame:
    """Keys, x, num, den: digits above each other about the staff's middle, in columns of 3 points, and the signs c (4/4) and C (2/2) within a space of it."""
    music = glyphs.where(F.col("font") == MUSIC_FONT)
    digits = music.where(F.col("ch").rlike("^[0-9]$") & (F.col("size") > 13)).withColumn("__place", F.bround(F.col("x0") / 3))
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("x", "ord", "ch")))), lambda s: s["ch"]), "")
    columns = digits.groupBy(*keys, "__place").agg(F.min_by("x0", "ord").alias("x"), side(F.col("y") < F.col("mid")).alias("__above"), side(F.col("y") > F.col("mid")).alias("__below"))
    stacked = columns.where("__above <> '' and __below <> ''").select(*keys, "x", F.col("__above").try_cast("int").alias("num"), F.col("__below").try_cast("int").alias("den"))
    signs = music.where(F.col("ch").isin("c", "C") & (F.abs(F.col("y") - F.col("mid")) < F.col("space")))
    value = F.when(F.col("ch") == "c", 4).otherwise(2)
    return stacked.unionByName(signs.select(*keys, F.col("x0").alias("x"), value.alias("num"), value.alias("den")))
