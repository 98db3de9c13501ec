"""Column expressions of music arithmetic. All are Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants

# Spellings of the twelve pitch classes, by sharps and by flats.
SHARPS = (("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0))
FLATS = (("C", 0), ("D", -1), ("D", 0), ("E", -1), ("E", 0), ("F", 0), ("G", -1), ("G", 0), ("A", -1), ("A", 0), ("B", -1), ("B", 0))


def midi_hz(midi: Column) -> Column:
    """Frequency of a MIDI pitch."""
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / 12)


def chord_duration(base: Column, beams: Column, dots: Column, tuplet: Column) -> Column:
    """Quarters of a chord: each beam halves, each dot adds half of what came before."""
    return base / F.pow(F.lit(2.0), beams) * (F.lit(2.0) - F.pow(F.lit(0.5), dots)) * tuplet


def beat_unit(num: Column, den: Column) -> Column:
    """Struct (unit in quarters, beats in a bar); eighths in threes beyond 3 are compound."""
    compound = (den == 8) & (num % 3 == 0) & (num > 3)
    return F.struct(F.when(compound, 1.5).otherwise(F.lit(4.0) / den).alias("unit"), F.when(compound, F.floor(num / 3)).otherwise(num).cast("int").alias("beats"))


def spelling(midi: Column, fifths: Column) -> Column:
    """Struct (step, alter, octave): sharps for keys of no flats, else flats."""
    pick = lambda t: F.element_at(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(a).alias("alter")) for s, a in t]), (F.pmod(midi, F.lit(12)) + 1).cast("int"))
    p = F.when(fifths >= 0, pick(SHARPS)).otherwise(pick(FLATS))
    return F.struct(p["step"].alias("step"), p["alter"].alias("alter"), (F.floor(midi / 12) - 1).cast("int").alias("octave"))


def syllabic(previous_hyphen: Column, hyphen: Column) -> Column:
    """single, begin, middle or end, from whether the syllable before and this one have a hyphen after them."""
    before, after = F.coalesce(previous_hyphen, F.lit(False)), F.coalesce(hyphen, F.lit(False))
    return F.when(before & after, "middle").when(before, "end").when(after, "begin").otherwise("single")


def threshold_pick(value: Column, thresholds, default: Column) -> Column:
    """The entry of the greatest threshold that the value reaches, else the default."""
    out = default
    for t, v in sorted(thresholds):
        out = F.when(value >= t, F.lit(v)).otherwise(out)
    return out


def lookup(key: Column, table: dict) -> Column:
    """The table's entry of the key, null without one."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def open_vowel(vowel: Column, hz: Column) -> Column:
    """The vowel sung at a frequency: closed ones open from their thresholds on; others stay."""
    out = vowel
    for v, thresholds in constants.OPEN_VOWELS.items():
        out = F.when(vowel == v, threshold_pick(hz, thresholds, vowel)).otherwise(out)
    return out


def consonant_seconds(phone: Column) -> Column:
    """Length of a consonant of the diphone voices; unknown ones last 60 ms."""
    return F.coalesce(lookup(phone, constants.CONSONANT_MS), F.lit(60)) / F.lit(1000.0)


def token_id(phone: Column, tokens: Column) -> Column:
    """Number of a phone in a bank's map of tokens: English first, unless the phone names its language (``de/b``), then the other form. Raises for
    a phone that it has in neither form."""
    english = F.concat(F.lit("en/"), phone)
    own = phone.contains("/")
    found = F.coalesce(F.try_element_at(tokens, F.when(own, phone).otherwise(english)), F.try_element_at(tokens, F.when(own, english).otherwise(phone)))
    return F.when(phone.isNotNull(), F.coalesce(found, F.raise_error(F.concat(F.lit("no token for the phone "), phone)).cast("int")))


def language_of(phone: Column, tokens: Column, languages: Column) -> Column:
    """Number of a phone's language: that it names, else English if the bank has it as an English token; 0 for what is not known."""
    named = F.coalesce(F.try_element_at(languages, F.split_part(phone, F.lit("/"), F.lit(1))), F.lit(0))
    english = F.coalesce(F.try_element_at(languages, F.lit("en")), F.lit(0))
    return F.when(phone.contains("/"), named).when(F.map_contains_key(tokens, F.concat(F.lit("en/"), phone)), english).otherwise(0)


def pan(position: Column) -> Column:
    """Equal-power gains (left, right) of a position from -1 to 1."""
    a = (position + 1) * (F.pi() / 4)
    return F.struct(F.cos(a).alias("left"), F.sin(a).alias("right"))


def consonant_lead(durations: Column) -> Column:
    """Seconds by which an onset comes before the beat: 0.55 of its consonants, at most 0.07."""
    return F.least(F.lit(0.55) * F.aggregate(durations, F.lit(0.0), lambda a, x: a + x), F.lit(0.07))


def cents(hz: Column, target: Column) -> Column:
    """Signed distance of a frequency from its target."""
    return F.lit(1200.0) * F.log2(hz / target)


def staff_geometry(lines: Column) -> Column:
    """Struct (top, bottom, space, mid) of five line positions in ascending order."""
    top, bottom = F.get(lines, F.lit(0)), F.get(lines, F.lit(4))
    return F.struct(top.alias("top"), bottom.alias("bottom"), ((bottom - top) / 4).alias("space"), F.get(lines, F.lit(2)).alias("mid"))


def swell(x: Column, seconds: Column) -> Column:
    """Loudness over a note's part x (0 to 1): notes of over 0.6 s swell, others stay at 1."""
    arch = F.pow(F.sin(F.pi() * F.least(F.lit(1.0), F.lit(1.6) * x)), F.lit(0.8))
    return F.when(seconds > 0.6, F.lit(0.86) + F.lit(0.14) * arch - F.lit(0.1) * x * x).otherwise(1.0)


def _initials(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def voice_kind(name: Column, upper_median: Column) -> Column:
    """soprano, alto, tenor, baritone or bass by the first letters of the name, else by the upper median of its pitches (< 52, < 60, < 67; without
    any it counts as 60)."""
    n, m = _initials(name), F.coalesce(upper_median, F.lit(60))
    by_pitch = F.when(m < 52, "bass").when(m < 60, "tenor").when(m < 67, "alto").otherwise("soprano")
    return F.when(n.rlike("^[sm]"), "soprano").when(n.rlike("^[ac]"), "alto").when(n.rlike("^t"), "tenor").when(n.rlike("^bar"), "baritone").when(n.rlike("^b"), "bass").otherwise(by_pitch)


def voice_model(name: Column, upper_median: Column) -> Column:
    """The diphone voice of a part: us3 for tenors and baritones, us2 for basses, us1 for higher voices; else us2 if the upper median is below 57."""
    n = _initials(name)
    return F.when(n.rlike("^(t|bar)"), "us3").when(n.rlike("^b"), "us2").when(n.rlike("^[sma]"), "us1").when(upper_median < 57, "us2").otherwise("us1")


def voice_rank(label: Column) -> Column:
    """Height of a voice by its name, 6 for soprano to 1 for bass, 0 if unknown; names of one letter count only in labels of at most two."""
    n = F.regexp_replace(F.lower(label), "[^a-zäöü]", "")
    out = F.lit(0)
    for start, rank in reversed(constants.VOICE_RANKS):
        fits = n.startswith(start) & (F.length(n) <= 2 if len(start) == 1 else F.lit(True))
        out = F.when(fits, rank).otherwise(out)
    return out


def clef(lowest: Column, highest: Column, name: Column) -> Column:
    """Struct (sign, line, octave) for a part: bass below a middle of 55; an octave lower for names with t, and below 62 for names that do not
    start with s, a or m; else treble."""
    mid, n = (lowest + highest) / 2, F.ltrim(F.lower(name))
    low = n.startswith("t") | ((mid < 62) & ~n.rlike("^[sam]"))
    make = lambda sign, line, octave: F.struct(F.lit(sign).alias("sign"), F.lit(line).alias("line"), F.lit(octave).alias("octave"))
    return F.when(mid < 55, make("F", 4, 0)).when(F.coalesce(low, F.lit(False)), make("G", 2, -1)).otherwise(make("G", 2, 0))


def _short(x: Column, digits: int) -> Column:
    """A number to so many digits without trailing zeros (for magnitudes from 1e-4 up to 10 ** digits)."""
    whole = F.greatest(F.floor(F.log10(F.abs(x))).cast("int") + 1, F.lit(-3))
    text = F.format_string("%." + str(digits + 3) + "f", F.round(x * F.pow(F.lit(10.0), digits - whole)) / F.pow(F.lit(10.0), digits - whole))
    return F.when(x == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", ""))


def tempo_text(qpm: Column) -> Column:
    """A tempo in quarters, eighths and dotted quarters a minute: ``4=58 (8=116, 4.=38.67)``."""
    return F.concat(F.lit("4="), _short(qpm, 6), F.lit(" (8="), _short(qpm * 2, 6), F.lit(", 4.="), _short(qpm / 1.5, 4), F.lit(")"))


def tempo_spec(spec: Column) -> Column:
    """Struct (qpm, unit) of ``8=116``, ``4.=39`` (unit in quarters, dotted: half more) or a plain number (unit null); null if it is neither."""
    sides = F.split(spec, "=")
    left, right = F.trim(F.get(sides, F.lit(0))), F.replace(F.trim(F.get(sides, F.lit(1))), F.lit(","), F.lit("."))
    dotted = left.endswith(".")
    note = F.when(dotted, F.substring(left, F.lit(1), F.length(left) - 1)).otherwise(left)
    known = (F.size(sides) == 2) & note.isin("1", "2", "4", "8", "16") & right.rlike("^[0-9]+([.][0-9]+)?$")
    unit = F.lit(4.0) / note.try_cast("double") * F.when(dotted, 1.5).otherwise(1.0)
    plain = F.replace(F.trim(spec), F.lit(","), F.lit(".")).try_cast("double")
    marked = F.struct((right.try_cast("double") * unit).alias("qpm"), unit.alias("unit"))
    return F.when(known, marked).when(plain.isNotNull(), F.struct(plain.alias("qpm"), F.lit(None).cast("double").alias("unit")))


def word_centre(x0: Column, x1: Column) -> Column:
    return (x0 + x1) / 2


def stem_side(stem_x: Column, head_x0: Column, head_x1: Column, space: Column) -> Column:
    """up if a stem stands near a head's right edge, down if near its left one, else null. (A head narrower than 0.9 spaces can be both: up.)"""
    up = (stem_x > head_x1 - 0.6 * space) & (stem_x < head_x1 + 0.15 * space)
    down = (stem_x > head_x0 - 0.15 * space) & (stem_x < head_x0 + 0.3 * space)
    return F.when(up, "up").when(down, "down")


def head_centre(heads: Column) -> Column:
    """Mean centre of a chord's heads (array of struct x0, x1)."""
    return F.aggregate(heads, F.lit(0.0), lambda a, h: a + (h["x0"] + h["x1"]) / 2) / F.size(heads)


def lyric_anchor(word_x0: Column, word_x1: Column, centre: Column, left: Column) -> Column:
    """Where a word stands under a chord of that centre and left edge: the word's centre, or, where its left edge is nearer to the chord's left
    edge than centre to centre, as far right of its left edge as the chord's centre is of its own."""
    mid = (word_x0 + word_x1) / 2
    return F.when(F.abs(mid - centre) <= F.abs(word_x0 - left), mid).otherwise(word_x0 + (centre - left))


def taper(seconds_to_end: Column, seconds: Column, last_of_phrase: Column) -> Column:
    """Loudness at the end of a phrase: over the last 120 ms (of a note not longer than that) it falls from 1 to 0.55; else 1."""
    over = F.least(F.lit(0.12), seconds)
    return F.when(last_of_phrase & (seconds_to_end < over), 1 - 0.45 * (1 - seconds_to_end / over)).otherwise(1.0)


def beam_y_range(points: Column, x: Column, slack: float = 0.05, flat: float = 0.8) -> Column:
    """Struct (lo, hi): where the outline (array of struct x, y) crosses x; edges count a little beyond their ends, upright ones within ``flat``.
    Null if none does."""
    n = F.size(points)
    ys = F.flatten(F.transform(points, lambda p, i: _edge(p, F.element_at(points, F.pmod(i + 1, n) + 1), x, slack, flat)))
    return F.when(F.size(ys) > 0, F.struct(F.array_min(ys).alias("lo"), F.array_max(ys).alias("hi")))


def _edge(p: Column, q: Column, x: Column, slack: float, flat: float) -> Column:
    t = F.try_divide(x - p["x"], q["x"] - p["x"])
    upright = F.abs(q["x"] - p["x"]) < 1e-9
    none = F.array().cast("array<double>")
    return F.when(upright, F.when(F.abs(x - p["x"]) <= flat, F.array(p["y"], q["y"])).otherwise(none)).when(t.between(-slack, 1 + slack), F.array(p["y"] + t * (q["y"] - p["y"]))).otherwise(none)


def split_duration(divisions: Column, shapes: list[int]) -> Column:
    """Greedy split into notatable pieces: the largest shape that fits each time; a rest below the smallest is taken whole. Null and numbers
    below 1 give no piece."""
    shape = F.array(*[F.lit(s).cast("long") for s in sorted(shapes, reverse=True)])

    def take(acc, s):
        k = F.floor(acc["left"] / s).cast("int")
        return F.struct((acc["left"] - k * s).alias("left"), F.concat(acc["out"], F.array_repeat(s, k)).alias("out"))

    left = F.greatest(F.coalesce(divisions.cast("long"), F.lit(0)), F.lit(0))
    start = F.struct(left.alias("left"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(shape, start, take, lambda a: F.when(a["left"] > 0, F.array_append(a["out"], a["left"])).otherwise(a["out"]))


def even_picks(values: Column, k: int) -> Column:
    """At most k elements of an array: all, or those at floor(i * n / k) for i from 0 to k - 1."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(values, F.floor(i.cast("long") * n / k).cast("int")))
    return F.when(n <= k, values).otherwise(at)


def map_union(own: Column, other: Column) -> Column:
    """All entries of two maps; where both have a key, ``own`` counts. A null map is empty."""
    a, b = F.coalesce(F.map_entries(own), F.array()), F.coalesce(F.map_entries(other), F.array())
    lacking = F.filter(b, lambda e: ~F.coalesce(F.map_contains_key(own, e["key"]), F.lit(False)))
    return F.map_from_entries(F.concat(a, lacking))


def click_sample(t: Column, freq: float) -> Column:
    """Sample at t seconds of a metronome click: a tone and a partial a little above its octave, both falling by a factor e in 1/90 s."""
    turn = F.lit(2.0) * F.pi() * freq
    return (F.sin(turn * t) + 0.3 * F.sin(F.lit(2.0) * F.pi() * F.lit(2.01) * freq * t)) * F.exp(-90 * t)
