"""Syllables of a voice to timed sounds: lengths of consonants, a cursor along the voice, the text form of diphone synthesis, pitch points. A cursor that never runs back is a running
maximum, so most of this is window expressions; what looks at the segment before it is a fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants
from ..functions.scalars import consonant_lead, consonant_seconds, lookup, midi_hz, open_vowel
from .ordered import fold

Cols = Sequence[str]


def max_plus(df: DataFrame, keys: Cols, order: Cols, least: Column, plus: Column, name: str, start: float = 0.0) -> DataFrame:
    """The recurrence c = max(least, c before + plus) along each key, from ``start``, and the value before as ``name``_before: with the running sum B of ``plus`` it is B + the running maximum of
    least - B. A null ``least`` sets no bound."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumns({"__plus": plus, "__least": least}).withColumn("__sum", F.sum("__plus").over(w))
    top = F.greatest(F.lit(start), F.coalesce(F.max(F.col("__least") - F.col("__sum")).over(w), F.lit(start)))
    done = summed.withColumn(name, F.col("__sum") + top)
    before = F.coalesce(F.lag(name).over(W.partitionBy(*keys).orderBy(*order)), F.lit(start))
    return done.withColumn(f"{name}_before", before).drop("__plus", "__least", "__sum")


def lay_out(df: DataFrame, keys: Cols, order: Cols, phone: str, start: str, end: str, dur: str | None = None, least: float = 0.012, gap: float = 0.002, pause: float = 0.025) -> DataFrame:
    """Sounds one after another: keys, ``order``, slot (0 silence before, 1 the sound), phone, start, end. A sound starts at its ``start`` or where the one before ends, whichever is later (null: there), ends at ``end`` (null: after
    ``dur``) and lasts at least ``least``. More than ``gap`` before it is silence (``_``). The same vowel twice in a row is parted by ``pause`` taken from the first."""
    length = F.col(dur) if dur else F.lit(None).cast("double")
    stop = F.coalesce(F.col(end), F.col(start) + length)
    bound = F.when(F.col(start).isNull(), F.col(end)).otherwise(F.greatest(stop, F.col(start) + least))
    step = F.when(F.col(start).isNull() & F.col(end).isNull(), F.greatest(length, F.lit(least))).otherwise(F.lit(least))
    rows = max_plus(df, keys, order, bound, step, "__c")
    w = W.partitionBy(*keys).orderBy(*order)
    silent = F.coalesce(F.col(start) > F.col("__c_before") + gap, F.lit(False))
    placed = rows.withColumns({"__s": F.greatest(F.coalesce(F.col(start), F.col("__c_before")), F.col("__c_before")), "__silent": silent})
    twice = F.col(phone).isin(*constants.VOWELS) & (F.lag(phone).over(w) == F.col(phone)) & ~F.col("__silent") & (F.abs(F.col("__s") - F.col("__c_before")) < gap)
    marked = placed.withColumn("__twice", F.coalesce(twice, F.lit(False)))
    shortened = marked.withColumn("__e", F.col("__c") - F.when(F.coalesce(F.lead("__twice").over(w), F.lit(False)), pause).otherwise(0.0))
    make = lambda slot, name, a, b: F.struct(F.lit(slot).alias("slot"), name.alias("phone"), a.alias("start"), b.alias("end"))
    before = F.when(F.col("__silent"), make(0, F.lit("_"), F.col("__c_before"), F.col("__s"))).when(F.col("__twice"), make(0, F.lit("_"), F.col("__c_before") - pause, F.col("__s")))
    sounds = F.array_compact(F.array(before, make(1, F.col(phone), F.col("__s"), F.col("__e"))))
    return shortened.select(*keys, *order, F.inline(sounds))


def place_syllables(units: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """The sounds of syllables for ``lay_out``: keys, ``order``, at, phone, start, end, dur. units: onset, nucleus, coda (phones), start, end (seconds), lead (whether the onset comes before the beat), midi_high.

    A single nasal coda lasts 0.28 of the syllable, from 70 to 160 ms; onset and coda share at most 0.55 of the syllable in proportion; the onset starts 0.55 of itself, at most 70 ms, early; a schwa of
    over 0.4 s is sung open, and vowels open with the highest pitch."""
    length = F.col("end") - F.col("start")
    seconds = lambda c: F.transform(c, consonant_seconds)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    nasal = (F.size("coda") == 1) & F.get("coda", F.lit(0)).isin(*constants.NASALS)
    hummed = F.array(F.least(F.lit(0.16), F.greatest(F.lit(0.07), length * 0.28)))
    timed = units.withColumns({"__on": seconds(F.col("onset")), "__co": F.when(nasal, hummed).otherwise(seconds(F.col("coda")))})
    used = total(F.col("__on")) + total(F.col("__co"))
    scaled = timed.withColumn("__k", F.when(used > 0.55 * length, 0.55 * length / used).otherwise(1.0))
    scale = lambda c: F.transform(c, lambda d: d * F.col("__k"))
    fitted = scaled.withColumns({"__on": scale(F.col("__on")), "__co": scale(F.col("__co"))})
    early = F.col("start") - F.when(F.col("lead"), consonant_lead(F.col("__on"))).otherwise(0.0)
    v_end = F.col("end") - total(F.col("__co"))
    held = v_end - early - total(F.col("__on")) > 0.4
    vowel = open_vowel(F.when((F.col("nucleus") == "@") & held, "V").otherwise(F.col("nucleus")), midi_hz(F.col("midi_high")))
    none = F.lit(None).cast("double")
    sound = lambda p, a, b, d: F.struct(p.alias("phone"), a.alias("start"), b.alias("end"), d.alias("dur"))
    onset = F.transform(F.arrays_zip(F.col("onset").alias("p"), F.col("__on").alias("d")), lambda z, i: sound(z["p"], F.when(i == 0, early), none, z["d"]))
    coda = F.transform(F.arrays_zip(F.col("coda").alias("p"), F.col("__co").alias("d")), lambda z: sound(z["p"], none, none, z["d"]))
    nucleus = F.array(sound(vowel, F.when(F.size("onset") == 0, early), v_end, none))
    return fitted.select(*keys, *order, F.posexplode(F.concat(onset, nucleus, coda)).alias("at", "__x")).select(*keys, *order, "at", "__x.*")


def held_pieces(segments: DataFrame, self_joins: Sequence[str] = ()) -> DataFrame:
    """Segments (phone, start, end) with ``pieces`` (array of struct a, b): a sound that joins itself and lasts over 0.2 s keeps 70 ms at both ends, and its middle is cut into pieces of at most 1.2 s; so is a longer
    silence."""
    a, b, span = F.col("start"), F.col("end"), F.col("end") - F.col("start")
    joins = F.col("phone").isin(*self_joins) if self_joins else F.lit(False)
    cut = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.floor((hi - lo) / 1.2).cast("int") + 1), lambda j: lo + (hi - lo) * j / (F.floor((hi - lo) / 1.2) + 1))
    cuts = F.when(joins & (span > 0.2), F.concat(F.array(a), cut(a + 0.07, b - 0.07), F.array(b))).when((span > 1.2) & (F.col("phone") == "_"), cut(a, b)).otherwise(F.array(a, b))
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b")))
    return segments.withColumn("__cuts", cuts).withColumn("pieces", pairs(F.col("__cuts"))).drop("__cuts")


def pho_lines(segments: DataFrame, keys: Cols, order: Cols, points: str | None = None, self_joins: Sequence[str] = ()) -> DataFrame:
    """Keys, ``order``, piece, line, text: lines ``phone milliseconds [percent hertz ...]`` of diphone synthesis. Ends are rounded to milliseconds (halves to even) and each line lasts to its end from that of the lines before;
    a late start is filled with silence; lines of no length are left out. ``points`` (array of struct t, hz in ascending t): those from -0.5 to 100.5 percent of a line, clamped, strictly rising, at most 60 evenly picked."""
    cut = held_pieces(segments, self_joins)
    whole = F.size("pieces") == 1
    rows = cut.select(*keys, *order, "phone", *([points] if points else []), whole.alias("__whole"), F.posexplode("pieces").alias("piece", "__p")).withColumns({"__a": F.bround(F.col("__p.a") * 1000).cast("long"), "__b": F.bround(F.col("__p.b") * 1000).cast("long")})
    along = [*order, "piece"]
    w = W.partitionBy(*keys).orderBy(*along)
    reach = F.when(F.col("phone") != "_", F.greatest("__a", "__b")).otherwise(F.col("__b"))
    upto = F.greatest(F.lit(0), F.coalesce(F.max(reach).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("__pos", upto).withColumn("__from", F.when(F.col("phone") != "_", F.greatest("__pos", "__a")).otherwise(F.col("__pos"))).withColumn("__ms", F.col("__b") - F.col("__from"))
    silence = F.when(F.col("__from") > F.col("__pos"), F.struct(F.lit(0).alias("line"), F.concat(F.lit("_ "), (F.col("__from") - F.col("__pos")).cast("string")).alias("text")))
    text = F.concat_ws(" ", F.col("phone"), F.col("__ms").cast("string"), _point_text(F.col(points)) if points else F.lit(""))
    sound = F.when(F.col("__ms") > 0, F.struct(F.lit(1).alias("line"), text.alias("text")))
    return placed.select(*keys, *along, F.inline(F.array_compact(F.array(silence, sound))))


def _point_text(points: Column) -> Column:
    """The points of a line as text; a cut sound also gets the pitch at its two ends."""
    a, b = F.col("__p.a"), F.col("__p.b")
    at = lambda x: F.struct(x.alias("t"), interpolated(points, x).alias("hz"))
    inner = F.filter(points, lambda p: (p["t"] > a) & (p["t"] < b))
    mine = F.when(F.col("__whole") | (F.size(points) == 0), points).otherwise(F.concat(F.array(at(a)), inner, F.array(at(b))))
    percent = F.transform(mine, lambda p: F.struct(F.bround((p["t"] - F.col("__from") / 1000.0) / (F.col("__ms") / 1000.0) * 100, 1).alias("pct"), p["hz"].alias("hz")))
    within = F.filter(percent, lambda p: p["pct"].between(-0.5, 100.5))
    rising = F.aggregate(within, F.struct(F.lit(-1.0).alias("last"), F.array().cast("array<struct<pct:double,hz:double>>").alias("out")), lambda acc, p: F.when(p["pct"] > acc["last"], F.struct(p["pct"].alias("last"), F.array_append(acc["out"], p).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    shown = F.transform(rising, lambda p: F.format_string("%.1f %.1f", F.least(F.lit(100.0), F.greatest(F.lit(0.0), p["pct"])), p["hz"]))
    n = F.size(shown)
    picked = F.when(n <= 60, shown).otherwise(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.get(shown, F.floor(i * (n / 60)).cast("int"))))
    return F.array_join(picked, " ")


def interpolated(points: Column, x: Column) -> Column:
    """The height at x of a line through points (array of struct t, hz, ascending in t); beyond its ends that of the end."""
    before = F.element_at(F.filter(points, lambda p: p["t"] <= x), -1)
    after = F.get(F.filter(points, lambda p: p["t"] > x), F.lit(0))
    between = before["hz"] + (after["hz"] - before["hz"]) * (x - before["t"]) / (after["t"] - before["t"])
    return F.when(F.size(points) > 0, F.when(before.isNull(), after["hz"]).when(after.isNull(), before["hz"]).otherwise(between))


def clipped_seconds(phone: Column, proposal: Column) -> Column:
    """A proposed length of a consonant within the bounds of its kind."""
    out = F.least(F.greatest(proposal, F.lit(constants.OTHER_CLIP[0])), F.lit(constants.OTHER_CLIP[1]))
    for phones, (low, high) in constants.CLIPS:
        out = F.when(phone.isin(*phones), F.least(F.greatest(proposal, F.lit(low)), F.lit(high))).otherwise(out)
    return out


def consonant_plan(units: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """units (onset, coda: arrays of phones; onset_p, coda_p: proposed seconds; t, end; last_t: start of its last note) with on_d and co_d, the seconds sung. Proposals are clipped; a final m, n or ng lasts at least a quarter of the
    unit, up to 0.18 s; a unit's coda and the onset of one that follows within 20 ms share half of it, or 0.6 of its last note if that is less."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    clipped = lambda p, d: F.transform(F.arrays_zip(F.col(p).alias("p"), F.col(d).alias("d")), lambda z: clipped_seconds(z["p"], z["d"]))
    length = F.col("end") - F.col("t")
    hummed = F.element_at("coda", -1).isin("m", "n", "ng")
    heavy = F.transform(clipped("coda", "coda_p"), lambda d, i: F.when((i == F.size("coda") - 1) & hummed, F.greatest(d, F.least(F.lit(0.18), length * 0.25))).otherwise(d))
    timed = units.withColumns({"on_d": clipped("onset", "onset_p"), "co_d": F.when(F.size("coda") > 0, heavy).otherwise(F.array().cast("array<double>"))})
    w = W.partitionBy(*keys).orderBy(*order)
    near = F.coalesce(F.lead("t").over(w) - F.col("end") < 0.02, F.lit(False))
    following = F.when(near, F.lead(total(F.col("on_d"))).over(w)).otherwise(0.0)
    budget = F.least(length * 0.5, (F.col("end") - F.greatest("t", "last_t")) * 0.6)
    need = timed.withColumns({"__next": following, "__budget": budget}).withColumn("__used", total(F.col("co_d")) + F.col("__next"))
    ratio = need.withColumn("__k", F.when(F.col("__used") > F.col("__budget"), F.col("__budget") / F.col("__used")).otherwise(1.0))
    before = F.coalesce(F.lag(F.when(F.col("__next") > 0, F.col("__k")).otherwise(1.0)).over(w), F.lit(1.0))
    times = lambda c, k: F.transform(c, lambda d: d * k)
    scaled = ratio.withColumn("__b", before)
    return scaled.withColumns({"on_d": times(F.col("on_d"), F.col("__b")), "co_d": times(F.col("co_d"), F.col("__k"))}).drop("__next", "__budget", "__used", "__k", "__b")


class Segments:
    """The phone segments of a phrase, end to end: a later one cuts off what it overlaps, gaps become silence, and what is shorter than ``least`` is dropped."""

    def __init__(self, least: float = 0.005):
        self.out: list[tuple[str, float, float]] = []
        self.least = least

    def push(self, phone: str, start: float, end: float) -> None:
        if end - start < self.least:
            return
        if self.out and self.out[-1][2] > start:
            name, a, _ = self.out.pop()
            if start - a >= self.least:
                self.out.append((name, a, start))
        if self.out and start > self.out[-1][2] + 1e-6:
            self.out.append((constants.SILENCE, self.out[-1][2], start))
        self.out.append((phone, start, end))


def phrase_segments(units: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """Keys, seq, phone, start, end of each phrase's sounds. units: onset, on_d, vowel, coda, co_d (of ``consonant_plan``), t, end, t0 (where the phrase's silence starts). The onset comes before the beat, the coda ends the unit; a unit that no
    other follows within 20 ms leaves up to 40 ms to breathe; over 0.3 s before a phrase end with a breath of 0.2 s; a stop after a sound has a short closure before it; a long closing diphthong is held on its first vowel.
    A ``fold``, as a segment may cut off the one before."""
    closures = {c: s for phones, s in constants.CLOSURES for c in phones}

    def make():
        segments, held = Segments(), []

        def sing(unit, following):
            onset, on_d, vowel, coda, co_d, t, end, _ = unit
            at = t - sum(on_d)
            for i, (phone, d) in enumerate(zip(onset, on_d, strict=True)):
                if i == 0 and phone in closures and segments.out and segments.out[-1][0] not in (constants.SILENCE, constants.BREATH):
                    last = segments.out[-1]
                    segments.push(constants.SILENCE, at - min(closures[phone], 0.4 * (last[2] - last[1])), at)
                segments.push(constants.ONSET_TOKENS.get(phone, phone), at, at + d)
                at += d
            if following is not None and following[5] - end < 0.02:
                stop = following[5] - sum(following[1]) - sum(co_d)
            else:
                stop = end - sum(co_d) - min(0.04, 0.1 * (end - t))
            stop = max(stop, t + 0.03)
            if vowel in constants.GLIDES and stop - t > 0.5:
                first, glide = constants.GLIDES[vowel]
                g = min(0.11 if coda else 0.16, max(0.08, 0.15 * (stop - t)))
                segments.push(first, t, stop - g)
                segments.push(glide, stop - g, stop)
            else:
                segments.push(vowel, t, stop)
            for phone, d in zip(coda, co_d, strict=True):
                segments.push(phone, stop, stop + d)
                stop += d

        def step(row):
            if row is None:
                if held:
                    sing(held[0], None)
                return [(i, *s) for i, s in enumerate(segments.out)]
            if held:
                sing(held.pop(), row)
            else:
                t0, start = row[7], row[5] - sum(row[1])
                breath = start - t0 > 0.3
                segments.push(constants.SILENCE, t0, start - 0.2 if breath else start)
                if breath:
                    segments.push(constants.BREATH, start - 0.2, start)
            held.append(row)
            return []

        return step

    return fold(units, keys, order, ["onset", "on_d", "vowel", "coda", "co_d", "t", "end", "t0"], "seq int, phone string, start double, end double", make)


def pitch_points(notes: Sequence[tuple[float, float, float]], start: float, end: float, seed: int, vibrato: bool = True, scoop: bool = True) -> list[tuple[float, float]]:
    """(seconds, hertz) along a vowel over notes (t, dur, midi): it enters the first from a little below and glides into others; long notes get a vibrato that fades in, shorter ones waver slowly. The random numbers are NumPy's, in this order."""
    import math

    import numpy as np

    rng, out = np.random.default_rng(seed), []
    hz = lambda midi, cents=0.0: 440.0 * 2 ** ((midi - 69) / 12) * 2 ** (cents / 12)
    for i, (t, dur, midi) in enumerate(notes):
        a, b = max(start, t), min(end, t + dur)
        if b <= a:
            continue
        settled = a + min(0.045, (b - a) / 3)
        out += [(a, hz(notes[i - 1][2]) if i else hz(midi, -0.35 if scoop else 0.0)), (settled, hz(midi))]
        wander = 0.0
        if vibrato and b - a > 0.5:
            rate, depth = 5.0 + rng.uniform(-0.35, 0.35), 0.16 + rng.uniform(0, 0.06)
            begin = at = a + min(0.3, 0.3 * (b - a))
            pulse, phase = 1 / rate / 8, 0.0
            while at < b - 0.04:
                wander = 0.9 * wander + rng.normal(0, 0.01)
                out.append((at, hz(midi, min(1.0, (at - begin) / 0.35) * depth * math.sin(phase) + wander)))
                phase += 2 * math.pi * rate * pulse * (1 + rng.normal(0, 0.03))
                at += pulse
        else:
            at = settled + 0.12
            while at < b - 0.05:
                wander = 0.7 * wander + rng.normal(0, 0.035)
                out.append((at, hz(midi, wander)))
                at += 0.12
        out.append((b, hz(midi)))
    return out


def pitch_column(notes: Column, start: Column, end: Column, seed: Column, vibrato: bool = True, scoop: bool = True) -> Column:
    """``pitch_points`` over an array of struct (t, dur, midi), in Arrow batches."""

    @F.arrow_udf("array<struct<t:double,hz:double>>")
    def run(notes, start, end, seed):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("t", pa.float64()), ("hz", pa.float64())]))
        rows = zip(*(c.to_pylist() for c in (notes, start, end, seed)), strict=True)
        return pa.array([[{"t": t, "hz": f} for t, f in pitch_points([(n["t"], n["dur"], n["midi"]) for n in ns], a, b, s, vibrato, scoop)] for ns, a, b, s in rows], kind)

    return run(notes, start, end, seed)


def pho_pitch(lines: DataFrame, keys: Cols, order: Cols, text: str, frame: float) -> DataFrame:
    """Keys, frame_idx, hz: the pitch that lines ``phone ms [percent hertz ...]`` ask for, on a grid of ``frame`` seconds; 0 outside sounds with a pitch, on frames of which some part is voiced. Points that follow
    each other are joined by straight lines; a key without points has none."""
    parts = F.split(text, " +")
    ms = F.get(parts, F.lit(1)).cast("double")
    timed = lines.withColumns({"__ph": F.get(parts, F.lit(0)), "__ms": ms}).withColumn("__t", F.coalesce(F.sum("__ms").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / 1000)
    numbers = F.transform(F.filter(F.slice(parts, 3, 10_000), lambda x: x != ""), lambda x: x.cast("double"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(numbers) / 2).cast("int"), F.lit(1))), lambda i: F.when(F.size(numbers) > 1, F.struct((F.col("__t") + F.col("__ms") / 1000 * F.get(numbers, 2 * i - 2) / 100).alias("at"), F.get(numbers, 2 * i - 1).alias("hz"))))
    points = timed.select(*keys, F.inline(F.array_compact(pairs)))
    voiced = timed.where(~F.col("__ph").isin(*constants.UNVOICED) & (F.col("__ms") > 0))
    on = voiced.select(*keys, F.explode(F.sequence(F.floor(F.col("__t") / frame), F.ceil((F.col("__t") + F.col("__ms") / 1000) / frame))).alias("frame_idx")).distinct()
    total = timed.groupBy(*keys).agg(F.max(F.col("__t") + F.col("__ms") / 1000).alias("__end"))
    grid = total.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__end") / frame))).alias("frame_idx")).withColumn("at", F.col("frame_idx") * frame)
    from .signal import interpolate

    found = interpolate(points, grid.select(*keys, "at"), list(keys), "at", "hz").withColumn("frame_idx", F.bround(F.col("at") / frame).cast("long")).drop("at")
    return found.join(on.withColumn("__on", F.lit(True)), [*keys, "frame_idx"], "left").select(*keys, "frame_idx", F.when(F.col("__on"), F.col("hz")).otherwise(0.0).alias("hz"))


def singer_table(singers: int, seed: int, cents: tuple[float, float] = (6, 12), delay: tuple[float, float] = (0.025, 0.045)) -> list[tuple[int, float, float, float]]:
    """(singer, detune in cents, delay in seconds, gain) of a section: the first as written; others off pitch, up and down in turn, late and at 0.7; all over the root of their power. The random numbers are NumPy's."""
    import numpy as np

    rng, level = np.random.default_rng(seed + 99), (1 + 0.49 * (singers - 1)) ** -0.5
    out = [(0, 0.0, 0.0, level)]
    for k in range(1, singers):
        off = float(rng.uniform(*cents)) * (1 if k % 2 else -1)
        out.append((k, off, float(rng.uniform(*delay)), 0.7 * level))
    return out[:singers]


def section(samples: DataFrame, singers: DataFrame, keys: Cols, length: int | None = None) -> DataFrame:
    """Keys, idx, value: the sum of a section's singers. samples: keys, singer, idx, value; singers: singer, shift (samples), gain. Samples beyond ``length`` are left out; a short table of singers is broadcast."""
    moved = samples.join(F.broadcast(singers.select("singer", "shift", "gain")), "singer").select(*keys, (F.col("idx") + F.col("shift")).alias("idx"), (F.col("value") * F.col("gain")).alias("value"))
    kept = moved.where(F.col("idx") >= 0) if length is None else moved.where((F.col("idx") >= 0) & (F.col("idx") < length))
    return kept.groupBy(*keys, "idx").agg(F.sum("value").alias("value"))


def faded(position: Column, length: Column, fade: int) -> Column:
    """Gain of a sample of a phrase: from 0 to 1 over its first ``fade`` samples, and back over its last."""
    return F.least(F.lit(1.0), position / F.lit(max(1, fade - 1)), (length - 1 - position) / F.lit(max(1, fade - 1)))


def predicted_seconds(units: DataFrame, phones: str, model: Callable | None = None) -> DataFrame:
    """units with ``predicted``: seconds of each of the phones by the model (lists of phones -> lists of seconds, in Arrow batches), 70 ms each without one."""
    if model is None:
        return units.withColumn("predicted", F.transform(phones, lambda _: F.lit(0.07)))

    @F.arrow_udf("array<double>")
    def run(column):
        import pyarrow as pa

        return pa.array(model(column.to_pylist()), pa.list_(pa.float64()))

    return units.withColumn("predicted", run(F.col(phones)))


def render(segments: DataFrame, keys: Cols, order: Cols, engine: Callable, rate: int = constants.SAMPLE_RATE) -> DataFrame:
    """Keys, idx, value: the samples that an engine (list of (phone, start, end) -> array of floats at ``rate``) makes of each key's segments. An engine is loaded once in a worker; a key, as a phrase, is one call."""
    held = list(order)

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(held)
        y = np.asarray(engine(list(zip(pdf["phone"], pdf["start"], pdf["end"], strict=True)), rate), np.float64)
        return pd.DataFrame({**{k: [v] * len(y) for k, v in zip(keys, key, strict=True)}, "idx": np.arange(len(y)), "value": y})

    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)
    return segments.groupBy(*keys).applyInPandas(run, f"{kinds}, idx long, value double")


def self_joining(spark, probe: Callable[[str], bool], phones: Sequence[str] | None = None) -> DataFrame:
    """One column, phone: the sounds that a voice can join to themselves, by a probe of each vowel and hum; a table of some twenty rows that ``held_pieces`` takes as a list."""
    asked = sorted(constants.VOWELS | constants.SONORANTS) if phones is None else list(phones)
    return spark.createDataFrame([(p,) for p in asked if probe(p)], "phone string")


def mix_gains(parts: DataFrame, order: str, focus: str | None = None, others: float = 0.1) -> DataFrame:
    """part, left, right: all parts spread from -0.7 to 0.7 by equal power; with one in focus that at 1.2 on the left and the others at ``others`` on the right."""
    from ..functions.scalars import pan

    if focus is not None:
        mine = F.col("part") == focus
        return parts.select("part", F.when(mine, 1.2).otherwise(0.0).alias("left"), F.when(mine, 0.0).otherwise(others).alias("right"))
    every = W.partitionBy(F.lit(0))  # a row a part
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1
    gains = pan(-0.7 + 1.4 * place / F.greatest(F.lit(1), F.count("*").over(every) - 1))
    return parts.select("part", gains.alias("__g")).select("part", F.col("__g.left").alias("left"), F.col("__g.right").alias("right"))


def dry_mix(samples: DataFrame, gains: DataFrame, clicks: DataFrame | None = None, focus: str | None = None, level: float = 0.2) -> DataFrame:
    """idx, left, right: every part's samples (part, idx, value) brought to an active level (above 1e-3) of ``level`` and summed by its gains; clicks (idx, value) at 0.35 on both sides, with a part in focus at 1.3 times that on the right only."""
    from .aggregates import active_rms

    scale = active_rms(samples, ["part"], "value", 1e-3).join(gains, "part").select("part", *[(level / F.col("rms") * F.col(s)).alias(s) for s in ("left", "right")])
    rows = samples.join(F.broadcast(scale), "part").select("idx", *[(F.col("value") * F.col(s)).alias(s) for s in ("left", "right")])
    if clicks is not None:
        left = F.lit(0.0) if focus is not None else F.col("value") * 0.35
        right = F.col("value") * 0.35 * (1.3 if focus is not None else 1.0)
        rows = rows.unionByName(clicks.select("idx", left.alias("left"), right.alias("right")))
    return rows.groupBy("idx").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))


#: Clicks by level: hertz, seconds, gain. Fixed values.
CLICKS = {2: (1760.0, 0.035, 1.0), 1: (1320.0, 0.035, 0.8), 0: (1100.0, 0.025, 0.45)}


def metronome(beats: DataFrame, rate: int, length: int) -> DataFrame:
    """idx, value: the clicks of beats (t in seconds, level), added where they overlap; samples beyond ``length`` and beats before 0 are left out."""
    from ..functions.scalars import click_sample

    sounds = [F.when(F.col("level") == k, F.sequence(F.lit(0), F.lit(int(seconds * rate) - 1))) for k, (_, seconds, _) in CLICKS.items()]
    spread = beats.where("t >= 0").select(F.floor(F.col("t") * rate).alias("__i"), "level", F.explode(F.coalesce(*sounds)).alias("__k"))
    value = reduce(lambda out, k: F.when(F.col("level") == k, click_sample(F.col("__k") / float(rate), CLICKS[k][0]) * CLICKS[k][2]).otherwise(out), CLICKS, F.lit(0.0))
    placed = spread.select((F.col("__i") + F.col("__k")).alias("idx"), value.alias("value"))
    return placed.where(F.col("idx") < length).groupBy("idx").agg(F.sum("value").alias("value"))


def arpabet(phones: Column) -> Column:
    """The phones of the neural voices for SAMPA; unknown ones are dropped."""
    return F.filter(F.transform(phones, lambda p: lookup(p, constants.ARPABET)), lambda p: p.isNotNull())
