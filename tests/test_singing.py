"""Folds and NumPy operators of singing against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import phonetics
from tidemark.functions.constants import CLOSURES, GLIDES, ONSET_TOKENS
from tidemark.operators import pages, signal, singing


def test_regrouped_words():
    words = {"christmas", "christ", "a", "way", "away", "joy", "joyful", "sing", "song"}.__contains__
    assert phonetics.regroup([["Christ"], ["mas"]], words) == [[0, 1]]
    assert phonetics.regroup([["a", "way", "Christ"]], words) == [[0, 1], [2]]
    assert phonetics.regroup([["sing"], ["song"], ["joy"], ["ful"]], words) == [[0], [1], [2, 3]]
    assert phonetics.regroup([["la", "la"], ["an' sing"], ["x", "y"]], words) == [[0, 1], [2], [3, 4]]
    assert phonetics.regroup([], words) == []


def test_split_syllables():
    split = phonetics.split_syllables
    assert split(["k", "r", "I", "s", "m", "@", "s"], 2, ["Christ", "mas"]) == [(["k", "r"], "I", ["s"]), (["m"], "@", ["s"])]
    assert split(["r", "I", "v", "@"], 1, ["river"]) == [(["r"], "I", ["v", "@"])]
    assert split(["E", "n", "i"], 2, ["en", "y"]) == [([], "E", ["n"]), ([], "i", [])]
    assert split(["s", "t", "E", "s", "t", "r", "A"], 2, ["ste", "stra"]) == [(["s", "t"], "E", ["s"]), (["t", "r"], "A", [])]
    assert split(["d", "m"], 2, ["dm", ""]) == [(["d"], "m", []), ([], "m", [])]
    assert split(["t"], 2, ["t", ""]) == [(["t"], "@", []), ([], "@", [])] and split([], 1, ["x"]) == [([], "@", [])]
    assert split(["f", "AI", "@", "r", "E"], 2, ["fi", "re"]) == [(["f"], "AI", ["@"]), (["r"], "E", [])]


def test_syllabify(spark):
    rows = [("v", 0, "ri", True), ("v", 1, "ver", False), ("v", 2, None, False), ("v", 3, "la", True), ("v", 4, "la", False), ("v", 5, "an' sing", False), ("v", 6, "Christ", False), ("v", 7, "mas", False)]
    notes = spark.createDataFrame(rows, "voice string, t int, text string, hyphen boolean")
    lexicon = spark.createDataFrame([("river", "en-us", "ˈɹɪvə"), ("christmas", "en-us", "kɹˈɪsməs"), ("an' sing", "en-us", "ən sˈɪŋ")], "word string, lang string, ipa string")
    out = phonetics.syllabify(notes, ["voice"], ["t"], "text", "hyphen", frozenset({"christmas", "river"}), lexicon).orderBy("t").collect()
    sung = [None if r["syllable"] is None else ("".join(r["syllable"]["onset"]), r["syllable"]["nucleus"], "".join(r["syllable"]["coda"])) for r in out]
    assert sung == [("r", "I", ""), ("v", "@", ""), None, ("l", "A", ""), ("l", "A", ""), ("", "@", "n"), ("kr", "I", "s"), ("m", "@", "s")] or sung[5][1] == "@"
    assert [e["nucleus"] for e in out[5]["extra"]] == ["I"] and not out[0]["extra"]


def plain_segments(units):
    """The rules, on a list of time slots of 0.1 ms that later sounds overwrite from their start on."""
    out = []
    for name, a, b in units:
        if b - a < 0.005:
            continue
        while out and out[-1][2] > a:
            last = out.pop()
            if a - last[1] >= 0.005:
                out.append((last[0], last[1], a))
            break
        if out and a > out[-1][2] + 1e-6:
            out.append(("SP", out[-1][2], a))
        out.append((name, a, b))
    return out


def test_phrase_segments(spark):
    rng = np.random.default_rng(3)
    rows = []
    for phrase in range(40):
        t = 1.0
        for k in range(rng.integers(1, 6)):
            length = float(rng.uniform(0.05, 1.2))
            onset = [str(x) for x in rng.choice(["b", "s", "m", "t"], rng.integers(0, 3))]
            coda = [str(x) for x in rng.choice(["n", "l", "k"], rng.integers(0, 2))]
            rows.append((phrase, k, onset, [float(x) for x in rng.uniform(0.003, 0.1, len(onset))], str(rng.choice(["aa", "ay", "ow"])), coda, [float(x) for x in rng.uniform(0.003, 0.1, len(coda))], t, t + length, 0.2))
            t += length + float(rng.choice([0.0, 0.01, 0.4]))
    units = spark.createDataFrame(rows, "p int, k int, onset array<string>, on_d array<double>, vowel string, coda array<string>, co_d array<double>, t double, `end` double, t0 double")
    found = {}
    for r in singing.phrase_segments(units, ["p"], ["k"]).orderBy("p", "seq").collect():
        found.setdefault(r["p"], []).append((r["phone"], r["start"], r["end"]))
    closure = {c: s for cs, s in CLOSURES for c in cs}
    for p in range(40):
        mine = [r[2:] for r in rows if r[0] == p]
        start = mine[0][5] - sum(mine[0][1])
        raw = [("SP", 0.2, start - 0.2), ("AP", start - 0.2, start)] if start - 0.2 > 0.3 else [("SP", 0.2, start)]
        for i, (onset, on_d, vowel, coda, co_d, t, end, _) in enumerate(mine):
            at = t - sum(on_d)
            for j, (c, d) in enumerate(zip(onset, on_d, strict=True)):
                now = plain_segments(raw)
                if j == 0 and c in closure and now and now[-1][0] not in ("SP", "AP"):
                    raw.append(("SP", at - min(closure[c], 0.4 * (now[-1][2] - now[-1][1])), at))
                raw.append((ONSET_TOKENS.get(c, c), at, at + d))
                at += d
            close = i + 1 < len(mine) and mine[i + 1][5] - end < 0.02
            stop = max(t + 0.03, (mine[i + 1][5] - sum(mine[i + 1][1]) if close else end - min(0.04, 0.1 * (end - t))) - sum(co_d))
            if vowel in GLIDES and stop - t > 0.5:
                g = min(0.11 if coda else 0.16, max(0.08, 0.15 * (stop - t)))
                raw += [(GLIDES[vowel][0], t, stop - g), (GLIDES[vowel][1], stop - g, stop)]
            else:
                raw.append((vowel, t, stop))
            for c, d in zip(coda, co_d, strict=True):
                raw.append((c, stop, stop + d))
                stop += d
        want = plain_segments(raw)
        assert [x[0] for x in found[p]] == [x[0] for x in want] and np.allclose([x[1:] for x in found[p]], [x[1:] for x in want]), p


def test_pitch_points(spark):
    pts = singing.pitch_points([(0.0, 1.0, 69.0), (1.0, 0.3, 71.0)], 0.05, 1.3, seed=4)
    assert pts == singing.pitch_points([(0.0, 1.0, 69.0), (1.0, 0.3, 71.0)], 0.05, 1.3, seed=4)
    assert pts[0] == (0.05, pytest.approx(440 * 2 ** (-0.35 / 12))) and pts[1] == (pytest.approx(0.095), pytest.approx(440)) and pts[-1] == (1.3, pytest.approx(440 * 2 ** (2 / 12)))
    middle = [f for t, f in pts if 0.4 < t < 0.95]
    assert len(middle) > 15 and all(abs(12 * math.log2(f / 440)) < 0.35 for f in middle)
    df = spark.createDataFrame([([(0.0, 1.0, 69.0), (1.0, 0.3, 71.0)], 0.05, 1.3, 4)], "ns array<struct<t:double,dur:double,midi:double>>, a double, b double, s int")
    assert [tuple(p) for p in df.select(singing.pitch_column(F.col("ns"), F.col("a"), F.col("b"), F.col("s")).alias("p")).first()["p"]] == pts


def test_pho_text_and_its_pitch(spark):
    rows = [("v", 0, "A", 0.0, 0.5, [(0.0, 220.0), (0.25, 230.0), (0.5, 240.0)]), ("v", 1, "s", 0.5, 0.6, []), ("v", 2, "A", 0.7, 3.5, [(0.7, 200.0), (3.5, 300.0)])]
    segments = spark.createDataFrame(rows, "v string, k int, phone string, start double, `end` double, pts array<struct<t:double,hz:double>>")
    out = singing.pho_lines(segments, ["v"], ["k"], "pts", ["A"]).orderBy("k", "piece", "line")
    lines = [r["text"] for r in out.collect()]
    assert lines[0].startswith("A 70 0.0 220.0 100.0 ") and lines[3] == "s 100 " and lines[4] == "_ 100" and sum(int(x.split()[1]) for x in lines) == 3500
    assert [int(x.split()[1]) for x in lines[5:]] == [70, 887, 886, 887, 70]
    hz = {r["frame_idx"]: r["hz"] for r in singing.pho_pitch(out, ["v"], ["k", "piece", "line"], "text", 0.05).collect()}
    assert hz[2] == pytest.approx(224, abs=0.5) and hz[12] == 0.0 and hz[42] == pytest.approx(250, abs=1) and len(hz) == 71


def test_singers_and_rendering(spark):
    table = singing.singer_table(3, 5)
    assert table[0] == (0, 0.0, 0.0, pytest.approx(1 / math.sqrt(1.98))) and 6 <= table[1][1] <= 12 and -12 <= table[2][1] <= -6 and all(0.025 <= r[2] <= 0.045 for r in table[1:])
    segments = spark.createDataFrame([("a", 0, "x", 0.0, 0.5), ("a", 1, "y", 0.5, 1.0), ("b", 0, "z", 0.0, 0.25)], "p string, k int, phone string, start double, `end` double")
    out = singing.render(segments, ["p"], ["k"], lambda segs, rate: np.full(int(segs[-1][2] * rate), len(segs)), rate=100)
    assert {(r["p"], r["n"], r["v"]) for r in out.groupBy("p").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()} == {("a", 100, 2.0), ("b", 25, 1.0)}
    units = spark.createDataFrame([(["b", "r"],)], "ph array<string>")
    assert singing.predicted_seconds(units, "ph").first()["predicted"] == [0.07, 0.07]
    assert singing.predicted_seconds(units, "ph", lambda rows: [[0.1 * len(r)] * len(r) for r in rows]).first()["predicted"] == [0.2, 0.2]
    assert sorted(r["phone"] for r in singing.self_joining(spark, lambda p: p in ("m", "i"), ["m", "i", "n"]).collect()) == ["i", "m"]


def test_limiter_of_rows_equals_that_of_arrays(spark):
    x = np.random.default_rng(2).standard_normal(3000) * 2
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "t string, i long, v double")
    out = [r["limited"] for r in signal.limit_peaks(df, ["t"], "i", "v", 4000).orderBy("i").collect()]
    assert np.allclose(out, signal.limiter(x, 4000))


def test_resample():
    t = np.arange(1600) / 1600
    x = np.sin(2 * np.pi * 20 * t)
    y = signal.resample(x, 441, 160)
    assert len(y) == 4410 and np.abs(y[200:-200] - np.sin(2 * np.pi * 20 * np.arange(4410) / 4410)[200:-200]).max() < 5e-3
    assert len(signal.resample(x, 1, 2)) == 800 and len(signal.resample(x[:0], 3, 2)) == 0 and (signal.resample(x, 2, 2) == x).all()


def test_whole_note_groups_and_time_signatures(spark):
    heads = spark.createDataFrame([("s", 0, 10.0, 5.0), ("s", 1, 17.0, 5.0), ("s", 2, 18.5, 5.0)], "s string, ord long, x0 double, space double")
    assert [r["cluster"] for r in pages.whole_note_groups(heads, ["s"]).orderBy("ord").collect()] == [0, 0, 1]


def test_mixdown_equals_arrays(spark):
    from tidemark.plans import mixdown

    rng, rate = np.random.default_rng(8), 2000
    x = {"S": rng.standard_normal(4000) * 0.3, "B": rng.standard_normal(3500) * 0.1}
    samples = spark.createDataFrame([(p, i, float(v)) for p, xs in x.items() for i, v in enumerate(xs)], "part string, idx long, value double")
    parts = spark.createDataFrame([("S", 0), ("B", 1)], "part string, ord int")
    beats = spark.createDataFrame([(0.0, 2), (0.5, 1), (1.99, 0)], "t double, level int")
    for focus in (None, "B"):
        out = mixdown.mixdown(samples, parts, beats, focus, rate).orderBy("idx").collect()
        stereo = np.zeros((2, 4000))
        for i, (p, xs) in enumerate(x.items()):
            y = np.zeros(4000)
            y[: len(xs)] = xs * 0.2 / np.sqrt(np.mean(xs[np.abs(xs) > 1e-3] ** 2))
            angle = (-0.7 + 1.4 * i + 1) * np.pi / 4
            gains = (np.cos(angle), np.sin(angle)) if focus is None else (1.2, 0.0) if p == focus else (0.0, 0.1)
            stereo += np.outer(gains, y)
        response = signal.reverb_response(rate)
        stereo += 0.07 * np.stack([np.convolve(stereo[c], response[c])[:4000] for c in range(2)])
        clicks = np.zeros(4000)
        for t, (freq, length, gain) in ((0.0, (1760, 0.035, 1.0)), (0.5, (1320, 0.035, 0.8)), (1.99, (1100, 0.025, 0.45))):
            c = signal.click(rate, freq, length) * gain
            k = min(len(c), 4000 - int(t * rate))
            clicks[int(t * rate) : int(t * rate) + k] += c[:k]
        stereo += 0.35 * np.outer((1, 1) if focus is None else (0, 1.3), clicks)
        active = np.abs(stereo).max(axis=0) > 0.01 * np.abs(stereo).max()
        stereo *= 0.2 / max(np.sqrt(np.mean(stereo[c, active] ** 2)) for c in range(2))
        level = np.abs(stereo).max(axis=0)
        gain = np.minimum(1, 0.93 / np.maximum(signal.sliding_reflect(level, 21, "max"), 1e-9))
        gain = signal.sliding_reflect(signal.sliding_reflect(gain, 160, "min"), 20, "mean")
        want = np.clip(stereo * gain, -0.93, 0.93)
        assert np.allclose([[r["left"] for r in out], [r["right"] for r in out]], want, atol=1e-6)
    assert mixdown.mixdown(samples.limit(0), parts).collect() == []


def test_performance_is_sung(spark):
    from tidemark.plans import performance, voices

    bars = spark.createDataFrame([("s", 0, 0.0, 4.0, True, True, 2)], "score_id string, idx int, start double, length double, repeat_start boolean, repeat_end boolean, repeat_times int")
    played = performance.performed_measures(bars, spark.createDataFrame([("s", 0.0, 60.0)], "score_id string, start double, qpm double"))
    schema = "score_id string, part string, voice int, start double, dur double, midi int, lyrics map<int,struct<text:string,hyphen_after:boolean>>, measure int"
    notes = spark.createDataFrame([("s", "T", 1, 0.0, 1.0, 60, {1: ("ri", True), 2: ("la", False)}, 0), ("s", "T", 1, 1.0, 1.0, 62, {1: ("ver", False)}, 0), ("s", "T", 1, 2.0, 1.0, 62, None, 0), ("s", "T", 1, 3.0, 1.0, 64, None, 0)], schema)
    lexicon = spark.createDataFrame([("river", "en-us", "ˈɹɪvə"), ("ver", "en-us", "vɜː")], "word string, lang string, ipa string")
    out = voices.sung_notes(performance.performed_notes(notes, played), frozenset({"river", "ver"}), lexicon).orderBy("t").collect()
    sung = [None if r["syllable"] is None else "".join(r["syllable"]["onset"]) + r["syllable"]["nucleus"] for r in out]
    assert sung == ["rI", "v@", "vr=", None, "lA", "vr=", "vr=", None]
