"""A hand-made page of two systems to a score, and the score to MusicXML and a performance."""

import xml.etree.ElementTree as ET

import pytest

from tidemark.plans import musicxml, performance, score, voices
from tidemark.sources import landing

SPACE = 5.0


class Page:
    """Draws symbols into landing tables, ``dy`` lower than asked for."""

    def __init__(self):
        self.t = {n: [] for n in ("glyphs", "words", "lines", "beams", "curves")}
        self.dy = 0.0

    def add(self, table, *row):
        self.t[table].append(("s", len(self.t[table]), 0, *row))

    def glyph(self, ch, x, y, width=6.0, font="OpusStd", size=20.0):
        self.add("glyphs", font, ch, float(x), float(y + self.dy), float(x), float(x + width), size)

    def word(self, text, x, y, size=10.0, font="Times", width=None):
        self.add("words", text, float(x), float(x + (width or 5 * len(text))), float(y + self.dy), size, font)

    def line(self, x0, y0, x1, y1, width):
        self.add("lines", float(x0), float(y0 + self.dy), float(x1), float(y1 + self.dy), width)

    def note(self, ch, x, y, up=True):
        self.glyph(ch, x, y)
        if up:
            self.line(x + 5.5, y - 17, x + 5.5, y - 1, 0.4)
        else:
            self.line(x + 0.5, y + 1, x + 0.5, y + 17, 0.4)

    def system(self):
        for top in (100, 160):
            for k in range(5):
                self.line(50, top + k * SPACE, 400, top + k * SPACE, 0.5)
            for x in (220, 400):
                self.line(x, top, x, top + 20, 0.8)
        self.line(50, 100, 50, 180, 0.6)
        self.glyph("&", 55, 115)
        self.glyph("?", 55, 165)

    def tables(self, spark):
        return {n: spark.createDataFrame(rows, landing.SCHEMAS[n]) for n, rows in self.t.items()}


def drawn():
    p = Page()
    p.word("My", 150, 30, 24.0)
    p.word("Song", 190, 30, 24.0)
    p.system()
    p.word("Soprano", 10, 114)
    p.word("Bass", 10, 174)
    for y in (105, 115):
        p.glyph("4", 80, y)
    p.glyph("q", 60, 90, font="OpusTextStd")
    p.word("=", 66, 90, width=4)
    p.word("120", 72, 90, width=12)
    # quarters with a sharp that lasts to the barline, then a whole note; below them halves and a bar rest
    p.note("œ", 100, 120)
    p.glyph("#", 122, 117.5, 5.0)
    p.note("œ", 130, 117.5)
    p.note("œ", 160, 117.5)
    p.note("œ", 190, 115)
    p.glyph("w", 240, 117.5)
    p.note("˙", 100, 170)
    p.note("˙", 160, 172.5)
    p.glyph("∑", 300, 165)
    for text, x in (("ri", 100), ("-", 116), ("ver", 128), ("a", 160), ("song", 190)):
        p.word(text, x, 135, width=8)
    # a tie over the barline, eighths by a beam, a dot; names are those of the system before
    p.dy = 200.0
    p.system()
    p.note("˙", 100, 120)
    p.note("˙", 160, 120)
    p.add("curves", 167.0, 321.0, 238.0, 326.0)
    p.note("˙", 240, 120)
    p.glyph("™", 248, 118, 1.0, "OpusSpecialStd")
    p.note("œ", 290, 115)
    p.note("œ", 310, 115)
    p.add("beams", [(295.0, 297.0), (316.0, 297.0), (316.0, 299.0), (295.0, 299.0)], 295.0, 316.0)
    p.glyph("w", 100, 170)
    p.glyph("w", 240, 165)
    for text, x in (("one", 100), ("two", 160)):
        p.word(text, x, 135, width=8)
    return p


@pytest.fixture(scope="module")
def result(spark):
    tables = {n: df.cache() for n, df in drawn().tables(spark).items()}
    found = score.read_score(tables)
    return {n: df.collect() for n, df in found.items()}, found


def test_layout(result):
    rows, _ = result
    assert [(r["score_id"], r["title"]) for r in rows["scores"]] == [("s", "My Song")]
    assert [(r["part"], r["ord"]) for r in sorted(rows["parts"], key=lambda r: r["ord"])] == [("Soprano", 0), ("Bass", 1)]
    bars = sorted(rows["measures"], key=lambda r: r["idx"])
    assert [(r["idx"], r["number"], r["start"], r["length"], r["num"], r["den"]) for r in bars] == [(0, 1, 0.0, 4.0, 4, 4), (1, 2, 4.0, 4.0, 4, 4), (2, 3, 8.0, 4.0, 4, 4), (3, 4, 12.0, 4.0, 4, 4)]
    assert [(r["start"], r["qpm"]) for r in rows["tempos"]] == [(0.0, 120.0)]
    assert rows["warnings"] == []


def test_notes(result):
    rows, _ = result
    notes = sorted(rows["notes"], key=lambda r: (r["part"], r["start"]))
    assert [(r["start"], r["dur"], r["midi"]) for r in notes if r["part"] == "Soprano"] == [(0.0, 1.0, 64), (1.0, 1.0, 66), (2.0, 1.0, 66), (3.0, 1.0, 67), (4.0, 4.0, 65), (8.0, 2.0, 64), (10.0, 5.0, 64), (15.0, 0.5, 67), (15.5, 0.5, 67)]
    assert [(r["start"], r["dur"], r["midi"]) for r in notes if r["part"] == "Bass"] == [(0.0, 2.0, 50), (2.0, 2.0, 48), (8.0, 4.0, 50), (12.0, 4.0, 53)]
    words = {r["start"]: {v: (s["text"], s["hyphen_after"]) for v, s in r["lyrics"].items()} for r in notes if r["part"] == "Soprano" and r["lyrics"]}
    assert words == {0.0: {1: ("ri", True)}, 1.0: {1: ("ver", False)}, 2.0: {1: ("a", False)}, 3.0: {1: ("song", False)}, 8.0: {1: ("one", False)}, 10.0: {1: ("two", False)}}


def test_musicxml_of_the_score(result, spark):
    _, found = result
    text = musicxml.score_xml(found["scores"], found["notes"], found["measures"], found["parts"], found["tempos"]).first()["xml"]
    root = ET.fromstring(text.split("\n", 2)[2])
    assert root.findtext("work/work-title") == "My Song" and [p.findtext("part-name") for p in root.iter("score-part")] == ["Soprano", "Bass"]
    soprano, bass = root.findall("part")
    assert [m.get("number") for m in soprano.findall("measure")] == ["1", "2", "3", "4"]
    first = soprano.find("measure")
    assert first.find("direction/sound").get("tempo") == "120" and first.findtext("attributes/clef/sign") == "G" and bass.findtext("measure/attributes/clef/sign") == "F"
    assert [n.findtext("pitch/step") + (n.findtext("pitch/alter") or "") for n in first.findall("note")] == ["E", "F1", "F1", "G"]
    assert [(n.findtext("lyric/syllabic"), n.findtext("lyric/text")) for n in first.findall("note")] == [("begin", "ri"), ("end", "ver"), ("single", "a"), ("single", "song")]
    third, fourth = soprano.findall("measure")[2:]
    assert [[t.get("type") for t in n.findall("tie")] for n in third.findall("note")] == [[], ["start"]] and [[t.get("type") for t in n.findall("tie")] for n in fourth.findall("note")] == [["stop"], [], []]
    assert [(n.findtext("type"), len(n.findall("dot"))) for n in fourth.findall("note")] == [("half", 1), ("eighth", 0), ("eighth", 0)]
    rest = bass.findall("measure")[1].find("note")
    assert rest.find("rest") is not None and rest.findtext("duration") == "192"
    assert fourth.findtext("barline/bar-style") == "light-heavy"


def test_performance_of_the_score(result):
    _, found = result
    played = performance.performed_measures(found["measures"], found["tempos"])
    out = [r for r in performance.performed_notes(found["notes"], played).collect() if r["part"] == "Soprano"]
    assert sorted((r["t"], r["sung"]) for r in out)[:4] == [(0.0, "ri"), (0.5, "ver"), (1.0, "a"), (1.5, "song")]


def shared_page(spark):
    """A staff of two parts with two voices, one of which leaves out a rest, an abbreviated name on the second system, a triplet, a pickup bar and a repeat."""
    p = Page()

    def staff(dy, name):
        p.dy = dy
        for k in range(5):
            p.line(50, 100 + 5 * k, 400, 100 + 5 * k, 0.5)
        p.line(50, 100, 50, 120, 0.6)
        p.glyph("?", 55, 105)
        p.word(name, 5, 114, width=35)
        for x in (130, 400):
            p.line(x, 100, x, 120, 0.8)

    staff(0.0, "Bariton/Bass")
    for y in (105, 115):
        p.glyph("4", 80, y)
    p.note("œ", 100, 115, up=True)  # the pickup
    # upper voice: four quarters; lower voice: a half that stands under the third, the rest before it is not printed
    for x, y in ((150, 105), (200, 107.5), (250, 110), (300, 112.5)):
        p.note("œ", x, y, up=True)
    p.note("˙", 250, 120, up=False)
    p.word("hey", 150, 135, width=10)
    staff(200.0, "Bar./B.")
    p.line(56, 100, 56, 120, 2.0)
    p.glyph("™", 59, 110, 1.0, "OpusSpecialStd")
    for x in (70, 85, 100):
        p.note("œ", x, 110, up=True)
    p.word("3", 84, 85, 8.0, "TimesItalic", 4)
    p.note("˙", 115, 110, up=True)
    p.note("˙", 200, 110, up=True)
    p.note("˙", 300, 110, up=True)
    p.line(396, 100, 396, 120, 2.0)
    p.glyph("™", 391, 110, 1.0, "OpusSpecialStd")
    p.word("3x", 200, 80, width=10)
    return {n: df.cache() for n, df in p.tables(spark).items()}


def test_shared_staff(spark):
    found = score.read_score(shared_page(spark))
    parts = [(r["part"], r["display_name"]) for r in found["parts"].orderBy("ord").collect()]
    assert parts == [("Bar.", "Bariton"), ("B.", "Bass")]
    bars = [(r["number"], r["start"], r["length"], r["repeat_start"], r["repeat_end"], r["repeat_times"]) for r in found["measures"].orderBy("idx").collect()]
    assert bars[:2] == [(0, 0.0, 1.0, False, False, 2), (1, 1.0, 4.0, False, False, 2)] and bars[2][3] and bars[3][4] and bars[3][5] == 3
    notes = {}
    for r in found["notes"].orderBy("start").collect():
        notes.setdefault(r["part"], []).append((round(r["start"], 6), round(r["dur"], 6), r["midi"], {v: s["text"] for v, s in (r["lyrics"] or {}).items()}))
    upper, lower = notes["Bar."], notes["B."]
    assert [n[:2] for n in upper[:5]] == [(0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0)] and upper[1][3] == {1: "hey"}
    # the lower part sings the upper voice's notes where it has none itself, and its own half at the time of the chord above it
    assert [n[:2] for n in lower[:4]] == [(0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (3.0, 2.0)] and lower[3][2] < upper[3][2] and lower[1][3] == {1: "hey"}
    assert [n[1] for n in upper[5:8]] == [pytest.approx(2 / 3, abs=1e-6)] * 3 and upper[8][:2] == (7.0, 2.0)
    played = performance.performed_measures(found["measures"], found["tempos"])
    assert [r["pass"] for r in played.orderBy("position").collect()] == [1, 1, 1, 1, 2, 2, 3, 3]


def test_raw_pages(spark):
    chars = [("s", 0, i, 0, "ABC+Opus", c, 10.0 + i, 5.0, 10.0 + i, 11.0 + i, 20.0) for i, c in enumerate("\uf026 ")] + [("s", 0, 10 + i, 1, "Times", c, 20.0 + i, 6.0, 20.0 + i, 21.0 + i, 9.0) for i, c in enumerate("ab  c")]
    glyphs, words = landing.land_characters(spark.createDataFrame(chars, "score_id string, page int, ord long, span int, font string, c string, x double, y double, x0 double, x1 double, size double"))
    assert [(r["font"], r["ch"]) for r in glyphs.collect()] == [("OpusStd", "&")] and glyphs.columns == landing.SCHEMAS["glyphs"].replace(" string", "").replace(" long", "").replace(" int", "").replace(" double", "").split(", ")
    assert [(r["text"], r["x0"], r["x1"], r["ord"]) for r in words.orderBy("ord").collect()] == [("ab", 20.0, 22.0, 10), ("c", 24.0, 25.0, 14)]
    item = lambda op, *xy: (op, *map(float, xy))
    rows = [("s", 0, 0, "s", 0.5, [item("l", 5, 9, 5, 2)], (5.0, 2.0, 5.0, 9.0)), ("s", 0, 1, "f", None, [item("l", 0, 0, 4, 0), item("l", 4, 0, 4, 1), item("l", 4, 1, 0, 1)], (0.0, 0.0, 4.0, 1.0)), ("s", 0, 2, "fs", None, [item("c", 0, 0, 4, 0), item("l", 4, 0, 0, 0)], (0.0, -1.0, 4.0, 0.0)), ("s", 0, 3, "s", 1.0, [item("l", 0, 0, 1, 1), item("l", 1, 1, 2, 2)], (0.0, 0.0, 2.0, 2.0))]
    drawn_ = spark.createDataFrame(rows, "score_id string, page int, ord long, kind string, width double, items array<struct<op:string,x0:double,y0:double,x1:double,y1:double>>, box struct<x0:double,y0:double,x1:double,y1:double>")
    lines, beams, curves = (x.collect() for x in landing.land_drawings(drawn_))
    assert [(r["y0"], r["y1"], r["width"]) for r in lines] == [(2.0, 9.0, 0.5)] and [(len(r["pts"]), r["x0"], r["x1"]) for r in beams] == [(3, 0.0, 4.0)] and [(r["ord"], r["y0"]) for r in curves] == [(2, -1.0)]


def test_voices_to_sounds(spark):
    syl = lambda on, n, co: (on, n, co)
    rows = [("s", "T", 1, 0.0, 0.5, 60, syl(["d"], "u", []), []), ("s", "T", 1, 0.5, 0.5, 62, None, None), ("s", "T", 1, 1.0, 1.0, 64, syl(["s"], "I", ["N"]), []), ("s", "T", 1, 3.0, 1.0, 64, syl([], "@", ["n"]), [syl(["s"], "I", ["N"])])]
    kind = "struct<onset:array<string>,nucleus:string,coda:array<string>>"
    notes = spark.createDataFrame(rows, f"score_id string, part string, voice int, t double, dur double, midi int, syllable {kind}, extra array<{kind}>")
    groups = voices.sung_groups(notes).orderBy("grp").collect()
    assert [(g["start"], g["end"], len(g["notes"])) for g in groups] == [(0.0, 1.0, 2), (1.0, 2.0, 1), (3.0, 4.0, 1)]
    sounds = voices.sung_sounds(notes).orderBy("grp", "sub", "at", "slot").collect()
    assert [s["phone"] for s in sounds] == ["d", "u", "s", "I", "N", "_", "@", "n", "s", "I", "N"]
    for a, b in zip(sounds, sounds[1:], strict=False):
        assert a["end"] == pytest.approx(b["start"], abs=1e-9)
    assert sounds[2]["start"] == pytest.approx(1 - 0.55 * 0.09) and sounds[4]["end"] - sounds[4]["start"] == pytest.approx(0.16) and sounds[1]["points"][-1]["hz"] == pytest.approx(440 * 2 ** (-7 / 12))
    text = voices.pho_text(voices.sung_sounds(notes), 4.5).first()["text"].splitlines()
    assert text[0] == "_ 20" and sum(int(x.split()[1]) for x in text[1:]) == 4700
    segments = voices.neural_segments(notes).orderBy("phrase", "seq").collect()
    by_phrase = {}
    for s in segments:
        by_phrase.setdefault(s["phrase"], []).append(s)
    assert [s["phone"] for s in by_phrase[0]] == ["SP", "AP", "de/d", "uw", "s", "ih", "ng"] and all(a["end"] == pytest.approx(b["start"]) for p in by_phrase.values() for a, b in zip(p, p[1:], strict=False))


def test_command(spark, tmp_path):
    from tidemark.__main__ import main

    for name, df in drawn().tables(spark).items():
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    main([f"{tmp_path}/in", f"{tmp_path}/out", "--tempo", "8=120", "--part", "bass"])
    assert [r["qpm"] for r in spark.read.parquet(f"{tmp_path}/out/tempos").collect()] == [60.0]
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/musicxml").collect())
    assert "<part-name>Bass</part-name>" in text and "Soprano" not in text
