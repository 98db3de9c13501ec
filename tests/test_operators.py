"""Operators against walks written for the tests, and cases worked out by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import phonetics, scalars, text
from tidemark.operators import aggregates, joins, ordered, signal, structure


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_gap_islands(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.2, 2.0), (1, 2.4, 3.0), (2, 5.0, 6.0)], "k int, a double, b double")
    rows = ordered.gap_islands(df, ["k"], ["a"], F.col("a"), F.col("b"), 0.3).orderBy("k", "a").collect()
    assert [r["island"] for r in rows] == [0, 0, 1, 0]


def walk(bars):
    order, i, start, passes = [], 0, 0, {}
    while i < len(bars):
        opens, closes, times = bars[i]
        if opens:
            start = i
        p = passes.get(start, 1)
        order.append((i, p))
        if closes and p < times:
            passes[start] = p + 1
            i = start
            continue
        if closes:
            start = i + 1
        i += 1
    return order


def test_repeats_equal_a_walk(spark):
    rnd, rows, want = random.Random(3), [], {}
    for k in range(60):
        bars = [(rnd.random() < 0.3, rnd.random() < 0.3, rnd.randint(1, 3)) for _ in range(rnd.randint(1, 8))]
        rows += [(k, i, *b) for i, b in enumerate(bars)]
        want[k] = walk(bars)
    df = spark.createDataFrame(rows, "k int, i int, o boolean, c boolean, t int")
    got = {}
    for r in ordered.unroll_repeats(df, ["k"], ["i"], "o", "c", "t").orderBy("k", "position").collect():
        got.setdefault(r["k"], []).append((r["i"], r["pass"]))
    assert got == want


def test_ties_merge_only_without_a_lyric(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0, 60, True, None), (1, 2.0, 2.0, 60, False, None), (2, 0.0, 2.0, 60, True, None), (2, 2.0, 2.0, 60, False, "la")], "k int, s double, d double, m int, tie boolean, l string")
    out = ordered.merge_ties(df, ["k"], ["s"], "tie", ["m"], "s", "d", F.col("l").isNotNull()).orderBy("k", "s").collect()
    assert [(r["k"], r["d"]) for r in out] == [(1, 4.0), (2, 2.0), (2, 2.0)]


def test_anchored_clusters(spark):
    xs = [0.0, 1.0, 1.5, 1.7, 3.0, 3.2]
    df = spark.createDataFrame([(1, x) for x in xs], "k int, x double")
    assert [r["cluster"] for r in ordered.anchored_clusters(df, ["k"], ["x"], "x", 1.6).orderBy("x").collect()] == [0, 0, 0, 1, 1, 1]


def test_words_continue(spark):
    rows = [(1, 0.0, 1.0, 60, "glo", True), (1, 1.0, 1.0, 62, "ria", False), (1, 2.0, 1.0, 64, None, None), (1, 3.5, 1.0, 65, None, None), (1, 4.5, 1.0, 65, None, None)]
    df = spark.createDataFrame(rows, "k int, t double, d double, m int, x string, h boolean")
    out = ordered.continue_words(df, ["k"], ["t"], "x", "h", "t", "d", "m").orderBy("t").collect()
    assert [r["sung"] for r in out] == ["glo", "ria", None, "ria", "ria"]
    assert [r["word"] for r in out][:3] == [0, 0, 1]


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "k int, id int, t double")
    right = spark.createDataFrame([(1, 1.0, 10), (1, 3.0, 30), (2, 0.0, 99)], "k int, t double, v int")
    assert [r["v"] for r in joins.asof(left, right, ["k"], "t", ["v"], ["v"]).orderBy("id").collect()] == [None, 10, 10, 30, 30, 30]
    assert [r["v"] for r in joins.asof(left, right, ["k"], "t", ["v"], ["v"], strict=True).orderBy("id").collect()] == [None, None, 10, 10, 30, 30]
    assert [r["v"] for r in joins.asof(left, right, ["k"], "t", ["v"], ["v"], default_first=True).orderBy("id").collect()][0] == 10
    assert [r["v"] for r in joins.nearest(left, right, ["k"], "t", "id", ["v"], "v").orderBy("id").collect()] == [10, 10, 10, 30, 30, 30]


def test_interval_joins_equal_all_pairs(spark):
    rnd = random.Random(5)
    a = [(1, i, float(s), float(s + rnd.randint(1, 30))) for i, s in enumerate(rnd.sample(range(300), 60))]
    b = [(1, i, float(s), float(s + rnd.randint(1, 30))) for i, s in enumerate(rnd.sample(range(300), 60))]
    left, right = spark.createDataFrame(a, "k int, lid int, l_start double, l_end double"), spark.createDataFrame(b, "k int, rid int, r_start double, r_end double")
    want = {(x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3]}
    got = [(r["lid"], r["rid"]) for r in joins.interval_overlap(left, right, ["k"], 16.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    anti = {r["lid"] for r in joins.interval_overlap(left, right, ["k"], 16.0, how="left_anti").collect()}
    assert anti == {x[1] for x in a} - {p for p, _ in want}


def test_greedy_claims_depend_on_order(spark):
    left = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 5.0)], "k int, a int, x double")
    right = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.4)], "k int, b int, y double")
    out = joins.greedy_claim(left, right, ["k"], "a", "b", lambda p, q: abs(p["x"] - q["y"]) < 0.5).collect()
    assert sorted((r["a"], r["b"]) for r in out) == [(1, 1), (2, 2)]


def test_mode_and_upper_median(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 3, 1, 1, 2])], "k int, o int, v int")
    assert aggregates.mode_first_seen(df, ["k"], "v", "o").first()["v"] == 3
    df = spark.createDataFrame([(1, v) for v in (50, 60, 70, 80)], "k int, v int")
    assert aggregates.upper_median(df, ["k"], "v").first()["upper_median"] == 70


def test_scalars(spark):
    r = one(
        spark, a=scalars.midi_hz(F.lit(57)), d1=scalars.chord_duration(F.lit(1.0), F.lit(1), F.lit(1), F.lit(1.0)), d2=scalars.chord_duration(F.lit(1.0), F.lit(1), F.lit(0), F.lit(2 / 3)), c=scalars.beat_unit(F.lit(6), F.lit(8)), s=scalars.spelling(F.lit(61), F.lit(-1)),
        t1=scalars.tempo_spec(F.lit("8=116")), t2=scalars.tempo_spec(F.lit("4.=39")), t3=scalars.tempo_spec(F.lit("72")), t4=scalars.tempo_spec(F.lit("x")), split=scalars.split_duration(F.lit(60), [48, 36, 24, 18, 12, 6, 3]), v=scalars.voice_kind(F.lit("X"), F.lit(70)),
        y=scalars.beam_y_range(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 2), (0, 2))]), F.lit(5.0)), g=scalars.staff_geometry(F.array(*[F.lit(float(x)) for x in (0, 5, 10, 15, 20)])),
    )
    assert r["a"] == pytest.approx(220) and r["d1"] == pytest.approx(0.75) and r["d2"] == pytest.approx(1 / 3)
    assert tuple(r["c"]) == (1.5, 2) and tuple(r["s"]) == ("D", -1, 4)
    assert tuple(r["t1"]) == (58.0, 0.5) and tuple(r["t2"]) == (58.5, 1.5) and tuple(r["t3"]) == (72.0, None) and r["t4"] is None
    assert r["split"] == [48, 12] and r["v"] == "soprano" and tuple(r["y"]) == (0.0, 2.0) and tuple(r["g"]) == (0.0, 20.0, 5.0, 10.0)


def test_text(spark):
    r = one(
        spark, g=text.split_glued(F.lit('say;"throw')), e=text.split_glued(F.lit("")), c=text.clean_word(F.lit("-Ich’s, ﬁn!")), x=text.escape_xml(F.lit("a<&>")), t=text.ordered_tokens(F.lit("tSr=x"), ["tS", "r=", "r", "t"]),
        ab=text.abbreviates(F.lit("T."), F.lit("Tenor")), no=text.abbreviates(F.lit("S./A."), F.lit("Soprano")), f=text.file_title(F.lit("A/b: c"), F.lit("z")),
        v1=text.verse_of_pass(F.create_map(F.lit(1), F.lit("la"), F.lit(2), F.lit("da")), F.lit(2)), v2=text.verse_of_pass(F.create_map(F.lit(1), F.lit("doo")), F.lit(2)), v3=text.verse_of_pass(F.create_map(F.lit(2), F.lit("da")), F.lit(1)),
    )
    assert (r["g"], r["e"], r["c"], r["x"], r["t"]) == ("say throw", "ah", "ich's fin", "a&lt;&amp;&gt;", ["tS", "r="])
    assert r["ab"] and not r["no"] and r["f"] == "Ab c" and (r["v1"], r["v2"], r["v3"]) == ("da", "doo", None)
    assert text.segment(["a", "way", "christ"], {"away", "a", "way", "christ"}.__contains__) == [2, 3]
    assert text.segment(["x", "y"], {"x"}.__contains__) == [2] and text.segment([], bool) == []
    assert phonetics.split_syllables(["r", "I", "v", "@"], 2, ["ri", "ver"]) == [(["r"], "I", []), (["v"], "@", [])]


def test_signal(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0)], "k int, x double, y double")
    grid = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 4.0, 12.0)], "k int, x double")
    assert [r["y"] for r in signal.interpolate(knots, grid, ["k"], "x", "y").orderBy("x").collect()] == [0.0, 0.0, 2.0, 5.0]
    rng = np.random.default_rng(1)
    x, h = rng.standard_normal(500), rng.standard_normal(40)
    assert np.allclose(signal.convolve(x, h), np.convolve(x, h))
    b, a = signal.shelf(16000, 250, 2, False)
    assert sum(b) / sum(a) == pytest.approx(10 ** (2 / 20))  # gain at zero frequency
    whole, _ = signal.biquad(x, b, a)
    first, state = signal.biquad(x[:200], b, a)
    assert np.allclose(whole, np.concatenate([first, signal.biquad(x[200:], b, a, state)[0]]))
    assert np.abs(signal.limiter(5 * x, 44100)).max() <= 0.93 + 1e-9
    response = signal.reverb_response(8000)
    assert response.shape == (2, 8800) and np.allclose((response**2).sum(axis=1), 1) and not response[:, : 160 - 9].any()
    frames = spark.createDataFrame([("t", i, [float(i)] * 4) for i in range(3)], "track string, frame_idx long, samples array<float>")
    assert signal.per_track(frames, np.cumsum).orderBy("frame_idx").collect()[-1]["samples"][-1] == 12.0


def test_music_characters_and_known_tokens(spark):
    df = spark.createDataFrame([("\uf041\uf0c4x", ["a", "q", "b"]), ("", []), (None, None)], "ch string, ps array<string>")
    got = df.select(text.music_char("ch").alias("c"), text.known_tokens(F.col("ps"), {"a": "AA", "b": "B"}).alias("t")).collect()
    assert [(r.c, r.t) for r in got] == [("A\u0192x", ["AA", "B"]), ("", []), (None, None)]


def test_even_picks_and_map_union(spark):
    df = spark.createDataFrame([(list(range(7)), {1: "a"}, {1: "b", 2: "c"}), ([1], None, {2: "c"}), ([], {1: "a"}, None)], "xs array<int>, a map<int,string>, b map<int,string>")
    got = df.select(scalars.even_picks(F.col("xs"), 3).alias("p"), scalars.map_union(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [([0, 2, 4], {1: "a", 2: "c"}), ([1], {2: "c"}), ([], {1: "a"})]


def test_chords_pickups_and_marks(spark):
    chords = spark.createDataFrame([(1, [60, 67, 64]), (2, []), (3, None)], "id int, ps array<int>")
    assert sorted(map(tuple, ordered.chord_voices(chords, "ps").collect())) == [(1, 60, 3), (1, 64, 2), (1, 67, 1)]
    rows = spark.createDataFrame([(1, 1, 1, None), (1, 2, 4, 1), (1, 3, 4, None), (2, 1, 4, None)], "k int, n int, len int, mark int")
    assert sorted((r.k, r.n) for r in ordered.pickup_numbers(rows, ["k"], ["n"], "n", F.col("len") < 4).collect()) == [(1, 0), (1, 1), (1, 2), (2, 1)]
    marked = ordered.persist_in_bar(rows, ["k"], ["n"], F.col("mark"), F.lit(0), "alter").orderBy("k", "n").collect()
    assert [r.alter for r in marked] == [0, 1, 1, 0]
    scaled = ordered.rescale_to_first(rows, ["k"], ["n"], "len", F.lit(2)).orderBy("k", "n").collect()
    assert [r.len for r in scaled] == [2.0, 8.0, 8.0, 2.0]


def test_keep_apart_is_not_transitive(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.8), ("a", 3, 1.6), ("b", 4, 0.5), ("a", 5, None)], "word string, k int, x double")
    rows = structure.keep_apart(df.where("x is not null"), ["word"], ["k"], "x", 1.0).collect()
    assert sorted(map(tuple, rows)) == [("a", 0.0), ("a", 1.6), ("b", 0.5)]


def test_fill_rests_leaves_overlaps_out(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.5, 4.0), (1, 3.0, 3.5), (2, 0.0, 4.0)], "bar int, s double, e double")
    rows = sorted(map(tuple, structure.fill_rests(df, ["bar"], ["s"], "s", "e", F.lit(4.0)).collect()))
    assert rows == [(1, 0.0, 1.0, True), (1, 1.0, 2.0, False), (1, 2.0, 3.0, True), (1, 3.0, 3.5, False), (1, 3.5, 4.0, True), (2, 0.0, 4.0, False)]


def test_share_budget_scales_a_coda_with_the_next_onset(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.2, 1.0), (1, 2, 0.2, 0.1, 0.2), (1, 3, 0.3, 0.1, 1.0)], "k int, i int, on_d double, co_d double, room double")
    rows = structure.share_budget(df, ["k"], ["i"], "on_d", "co_d", F.col("room")).orderBy("i").collect()
    assert [(round(r["on_d"], 6), round(r["co_d"], 6)) for r in rows] == [(0.5, 0.2), (0.2, 0.05), (0.15, 0.1)]


def test_pitch_errors_need_three_voiced_frames(spark):
    notes = spark.createDataFrame([(1, 1, 440.0, 0.0, 1.0), (1, 2, 440.0, 1.0, 1.0)], "k int, note int, target double, start double, dur double")
    frames = spark.createDataFrame([(1, t, hz) for t, hz in ((0.1, 100.0), (0.35, 880.0), (0.4, 880.0), (0.5, 870.0), (0.6, 0.0), (1.4, 440.0), (1.5, 440.0), (1.6, 0.0))], "k int, t double, hz double")
    rows = structure.pitch_errors(notes, frames, ["k"], "note", "target", 1.0).collect()
    assert [(r["note"], r["n"], round(r["cents"], 6)) for r in rows] == [(1, 3, 1200.0)]


def test_bar_lengths_and_empty_tables(spark):
    rows = [(1, 1, "a", 4.0), (1, 1, "b", 3.0), (1, 2, "a", 3.0), (1, 2, "b", 4.0), (1, 2, "c", 3.0), (1, 3, "a", 2.0)]
    df = spark.createDataFrame(rows, "k int, bar int, voice string, dur double")
    found = structure.bar_lengths(df, ["k"], "bar", "voice", "dur", F.lit(3.0)).orderBy("bar").collect()
    assert [r["length"] for r in found] == [4.0, 3.0, 2.0]
    assert structure.bar_lengths(df.limit(0), ["k"], "bar", "voice", "dur", F.lit(3.0)).isEmpty()
    assert structure.keep_apart(df.limit(0), ["k"], ["bar"], "dur", 1.0).isEmpty()


def test_interpolation_across_blocks_with_missing_knots(spark, tmp_path):
    from tidemark import queries

    ids = [3, 7, 6995, 6998, 7001, 7008, 21001, 21002, 35000, 35001]  # no 7000; no knot at all in the block from 21000
    rows = [(i, i * 10.0) for i in ids]
    spark.createDataFrame(rows, "event_id long, value double").selectExpr("event_id", "timestamp_ntz'2020-01-01' AS ts", "1L AS user_id", "'a' AS event_type", "value", "'' AS props").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, queries.interpolate_grid(spark, str(tmp_path)).collect()))
    import pytest

    assert [x for x, _ in got] == ids[1:]
    want = {7: 7, 35000: 35000, 35001: 35000}
    assert [y for _, y in got] == pytest.approx([1000.0 * want.get(i, i) for i in ids[1:]])


def test_blocks_of_the_axis_change_nothing(spark):
    """As-of, nearest and interpolation by blocks give what they give by whole keys; with null keys and places, ties, repeats and empty sides."""
    rnd = random.Random(11)
    at = lambda: rnd.choice([None, *[float(x) for x in range(60)]])
    left = spark.createDataFrame([(rnd.choice([None, 1, 2, 3]), at(), i) for i in range(150)] + [(1, 5.0, 999)] * 3, "k int, t double, l int")
    right = spark.createDataFrame([(rnd.choice([None, 1, 2]), at(), i) for i in range(40)], "k int, t double, r int")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for r in (right, right.limit(0)):
        for strict in (False, True):
            for first in (False, True):
                whole = joins.asof(left, r, ["k"], "t", ["r"], ["r"], strict, first)
                assert same(whole, joins.asof(left, r, ["k"], "t", ["r"], ["r"], strict, first, width=7.0)) and whole.count() == left.count()
        assert same(joins.nearest(left, r, ["k"], "t", "l", ["r"], "r"), joins.nearest(left, r, ["k"], "t", "l", ["r"], "r", width=4.0))
        assert same(signal.interpolate(r.groupBy("k", "t").agg(F.min("r").alias("r")), left, ["k"], "t", "r"), signal.interpolate(r.groupBy("k", "t").agg(F.min("r").alias("r")), left, ["k"], "t", "r", width=9.0))
    by_hand = {}
    for k, t, i in left.collect():
        c = [(x["t"], x["r"]) for x in right.collect() if x["k"] == k and x["t"] is not None and t is not None and x["t"] <= t]
        by_hand.setdefault((k, t, i), max(c)[1] if c else None)
    assert all(by_hand[r["k"], r["t"], r["l"]] == r["r"] for r in joins.asof(left, right, ["k"], "t", ["r"], ["r"]).collect())


def test_overlaps_with_nulls_and_repeats(spark):
    left = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 5, "a"), (1, 0, 5, None), (1, 20, 30, None), (None, 0, 5, "n"), (1, None, 5, "s"), (2, 0, 1, "z")], "k int, l_start int, l_end int, note string")
    right = spark.createDataFrame([(1, 4, 6), (1, None, 9), (None, 0, 9), (2, 1, 2)], "k int, r_start int, r_end int")
    semi = joins.interval_overlap(left, right, ["k"], 8.0, how="left_semi").collect()
    anti = joins.interval_overlap(left, right, ["k"], 8.0, how="left_anti").collect()
    assert sorted(map(repr, (r["note"] for r in semi))) == ["'a'", "'a'", "None"] and sorted(map(repr, (r["note"] for r in anti))) == ["'n'", "'s'", "'z'", "None"]
    assert joins.interval_overlap(left.limit(0), right, ["k"], 8.0, how="left_anti").collect() == [] and joins.interval_overlap(left, right.limit(0), ["k"], 8.0, how="left_anti").count() == 7


def test_k_nearest_equals_all_pairs(spark):
    rnd = random.Random(12)
    left = spark.createDataFrame([(rnd.randint(0, 3), rnd.randint(0, 40), i) for i in range(60)] + [(1, 7, 5)], "k int, x int, l int")
    right = spark.createDataFrame([(rnd.randint(0, 2), rnd.randint(0, 40), i) for i in range(30)], "k int, y int, r int")
    out = {}
    for r in joins.k_nearest(left, right, ["k"], "x", "y", "r", 3).collect():
        out.setdefault((r["k"], r["x"], r["l"]), []).append((r["rank"], r["distance"], r["r"]))
    for k, x, i in {tuple(r) for r in left.collect()}:
        pairs = sorted((abs(x - y), r) for kk, y, r in right.collect() if kk == k)[:3]
        n = sum(tuple(r) == (k, x, i) for r in left.collect())
        assert sorted(out.get((k, x, i), [])) == sorted((j + 1, d, r) for j, (d, r) in enumerate(pairs) for _ in range(n))
