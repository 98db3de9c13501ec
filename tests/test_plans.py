import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans import performance, score
from tidemark.sources import audio, landing, voicebank
from tidemark.streaming.islands import streaming_sessions


def test_performance(spark):
    bars = spark.createDataFrame([("s", 0, 0.0, 4.0, True, False, 2), ("s", 1, 4.0, 4.0, False, True, 2), ("s", 2, 8.0, 4.0, False, False, 2)], "score_id string, idx int, start double, length double, repeat_start boolean, repeat_end boolean, repeat_times int")
    tempos = spark.createDataFrame([("s", 0.0, 120.0)], "score_id string, start double, qpm double")
    played = performance.performed_measures(bars, tempos)
    assert [(r["idx"], r["pass"], r["t"]) for r in played.orderBy("position").collect()] == [(0, 1, 0.0), (1, 1, 2.0), (0, 2, 4.0), (1, 2, 6.0), (2, 1, 8.0)]
    schema = "score_id string, part string, voice int, start double, dur double, midi int, lyrics map<int,struct<text:string,hyphen_after:boolean>>, measure int"
    notes = spark.createDataFrame([("s", "T", 0, 0.0, 2.0, 60, {1: ("la", False), 2: ("da", False)}, 0), ("s", "T", 0, 8.0, 1.0, 62, None, 2)], schema)
    out = performance.performed_notes(notes, played).orderBy("t").collect()
    assert [(r["t"], r["dur"], r["sung"]) for r in out] == [(0.0, 1.0, "la"), (4.0, 1.0, "da"), (8.0, 0.5, "da")]


def test_quality_report(spark):
    notes = spark.createDataFrame([("T", 0, 1.0, 1.0), ("T", 0, 3.0, 1.0), ("T", 0, 5.0, 1.0)], "part string, voice int, t double, dur double")
    level = lambda i: 0.5 if 100 <= i < 200 or 320 <= i < 400 else 0.0
    frames = spark.createDataFrame([("T", 0, i, level(i)) for i in range(700)], "part string, voice int, frame_idx long, level double")
    r = performance.quality_report(notes, frames).first()
    assert (r["notes"], r["silent"], r["late"]) == (3, 1, 1)


def test_quality_of_groups(spark):
    """No onset is asked for where the note before still sounds, or where a syllable goes on; lists name the notes."""
    notes = spark.createDataFrame([("T", 0, 1.0, 1.0, True), ("T", 0, 2.01, 1.0, True), ("T", 0, 5.0, 1.0, False), ("T", 0, 7.0, 1.0, True), ("T", 0, 9.0, 0.1, True), ("U", 0, 1.0, 1.0, True)], "part string, voice int, t double, dur double, syllable boolean")
    level = lambda i: 0.5 if 100 <= i < 200 or 225 <= i < 300 or 530 <= i < 600 or 730 <= i < 800 else 0.0
    frames = spark.createDataFrame([("T", 0, i, level(i)) for i in range(1000)], "part string, voice int, frame_idx long, level double")
    out = {r["part"]: r for r in performance.quality_report(notes, frames).collect()}
    assert (out["T"]["notes"], out["T"]["silent"], out["T"]["late"], out["T"]["late_at"]) == (4, 0, 1, [7.0])
    assert performance.quality_report(notes.limit(0), frames).collect() == []


def test_beats(spark):
    bars = spark.createDataFrame([("s", 0, 0.0, 1.0, 4, 4, False, False, 2), ("s", 1, 1.0, 3.0, 6, 8, False, False, 2)], "score_id string, idx int, start double, length double, num int, den int, repeat_start boolean, repeat_end boolean, repeat_times int")
    tempos = spark.createDataFrame([("s", 0.0, 120.0)], "score_id string, start double, qpm double")
    played = performance.performed_measures(bars, tempos)
    assert [(r["t"], r["level"]) for r in performance.beats_of(played, bars).orderBy("t").collect()] == [(0.0, 1), (0.5, 2), (1.25, 1)]
    assert [r["level"] for r in performance.beats_of(played, bars, 0.5).orderBy("t").collect()] == [1, 0, 2, 0, 0, 1, 0, 0]
    r = performance.first_tempo(bars, tempos).first()
    assert (r["seconds"], r["clicks"]) == (0.75, 2)


def test_pitch_report(spark):
    notes = spark.createDataFrame([("T", 0, k, float(k), 1.0, 440.0) for k in range(3)] + [("T", 0, 9, 5.0, 0.2, 440.0)], "part string, voice int, note int, t double, dur double, target double")
    frames = spark.createDataFrame([("T", 0, i / 20, 440.0 * (1.05 if i < 20 else 1.0) if i < 60 else 0.0) for i in range(120)], "part string, voice int, t double, hz double")
    r = performance.pitch_report(notes, frames).first()
    assert (r["notes"], r["off"]) == (3, 1) and abs(r["median"]) < 1e-6


def test_voice_banks(spark, tmp_path):
    base = tmp_path / "banks" / "one" / "configs"
    (base / "embeds").mkdir(parents=True)
    (base / "dsconfig.yaml").write_text("# bank\nsample_rate: 44100\nhop_size: 512\nphonemes: p.json\nlanguages: 'l.json'\nspeakers:\n  - a\nmax_depth: 0.6 # most\n")
    (base / "p.json").write_text('{"SP": 1, "en/aa": 2}')
    (base / "l.json").write_text('{"en": 3}')
    np.arange(4, dtype="<f4").tofile(str(base / "embeds" / "soft.emb"))
    folder = str(tmp_path / "banks")
    assert [r["bank"] for r in voicebank.list_banks(spark, folder).collect()] == ["one"]
    b = voicebank.bank(folder + "/one")
    assert b["tokens"]["en/aa"] == 2 and b["languages"] == {"en": 3} and b["settings"]["max_depth"] == 0.6 and b["frame"] == 512 / 44100 and b["embeds"]["soft"].tolist() == [0, 1, 2, 3]
    r = voicebank.embeddings(spark, folder).first()
    assert (r["bank"], r["mode"], list(r["vector"])) == ("one", "soft", [0, 1, 2, 3])
    (base / "dsconfig.yaml").write_text("sample_rate: 16000\n")
    with pytest.raises(ValueError, match="sample rate"):
        voicebank.read_bank(folder + "/one")


def test_documents_are_found_in_order(spark, tmp_path):
    for folder, names in (("input", ("b.pdf", "a.pdf", "x.txt")), ("other", ("0.pdf",))):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_bytes(b"x")
    out = score.find_documents(spark, [str(tmp_path / "input"), str(tmp_path / "other")]).orderBy("ord").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in out] == ["a.pdf", "b.pdf", "0.pdf"]


def test_stereo_files(spark):
    frames = spark.createDataFrame([("t", c, i, [0.25 * (c + 1)] * 3) for c in range(2) for i in range(2)], "track string, channel int, frame_idx long, samples array<float>")
    content = bytes(audio.to_files(frames, 8000).first()["content"])
    import io
    import wave

    with wave.open(io.BytesIO(content)) as f:
        assert (f.getnchannels(), f.getnframes()) == (2, 6) and np.frombuffer(f.readframes(1), "<i2").tolist() == [8191, 16383]


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1000) / 20).astype(np.float32) / 2
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(x, 8000))
    frames = audio.read_wav(spark, str(tmp_path))
    content = audio.to_wav(frames.select("track", "frame_idx", "samples"), 8000).first()["content"]
    rate, y = audio.decode_wav(bytes(content))
    assert rate == 8000 and len(y) == 1000 and np.abs(x - y).max() < 1e-3


def test_landing(spark, tmp_path):
    (tmp_path / "w.txt").write_text("The\nthe\n\nCat\n")
    assert sorted(r["word"] for r in landing.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["cat", "the"]
    assert spark.range(1).select(text.music_char(F.lit("")).alias("c")).first()["c"] == "&"


def test_streaming_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts", "10 minutes", "1 hour")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [1, 2]
