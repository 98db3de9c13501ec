"""WAV files as tables of frames, and back. Standard library only."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession

BLOCK = 441


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples of the first channel from -1 to 1) of a 16-bit file."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        raw = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())[:, 0]
        return f.getframerate(), raw.astype(np.float32) / 32768


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit file; samples are clipped to 1 and cut toward zero. Two rows make it stereo."""
    pcm = (np.clip(np.atleast_2d(samples), -1, 1) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(pcm))
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(pcm.T.tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """track (path), rate, frame_idx, samples of every *.wav under the path; a file is read by one task."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rate, x = decode_wav(data)
                n = max(1, -(-len(x) // block))
                yield pd.DataFrame({"track": name, "rate": rate, "frame_idx": np.arange(n), "samples": [x[i * block : (i + 1) * block] for i in range(n)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "track string, rate int, frame_idx long, samples array<float>")


def encode_mp3(samples: np.ndarray, rate: int, kbps: int = 192) -> bytes:
    """An MP3 file of one or two rows of samples, clipped to 1 and cut toward zero. Needs the package lameenc."""
    import lameenc

    pcm = (np.clip(np.atleast_2d(samples), -1, 1) * 32767).astype("<i2")
    encoder = lameenc.Encoder()
    encoder.set_bit_rate(kbps)
    encoder.set_in_sample_rate(rate)
    encoder.set_channels(len(pcm))
    encoder.set_quality(2)
    return bytes(encoder.encode(pcm.T.tobytes()) + encoder.flush())


def to_files(frames: DataFrame, rate: int, encode=encode_wav) -> DataFrame:
    """(track, content): one binary file for each track of (track, frame_idx, samples, and ``channel`` for stereo, channels in their order). A track, some minutes of sound, is one group."""
    stereo = "channel" in frames.columns

    def run(key, pdf):
        import pandas as pd

        rows = [g.sort_values("frame_idx")["samples"] for _, g in (pdf.groupby("channel") if stereo else [(0, pdf)])]
        x = [np.concatenate([np.asarray(s, np.float32) for s in r]) for r in rows]
        return pd.DataFrame({"track": [key[0]], "content": [encode(np.stack([c[: min(map(len, x))] for c in x]), rate)]})

    return frames.groupBy("track").applyInPandas(run, "track string, content binary")


def to_wav(frames: DataFrame, rate: int) -> DataFrame:
    """(track, content): a WAV file for each track."""
    return to_files(frames, rate)
