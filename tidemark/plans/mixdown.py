"""Sung parts to a finished stereo track: gains, reverberation, clicks, loudness, limiter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SAMPLE_RATE
from ..operators import aggregates, signal, singing
from .steps import settle


def reverberated(stereo: DataFrame, length: int, wet: float, rate: int) -> DataFrame:
    """idx, left, right: with the reverberation of each channel on top, cut at ``length``. The Fourier transform needs a channel as a whole: two groups of a track's samples."""
    channels = stereo.select("idx", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("left").alias("v")), F.struct(F.lit(1).alias("c"), F.col("right").alias("v")))).alias("s")).select("idx", "s.c", "s.v")

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        x = np.zeros(length)
        x[pdf["idx"].to_numpy()] = pdf["v"].to_numpy()
        y = x + wet * signal.convolve(x, signal.reverb_response(rate)[key[0]])[:length]
        return pd.DataFrame({"c": key[0], "idx": np.arange(length), "v": y})

    done = channels.where(F.col("idx").between(0, length - 1)).groupBy("c").applyInPandas(run, "c int, idx long, v double")
    side = lambda c: F.sum(F.when(F.col("c") == c, F.col("v")))
    return done.groupBy("idx").agg(side(0).alias("left"), side(1).alias("right"))


def mixdown(samples: DataFrame, parts: DataFrame, beats: DataFrame | None = None, focus: str | None = None, rate: int = SAMPLE_RATE, others: float = 0.1, wet: float = 0.07, target: float = 0.2, ceiling: float = 0.93) -> DataFrame:
    """idx, left, right of the track of all parts (samples: part, idx, value; parts: part, ord), with a metronome (beats: t, level) and a part in ``focus``, if given: brought to an even loudness by its louder channel, and limited by both. A track without samples has no rows."""
    longest = samples.agg(F.max("idx").alias("n")).first()["n"]
    if longest is None:
        return samples.sparkSession.createDataFrame([], "idx long, left double, right double")
    length = longest + 1
    dry = singing.dry_mix(samples, singing.mix_gains(parts, "ord", focus, others))
    mixed = reverberated(dry, length, wet, rate)
    if beats is not None:
        c = singing.metronome(beats, rate, length).withColumn("value", F.col("value") * 0.35)
        left = F.lit(0.0) if focus is not None else F.col("value")
        clicks = c.select("idx", left.alias("left"), (F.col("value") * (1.3 if focus is not None else 1.0)).alias("right"))
        mixed = mixed.unionByName(clicks).groupBy("idx").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    mixed = settle(mixed.withColumn("track", F.lit(0)), "mixed")
    channels = mixed.select("track", "idx", F.posexplode(F.array("left", "right")).alias("channel", "value"))
    gain = aggregates.loudness_gain(channels, "track", "channel", "idx", "value", target)
    loud = mixed.join(F.broadcast(gain), "track").select("track", "idx", *[(F.col(c) * F.col("gain")).alias(c) for c in ("left", "right")])
    limited = signal.peak_gain(loud.withColumn("level", F.greatest(F.abs("left"), F.abs("right"))), ["track"], "idx", "level", rate, ceiling, "gain")
    clip = lambda c: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), F.col(c) * F.col("gain"))).alias(c)
    return limited.select("idx", clip("left"), clip("right"))
