"""Signals: frames of samples by track, and filters over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import edges
from .ordered import fold


def interpolate(knots: DataFrame, grid: DataFrame, keys, at: str, value: str, width: float | None = None) -> DataFrame:
    """Linear interpolation of the knots at the grid's places; outside it keeps the first or last value. One union and a sort each way. ``width``: cut the axis into blocks of it, so that a key (or no key at all) is not one task; each block also gets the last knot before it and
    the first one after it. Knots with a null place or value are left out; keys without knots give null; repeated places of the grid stay."""
    knots = knots.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    k = knots.select(*keys, at, F.struct(at, value).alias("__k"))
    g = grid.select(*keys, at, F.lit(True).alias("__g"))
    parts = [*keys]
    if width is not None:
        block = F.floor(F.col(at) / width)
        g, parts = g.withColumn("__block", block), [*keys, "__block"]
        around = edges(k, keys, block, g, F.min("__k"), F.max("__k"))
        ends = around.select(*keys, "__block", F.explode(F.array_compact(F.array("__before", "__after"))).alias("__k"))
        k = k.withColumn("__block", block).unionByName(ends.select(*keys, F.col(f"__k.{at}").alias(at), "__k", "__block"))
    both = k.unionByName(g, allowMissingColumns=True)
    lo = F.last("__k", ignorenulls=True).over(W.partitionBy(*parts).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow))
    # looking ahead is looking back in descending order: a frame that ends at the current row grows row by row
    hi = F.last("__k", ignorenulls=True).over(W.partitionBy(*parts).orderBy(F.col(at).desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    found = both.withColumn("__lo", lo).withColumn("__hi", hi).where("__g")
    a, b, x = F.col("__lo"), F.col("__hi"), F.col(at)
    inner = a[value] + (b[value] - a[value]) * (x - a[at]) / (b[at] - a[at])
    y = F.when(a.isNull(), b[value]).when(b.isNull() | (b[at] == a[at]), a[value]).otherwise(inner)
    return found.select(*keys, at, y.cast("double").alias(value))


def recursive_filter(df: DataFrame, keys, order, value: str, b: list[float], a: list[float], name: str = "y") -> DataFrame:
    """The difference equation y[n] = sum(b[k] x[n-k]) - sum(a[k] y[n-k], k > 0), with a[0] = 1, over each key's rows in their order: keys, the columns of
    ``order``, ``name``. A ``fold`` (the result depends on all rows before): the last inputs and outputs are the state. Null inputs count as 0."""
    parts = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)

    def make():
        xs, ys = [0.0] * len(b), [0.0] * (len(a) - 1)

        def step(row):
            if row is None:
                return []
            xs.insert(0, float(row[-1] or 0.0))
            xs.pop()
            y = sum(c * x for c, x in zip(b, xs, strict=True)) - sum(c * v for c, v in zip(a[1:], ys, strict=True))
            if ys:
                ys.insert(0, y)
                ys.pop()
            return [(*row[:-1], y)]

        return step

    return fold(df, keys, order, [*order, value], f"{parts}, `{name}` double", make)


def smooth_frames(df: DataFrame, keys, order: str, value: str, taps=(0.25, 0.5, 0.25), floor: float = 1e-12) -> DataFrame:
    """``smooth``: the weighted sum of the logarithms of a row and its neighbours (missing ones count as 0), and back. Values are raised by ``floor`` first."""
    w, half = W.partitionBy(*keys).orderBy(order), len(taps) // 2
    logs = df.withColumn("__log", F.log(F.col(value) + floor))
    total = F.lit(0.0)
    for k, t in enumerate(taps):
        total = total + F.lit(t) * F.coalesce(F.lag("__log", half - k).over(w), F.lit(0.0))
    return logs.withColumn("smooth", F.exp(total)).drop("__log")


def soft_clip(value):
    """tanh(2.5 y) / 2.5: peaks are rounded, small values stay."""
    return F.tanh(value * 2.5) / 2.5


def sliding_mirrored(df: DataFrame, keys, index: str, value: str, size: int, how: str, name: str) -> DataFrame:
    """``max``, ``min`` or ``avg`` over a window of ``size`` rows about each row (an even one reaches one further back), with borders mirrored about the edge: rows near a border are repeated beyond it, in reverse, before the window
    runs. ``index`` counts a key's rows from 0. Keys with fewer rows than half a window are not mirrored twice."""
    before, after = size // 2, size - size // 2 - 1
    n = F.count("*").over(W.partitionBy(*keys))
    counted = df.withColumn("__n", n)
    copies = F.array(
        F.struct(F.col(index).alias("p"), F.lit(True).alias("own")),
        F.when(F.col(index) < before, F.struct((-1 - F.col(index)).alias("p"), F.lit(False).alias("own"))),
        F.when(F.col(index) >= F.col("__n") - after, F.struct((2 * F.col("__n") - 1 - F.col(index)).alias("p"), F.lit(False).alias("own"))),
    )
    padded = counted.withColumn("__c", F.explode(F.array_compact(copies)))
    w = W.partitionBy(*keys).orderBy("__p").rowsBetween(-before, after)
    done = padded.withColumn("__p", F.col("__c.p")).withColumn(name, {"max": F.max, "min": F.min, "avg": F.avg}[how](value).over(w))
    return done.where("__c.own").drop("__n", "__c", "__p")


def peak_gain(df: DataFrame, keys, index: str, level: str, rate: int, ceiling: float, name: str) -> DataFrame:
    """``df`` with the gain that keeps a level (not negative) under the ceiling: by its maximum over 10 ms, held at its lowest for 80 ms and smoothed over 10 ms."""
    short, hold, mean = 2 * int(0.005 * rate) + 1, int(0.08 * rate), int(0.01 * rate)
    rows = sliding_mirrored(df, keys, index, level, short, "max", "__env")
    gain = rows.withColumn("__g", F.least(F.lit(1.0), F.lit(ceiling) / F.greatest(F.col("__env"), F.lit(1e-9))))
    held = sliding_mirrored(gain, keys, index, "__g", hold, "min", "__h")
    return sliding_mirrored(held, keys, index, "__h", mean, "avg", name).drop("__env", "__g", "__h")


def limit_peaks(df: DataFrame, keys, index: str, value: str, rate: int, ceiling: float = 0.93) -> DataFrame:
    """``df`` with ``limited``: the value times its ``peak_gain``, clipped at the ceiling."""
    smooth = peak_gain(df.withColumn("__a", F.abs(value)), keys, index, "__a", rate, ceiling, "__s")
    out = F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), F.col(value) * F.col("__s")))
    return smooth.withColumn("limited", out).drop("__a", "__s")


def shelf(sample_rate: float, f0: float, gain_db: float, high: bool) -> tuple[list[float], list[float]]:
    """Coefficients (b, a) of a second-order shelving filter of slope 1, after the public audio equaliser formulas."""
    g, w = 10 ** (gain_db / 40), 2 * np.pi * f0 / sample_rate
    c, s = np.cos(w) * (-1 if high else 1), 2 * np.sqrt(g) * np.sin(w) / np.sqrt(2)
    flip = -1 if high else 1
    b = [g * (g + 1 - (g - 1) * c + s), flip * 2 * g * (g - 1 - (g + 1) * c), g * (g + 1 - (g - 1) * c - s)]
    a = [g + 1 + (g - 1) * c + s, flip * -2 * (g - 1 + (g + 1) * c), g + 1 + (g - 1) * c - s]
    return [float(x / a[0]) for x in b], [float(x / a[0]) for x in a]


def biquad(x: np.ndarray, b: list[float], a: list[float], state: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """Second-order recursive filter (transposed form); the state carries over to the next block."""
    y, (s1, s2) = np.empty(len(x)), state
    for i, v in enumerate(x.tolist()):
        out = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * out + s2, b[2] * v - a[2] * out
        y[i] = out
    return y, (s1, s2)


def per_track(df: DataFrame, fn, track: str = "track") -> DataFrame:
    """Applies fn(samples) -> samples to each whole track of frames (track, frame_idx, samples): signals whose filters have memory are
    folded track by track."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("frame_idx")
        sizes = [len(s) for s in pdf["samples"]]
        y = fn(np.concatenate([np.asarray(s, np.float64) for s in pdf["samples"]]) if sizes else np.empty(0))
        y = np.resize(y, sum(sizes)) if len(y) < sum(sizes) else y[: sum(sizes)]
        cuts = np.cumsum(sizes)[:-1]
        return pd.DataFrame({track: key[0], "frame_idx": pdf["frame_idx"].to_numpy(), "samples": [p.astype(np.float32) for p in np.split(y, cuts)]})

    return df.groupBy(track).applyInPandas(run, f"{track} {df.schema[track].dataType.simpleString()}, frame_idx long, samples array<float>")


def reverb_response(rate: int, seconds: float = 1.1, seed: int = 7, predelay: float = 0.02, box: int = 16) -> np.ndarray:
    """Two channels of decaying noise, silent at first, then smoothed by a running mean; each of unit energy."""
    n = int(rate * seconds)
    decay = np.exp(-6.9 / seconds * np.arange(n) / rate)
    noise = np.random.default_rng(seed).standard_normal((2, n)).astype(np.float32) * decay
    noise[:, : int(predelay * rate)] = 0.0
    mean = np.full(box, 1 / box, np.float32)
    smooth = [np.convolve(channel, mean, "same") for channel in noise]
    return np.stack([x / np.sqrt(np.square(x).sum()) for x in smooth])


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Full convolution by the Fourier transform."""
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]


def sliding_reflect(x: np.ndarray, size: int, how: str) -> np.ndarray:
    """Sliding max, min or mean with borders mirrored about the edge; an even window reaches one further back."""
    before, after = size // 2, size - size // 2 - 1
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, (before, after), "symmetric"), size)
    return getattr(view, how)(axis=1)


def limiter(x: np.ndarray, rate: int, ceiling: float = 0.93) -> np.ndarray:
    """``limit_peaks`` of a whole track at once: gain that keeps the envelope (10 ms maximum) under the ceiling, held for 80 ms, smoothed over 10 ms; clipped."""
    short = 2 * int(0.005 * rate) + 1
    gain = np.minimum(1.0, ceiling / np.maximum(sliding_reflect(np.abs(x), short, "max"), 1e-9))
    gain = sliding_reflect(sliding_reflect(gain, max(1, int(0.08 * rate)), "min"), max(1, int(0.01 * rate)), "mean")
    return np.clip(x * gain, -ceiling, ceiling)


def click(rate: int, freq: float, length: float = 0.035) -> np.ndarray:
    """A tone with a partial a little above its octave; both fall by a factor e in 1/90 s."""
    t = np.arange(int(rate * length)) / rate
    return (np.sin(2 * np.pi * freq * t) + 0.3 * np.sin(2 * np.pi * 2.01 * freq * t)) * np.exp(-90 * t)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """By a rational ratio: zeros between the samples, a low-pass filter at the lower of both rates (a sinc of ten periods a side under a Kaiser window), every ``down``-th sample of the result. The length is
    the input's times the ratio, rounded up."""
    common = int(np.gcd(up, down))
    up, down = up // common, down // common
    if up == down or not len(x):
        return np.asarray(x, np.float64).copy()
    most = max(up, down)
    k = np.arange(-10 * most, 10 * most + 1)
    h = np.sinc(k / most) * np.kaiser(len(k), 5.0)
    h *= up / h.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    y = np.convolve(wide, h)[10 * most :]
    return y[: len(wide) : down]
