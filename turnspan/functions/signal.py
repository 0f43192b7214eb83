"""Log-mel filter-bank features, as numpy kernels on whole windows and as DataFrame operators on
short signals.

A kernel takes float samples in [-1, 1); framing, mean removal, pre-emphasis, window, power spectrum,
mel energies, logarithm and mean normalisation follow one another. The DataFrame forms work on
array<double> columns and are what the SQL oracles are held against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1.1920928955078125e-07  # of float32


@dataclass(frozen=True)
class FeatureOptions:
    rate: int = 16_000
    frame: int = 400
    shift: int = 160
    bins: int = 80
    low_hz: float = 20.0
    high_hz: float = 0.0  # added to half the rate if not above 0
    preemphasis: float = 0.97
    dither: float = 0.0
    window: str = "povey"
    use_power: bool = True

    @property
    def padded(self) -> int:
        """The frame's length, rounded up to a power of two."""
        return 1 << (self.frame - 1).bit_length()


def frame_count(samples: int, o: FeatureOptions = FeatureOptions()) -> int:
    return 1 + (max(samples, o.frame) - o.frame) // o.shift


def window_values(kind: str, n: int) -> np.ndarray:
    """One of the six window functions over n samples."""
    if kind == "rectangular":
        return np.ones(n)
    a = 2 * np.pi * np.arange(n) / (n - 1)
    if kind == "sine":
        return np.sin(a / 2)
    if kind == "hanning":
        return 0.5 - 0.5 * np.cos(a)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(a)
    if kind == "povey":
        return (0.5 - 0.5 * np.cos(a)) ** 0.85
    if kind == "blackman":
        return 0.42 - 0.5 * np.cos(a) + 0.08 * np.cos(2 * a)
    raise ValueError(f"unknown window {kind!r}")


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz, np.float64) / 700.0)


def hz_of_mel(m):
    return 700.0 * np.expm1(np.asarray(m, np.float64) / 1127.0)


@lru_cache(maxsize=16)
def mel_weights(o: FeatureOptions = FeatureOptions()) -> np.ndarray:
    """(bins, padded / 2): triangles equally spaced in mel; nothing at or outside their corners."""
    half = o.rate / 2
    high = o.high_hz if o.high_hz > 0 else half + o.high_hz
    corner = np.linspace(mel(o.low_hz), mel(high), o.bins + 2)
    m = mel(np.arange(o.padded // 2) * o.rate / o.padded)
    left, centre, right = corner[:-2, None], corner[1:-1, None], corner[2:, None]
    up, down = (m - left) / (centre - left), (right - m) / (right - centre)
    return np.where((m > left) & (m < right), np.where(m <= centre, up, down), 0.0)


def frames_of(samples: np.ndarray, o: FeatureOptions = FeatureOptions()) -> np.ndarray:
    """(frames, frame length): whole frames only; shorter input is padded to one frame."""
    if len(samples) < o.frame:
        samples = np.concatenate([samples, np.zeros(o.frame - len(samples), samples.dtype)])
    return np.lib.stride_tricks.sliding_window_view(samples, o.frame)[:: o.shift]


def shape_frames(frames: np.ndarray, o: FeatureOptions = FeatureOptions(), rng: np.random.Generator | None = None) -> np.ndarray:
    """Dither, mean removal, pre-emphasis (the first sample by itself) and window."""
    x = frames.astype(np.float64)
    if o.dither:
        x = x + o.dither * (rng or np.random.default_rng(0)).normal(size=x.shape)
    x = x - x.mean(axis=1, keepdims=True)
    before = np.concatenate([x[:, :1], x[:, :-1]], axis=1)
    return (x - o.preemphasis * before) * window_values(o.window, x.shape[1])


def spectrum(frames: np.ndarray, o: FeatureOptions = FeatureOptions()) -> np.ndarray:
    """Power (or magnitude) of the bins below half the rate, which is left out."""
    s = np.fft.rfft(frames, o.padded, axis=1)[:, : o.padded // 2]
    power = s.real**2 + s.imag**2
    return power if o.use_power else np.sqrt(power)


def log_mel(samples: np.ndarray, o: FeatureOptions = FeatureOptions(), normalise: bool = True) -> np.ndarray:
    """(frames, bins) float32 features; with `normalise` each bin's mean over the frames is 0."""
    energy = spectrum(shape_frames(frames_of(samples, o), o), o) @ mel_weights(o).T
    out = np.log(np.maximum(energy, EPSILON))
    if normalise:
        out = out - out.mean(axis=0)
    return out.astype(np.float32)


def slice_samples(samples: np.ndarray, start: float, end: float, o: FeatureOptions = FeatureOptions()) -> np.ndarray:
    """The samples of [start, end) seconds: from 0 on, to the end of the data, at least one frame long."""
    first = max(0, int(start * o.rate))
    length = max(1, int((end - start) * o.rate))
    part = samples[first : first + length]
    return part if len(part) >= o.frame else np.concatenate([part, np.zeros(o.frame - len(part), samples.dtype)])


FEATURE_SCHEMA = "idx long, start double, end double, frames int, features array<array<float>>"


def features(windows: DataFrame, audio: DataFrame, o: FeatureOptions = FeatureOptions(), salt: int = 256) -> DataFrame:
    """(file_id, idx, start, end, frames, features) of windows (file_id, idx, start, end) over audio
    (file_id, samples array<float>).

    Windows come to their file's samples in lots of `salt`, so a long recording is many tasks' work;
    a lot carries only the samples between its first start and last end.
    """
    key = windows.schema["file_id"].dataType.simpleString()
    lots = windows.withColumn("lot", F.floor(F.col("idx") / salt)).groupBy("file_id", "lot").agg(
        F.array_sort(F.collect_list(F.struct("idx", "start", "end"))).alias("w"), F.min("start").alias("from"), F.max("end").alias("to")
    )
    first = F.greatest(F.lit(0), F.floor(F.col("from") * o.rate)).cast("int")
    length = (F.ceil(F.col("to") * o.rate) - first + o.frame).cast("int")
    parts = lots.join(audio, "file_id").select("file_id", "w", first.alias("first"), F.slice("samples", first + 1, F.greatest(length, F.lit(0))).alias("samples"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, w, at, samples in zip(pdf["file_id"], pdf["w"], pdf["first"], pdf["samples"]):
                samples = np.asarray(samples, np.float32)
                for x in w:
                    begin = max(0.0, x["start"])
                    first_sample = int(begin * o.rate) - at
                    part = samples[max(0, first_sample) : max(0, first_sample) + max(1, int((x["end"] - x["start"]) * o.rate))]
                    m = log_mel(part, o)
                    rows.append((f, x["idx"], x["start"], x["end"], len(m), m.tolist()))
            yield pd.DataFrame(rows, columns=["file_id", "idx", "start", "end", "frames", "features"])

    return parts.mapInPandas(run, f"file_id {key}, {FEATURE_SCHEMA}")


# ---- DataFrame forms ------------------------------------------------------------------------


def remove_mean(x: Column) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x)
    return F.transform(F.arrays_zip(x.alias("x"), F.array_repeat(mean, F.size(x)).alias("m")), lambda p: p["x"] - p["m"])


def preemphasise(x: Column, k: float = 0.97) -> Column:
    return F.transform(x, lambda y, i: y - F.lit(k) * F.element_at(x, F.greatest(i, F.lit(1))))


def window_value(kind: str, i: Column, n: Column) -> Column:
    """The window functions as one expression over index and length."""
    a = F.lit(2 * np.pi) * i / (n - 1)
    forms = {
        "rectangular": F.lit(1.0),
        "sine": F.sin(a / 2),
        "hanning": 0.5 - 0.5 * F.cos(a),
        "hamming": 0.54 - 0.46 * F.cos(a),
        "povey": F.pow(0.5 - 0.5 * F.cos(a), F.lit(0.85)),
        "blackman": 0.42 - 0.5 * F.cos(a) + 0.08 * F.cos(2 * a),
    }
    if kind not in forms:
        raise ValueError(f"unknown window {kind!r}")
    return forms[kind]


def windowed(x: Column, kind: str = "povey") -> Column:
    return F.transform(x, lambda y, i: y * window_value(kind, i.cast("double"), F.size(x).cast("double")))


def power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")


def dft_power(signals: DataFrame, n: int, limit: int | None = None) -> DataFrame:
    """(id, bin, power) of signals (id, x array<double>) of n samples: sums of products with a table
    of n * limit sines and cosines, which is made by Spark and has that fixed size."""
    spark = signals.sparkSession
    limit = n // 2 if limit is None else limit
    turn = F.lit(2 * np.pi) * ((F.col("bin") * F.col("i")) % n) / n
    table = spark.range(limit).withColumnRenamed("id", "bin").crossJoin(spark.range(n).withColumnRenamed("id", "i")).select("bin", "i", F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    long = signals.select("id", F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    sums = long.join(F.broadcast(table), "i").groupBy("id", "bin").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    return sums.select("id", "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def mel_filterbank(spark: SparkSession, o: FeatureOptions = FeatureOptions()) -> DataFrame:
    """(bin, fft_bin, weight) of the filters' inner bins: a computed table of bins * padded / 2 rows at most."""
    to_mel = lambda f: F.lit(1127.0) * F.log1p(f / F.lit(700.0))
    low, high = to_mel(F.lit(o.low_hz)), to_mel(F.lit(o.high_hz if o.high_hz > 0 else o.rate / 2 + o.high_hz))
    step = (high - low) / (o.bins + 1)
    grid = spark.range(o.bins).withColumnRenamed("id", "bin").crossJoin(spark.range(o.padded // 2).withColumnRenamed("id", "fft_bin"))
    g = grid.withColumn("m", to_mel(F.col("fft_bin") * F.lit(o.rate / o.padded)))
    g = g.withColumn("l", low + F.col("bin") * step).withColumn("c", low + (F.col("bin") + 1) * step).withColumn("r", low + (F.col("bin") + 2) * step)
    weight = F.when(F.col("m") <= F.col("c"), (F.col("m") - F.col("l")) / (F.col("c") - F.col("l"))).otherwise((F.col("r") - F.col("m")) / (F.col("r") - F.col("c")))
    return g.filter("m > l and m < r").select("bin", "fft_bin", weight.alias("weight"))


def mean_normalise(long: DataFrame) -> DataFrame:
    """v less its mean over the frames of each (file_id, idx, bin)."""
    return long.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("file_id", "idx", "bin")))


def frames_in(samples: Column, o: FeatureOptions = FeatureOptions()) -> Column:
    return (F.lit(1) + F.floor((F.greatest(samples, F.lit(o.frame)) - o.frame) / o.shift)).cast("int")
