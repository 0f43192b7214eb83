"""WAV recordings: header checks in SQL over the binary source, and decoding in numpy."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rttm import stem

RATE, CHANNELS, BITS = 16_000, 1, 16


class AudioFormatError(ValueError):
    """A recording is not 16 kHz, mono, 16 bit."""


@dataclass(frozen=True)
class WavInfo:
    code: int  # 1: integers, 3: floats
    channels: int
    rate: int
    bits: int
    data_at: int
    data_size: int

    @property
    def seconds(self) -> float:
        width = self.rate * self.channels * self.bits // 8
        return self.data_size / width if width else 0.0


def parse_header(content: bytes) -> WavInfo:
    """Walks the RIFF chunks to `data`; others are skipped. A data size of 0, or beyond the end of the
    file, means all that is left."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise AudioFormatError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        at += 8
        if name == b"fmt ":
            if size < 16 or at + 16 > len(content):
                raise AudioFormatError("the format chunk is too short")
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at)
            if code == 0xFFFE and size >= 26:  # extensible: the real code leads the sub-format
                code = struct.unpack_from("<H", content, at + 24)[0]
            fmt = (code, channels, rate, bits)
        elif name == b"data":
            if fmt is None:
                raise AudioFormatError("data come before the format")
            left = len(content) - at
            return WavInfo(*fmt, at, left if size == 0 or size > left else size)
        at += size + (size & 1)
    raise AudioFormatError("no data chunk")


def decode(content: bytes, first_channel: bool = False) -> tuple[np.ndarray, WavInfo]:
    """(samples, info): float32 samples in [-1, 1), channels interleaved as they come unless
    `first_channel`. 8-bit samples are unsigned; 32-bit ones are floats if the header says so."""
    info = parse_header(content)
    kinds = {(1, 8): np.uint8, (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}
    kind = kinds.get((info.code, info.bits))
    if kind is None:
        raise AudioFormatError(f"{info.bits}-bit samples of code {info.code} are not read")
    width = info.bits // 8
    raw = np.frombuffer(content, dtype=kind, count=info.data_size // width, offset=info.data_at)
    if info.code == 3:
        x = raw.astype(np.float32)
    elif info.bits == 8:
        x = (raw.astype(np.float32) - 128) / 128
    else:
        x = (raw.astype(np.float64) / (1 << (info.bits - 1))).astype(np.float32)
    if first_channel and info.channels > 1:
        x = x[: len(x) // info.channels * info.channels].reshape(-1, info.channels)[:, 0]
    return x, info


def level(x: np.ndarray) -> np.ndarray:
    """Divided by the largest magnitude, if that is over 1."""
    top = float(np.abs(x).max()) if len(x) else 0.0
    return x / top if top > 1 else x


def encode(x: np.ndarray, rate: int = RATE, bits: int = BITS, channels: int = CHANNELS, as_float: bool = False) -> bytes:
    """WAV bytes of float samples in [-1, 1]."""
    if as_float:
        data, code, bits = np.asarray(x, "<f4").tobytes(), 3, 32
    else:
        scale = 1 << (bits - 1)
        whole = np.clip(np.rint(np.asarray(x, np.float64) * scale), -scale, scale - 1)
        kinds = {8: np.uint8, 16: "<i2", 32: "<i4"}
        if bits not in kinds:
            raise AudioFormatError(f"{bits}-bit samples are not written")
        data, code = (whole + 128 if bits == 8 else whole).astype(kinds[bits]).tobytes(), 1
    block = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, code, channels, rate, rate * block, block, bits, b"data", len(data))
    return head + data + b"\0" * (len(data) & 1)


def resample(x: np.ndarray, source: int, target: int = RATE, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling; a cut below half the lower rate."""
    if source == target or not len(x):
        return x.astype(np.float32)
    ratio = target / source
    n = int(np.ceil(len(x) * ratio))
    reach, cut = taps / min(1.0, ratio), min(1.0, ratio)
    out = np.zeros(n)
    padded = np.concatenate([np.zeros(int(reach) + 1), x.astype(np.float64), np.zeros(int(reach) + 2)])
    centre = np.arange(n) / ratio
    base = np.floor(centre).astype(np.int64)
    for k in range(-int(reach), int(reach) + 2):
        d = base + k - centre
        w = np.where(np.abs(d) < reach, cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * d / reach)), 0.0)
        out += w * padded[np.minimum(base + k + int(reach) + 1, len(padded) - 1)]
    return out.astype(np.float32)


def to_mono_16k(content: bytes) -> np.ndarray:
    """Samples of any readable WAV as 16 kHz mono, rounded to 16 bits."""
    x, info = decode(content)
    if info.channels > 1:
        x = x[: len(x) // info.channels * info.channels].reshape(-1, info.channels).mean(axis=1)
    y = resample(x, info.rate)
    return (np.clip(np.rint(y * 32768.0), -32768, 32767) / 32768.0).astype(np.float32)


def looks_like_audio(content: Column, length: Column) -> Column:
    """Whether a download can be audio: over 1000 bytes, beginning as RIFF or FLAC."""
    head = F.substring(content, 1, 4)
    return (length > 1000) & ((head == F.lit(b"RIFF")) | (head == F.lit(b"fLaC")))


def _number(content: Column, at: int, size: int) -> Column:
    """A little-endian number from 0-based byte `at`."""
    return F.conv(F.hex(F.reverse(F.array(*[F.substring(content, at + 1 + i, 1) for i in range(size)])).getItem(0)), 16, 10) if size == 1 else F.conv(
        F.concat(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in reversed(range(size))]), 16, 10
    ).cast("long")


def list_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_id, length, channels, rate, bits, accepted), headers by plain offsets; the content
    column is pruned down to its first bytes' expressions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    c = F.col("content")
    rows = files.select("path", stem(F.col("path")).alias("file_id"), "length", _number(c, 22, 2).alias("channels"), _number(c, 24, 4).alias("rate"), _number(c, 34, 2).alias("bits"))
    return rows.withColumn("accepted", F.coalesce((F.col("channels") == CHANNELS) & (F.col("rate") == RATE) & (F.col("bits") == BITS), F.lit(False)))


def read_wavs(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(audio, rejected): audio is (file_id, path, rate, n_samples, seconds, samples array<float>).

    Recordings that are not 16 kHz mono 16 bit are rejected; with `strict`, that raises."""
    listed = list_wavs(spark, path)
    rejected = listed.filter("not accepted")
    if strict and (bad := rejected.select("path").take(1)):
        raise AudioFormatError(f"not 16 kHz mono 16 bit: {bad[0].path}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")
    accepted = files.join(listed.filter("accepted").select("path", "file_id"), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content, f in zip(pdf["path"], pdf["content"], pdf["file_id"]):
                x, info = decode(content)
                yield pd.DataFrame({"file_id": [f], "path": [p], "rate": [info.rate], "n_samples": [len(x)], "seconds": [info.seconds], "samples": [x]})

    audio = accepted.select("path", "content", "file_id").mapInPandas(run, "file_id string, path string, rate int, n_samples long, seconds double, samples array<float>")
    return audio, rejected


def write_wavs(audio: DataFrame, path: str, rate: int = RATE, bits: int = BITS, as_float: bool = False) -> None:
    """Writes recordings (file_id, samples) as WAV bytes, a Parquet table of (file_id, content): Spark
    has no writer for single binary files; `export_wav` makes one of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["file_id"], "content": [encode(x, rate, bits, as_float=as_float) for x in pdf["samples"]]})

    audio.select(F.col("file_id").cast("string").alias("file_id"), "samples").mapInPandas(run, "file_id string, content binary").write.parquet(path)


def export_wav(content: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(content)
