"""Voice activity: chunking, powerset decoding, and pluggable detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import MIN_OFF, MIN_ON, active_runs, drop_brief, merge_gaps

#: Fixed values of the segmentation model's output.
RATE = 16_000
CHUNK_SAMPLES, FRAMES, FRAME_STEP, CLASSES = 160_000, 589, 0.016875, 7
#: The speakers that are active in each of the seven classes.
POWERSET = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def chunks(files: DataFrame) -> DataFrame:
    """(file_id, chunk, first_sample, samples, padding) of files (file_id, n_samples): chunks of ten
    seconds side by side, the last one short of `padding` samples. A file without samples has none."""
    n = F.ceil(F.col("n_samples") / CHUNK_SAMPLES).cast("int")
    rows = files.filter("n_samples > 0").select("file_id", "n_samples", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    first = F.col("chunk").cast("long") * CHUNK_SAMPLES
    length = F.least(F.lit(CHUNK_SAMPLES).cast("long"), F.col("n_samples") - first)
    return rows.select("file_id", "chunk", first.alias("first_sample"), length.alias("samples"), (CHUNK_SAMPLES - length).alias("padding"))


def best_class(scores: Column) -> Column:
    """0-based index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def powerset(frames: DataFrame) -> DataFrame:
    """Adds class, speakers (array of 0, 1, 2) and active to frames with `scores` of seven classes."""
    sets = F.array(*[F.array(*[F.lit(x) for x in s]) if s else F.expr("cast(array() as array<int>)") for s in POWERSET])
    out = frames.withColumn("class", best_class(F.col("scores")))
    return out.withColumn("speakers", F.element_at(sets, F.col("class") + 1)).withColumn("active", F.col("class") != 0)


def from_frames(frames: DataFrame, min_on: float = MIN_ON, min_off: float = MIN_OFF) -> DataFrame:
    """Speech intervals (file_id, seg_idx, start, end) of frames (file_id, chunk, frame, active)."""
    return drop_brief(merge_gaps(active_runs(frames), min_off), min_on)


@dataclass(frozen=True)
class VadBackend:
    """A detector: a function of float samples in [-1, 1) that gives [(start, end)] in seconds, and
    the least lengths of speech and of silence that its result is held to."""

    name: str
    detect: Callable[[np.ndarray], list[tuple[float, float]]]
    min_on: float = MIN_ON
    min_off: float = MIN_OFF


def energy_intervals(samples: np.ndarray, floor_db: float = -45.0, frame: int = 400, shift: int = 160) -> list[tuple[float, float]]:
    """Runs of frames whose mean power lies over `floor_db` (0 dB is full scale)."""
    if len(samples) < frame:
        return []
    square = np.concatenate([[0.0], np.cumsum(samples.astype(np.float64) ** 2)])
    start = np.arange(0, len(samples) - frame + 1, shift)
    loud = 10 * np.log10((square[start + frame] - square[start]) / frame + 1e-12) > floor_db
    edge = np.flatnonzero(np.diff(np.concatenate([[False], loud, [False]]).astype(np.int8)))
    return [(a * shift / RATE, ((b - 1) * shift + frame) / RATE) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def energy_vad(floor_db: float = -45.0) -> VadBackend:
    """The detector that needs no weights."""
    return VadBackend("energy", lambda samples: energy_intervals(samples, floor_db))


def silero_vad(model: Callable[[np.ndarray], np.ndarray], threshold: float = 0.55, window: int = 512) -> VadBackend:
    """A detector over a supplied model, samples to a speech probability for each `window`: speech of
    at least 250 ms over `threshold`, parted by silence of at least 100 ms."""

    def detect(samples: np.ndarray) -> list[tuple[float, float]]:
        on = np.asarray(model(samples)) > threshold
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        return [(a * window / RATE, min(b * window, len(samples)) / RATE) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]

    return VadBackend("silero", detect, 0.25, 0.1)


def pyannote_vad(model: Callable[[np.ndarray], np.ndarray]) -> VadBackend:
    """A detector over a supplied segmentation model, a chunk of 160,000 samples to (589, 7) scores."""

    def detect(samples: np.ndarray) -> list[tuple[float, float]]:
        out = []
        for c, at in enumerate(range(0, len(samples), CHUNK_SAMPLES)):
            chunk = np.zeros(CHUNK_SAMPLES, np.float32)
            part = samples[at : at + CHUNK_SAMPLES]
            chunk[: len(part)] = part
            on = np.asarray(model(chunk)).argmax(axis=1) != 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
            out += [(c * 10.0 + a * FRAME_STEP, c * 10.0 + b * FRAME_STEP) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return out

    return VadBackend("pyannote", detect)


def choose(vad: str = "auto", accelerated: bool = False, models: dict[str, Callable] | None = None) -> VadBackend:
    """The detector by name; `auto` takes pyannote on an accelerator and silero otherwise, and the
    energy detector where the chosen one's model is not supplied."""
    models = models or {}
    if vad not in ("auto", "pyannote", "silero", "energy"):
        raise ValueError(f"unknown vad {vad!r}: auto, pyannote, silero or energy")
    name = ("pyannote" if accelerated else "silero") if vad == "auto" else vad
    if name == "energy" or (vad == "auto" and name not in models):
        return energy_vad()
    if name not in models:
        raise ValueError(f"vad {name!r} needs its model; none is supplied")
    return (pyannote_vad if name == "pyannote" else silero_vad)(models[name])
