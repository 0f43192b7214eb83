"""The whole pipeline over a folder of recordings: speech, windows, features, vectors, clusters,
segments, colours."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from turnspan.functions import colours, signal
from turnspan.operators import cluster, embedding, intervals, vad, vectors
from turnspan.session import cut
from turnspan.sources import rttm, wav
from turnspan.sources.wav import AudioFormatError

__all__ = ["AudioFormatError", "Diarization", "Diarizer", "save_json", "save_rttm", "speaker_similarity"]

save_json = rttm.write_json
save_rttm = rttm.write_rttm


def speaker_similarity(a, b) -> float:
    """Cosine of two centroids, 0 if either has no length; 0.875 or more speaks for one speaker."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if n == 0 else float(np.clip(a @ b / n, -1.0, 1.0))


@dataclass
class Diarization:
    """The tables of one run, each by file_id, and the seconds its stages took on the driver's clock."""

    files: DataFrame
    speech: DataFrame
    windows: DataFrame
    raw_segments: DataFrame
    merged_segments: DataFrame
    centroids: DataFrame
    rejected: DataFrame
    timing: dict[str, float] = field(default_factory=dict)

    def colour_sets(self) -> DataFrame:
        return colours.colour_sets(self.merged_segments)

    def rows(self) -> DataFrame:
        """One row for each recording, those without speech included."""
        return intervals.result(self.files, self.raw_segments, self.merged_segments, self.centroids)


class Diarizer:
    """vad: a backend, or a name (auto, pyannote, silero, energy) with its model in `models`."""

    def __init__(
        self,
        spark: SparkSession,
        vad_backend: vad.VadBackend | str = "auto",
        embeddings: embedding.EmbeddingBackend | None = None,
        spectral: cluster.SpectralConfig = cluster.SpectralConfig(),
        density: cluster.DensityConfig = cluster.DensityConfig(),
        accelerated: bool = False,
        models: dict | None = None,
    ):
        self.spark = spark
        self.vad = vad.choose(vad_backend, accelerated, models) if isinstance(vad_backend, str) else vad_backend
        self.shape = intervals.WindowShape.for_backend(self.vad.name, accelerated)
        self.embeddings = embeddings or embedding.statistics_backend()
        self.spectral, self.density = spectral, density

    def speech(self, audio: DataFrame) -> DataFrame:
        """(file_id, seg_idx, start, end) of audio (file_id, samples)."""
        detect = self.vad.detect
        key = audio.schema["file_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(f, float(a), float(b)) for f, s in zip(pdf["file_id"], pdf["samples"]) for a, b in detect(np.asarray(s, np.float32))]
                yield pd.DataFrame(rows, columns=["file_id", "start", "end"])

        found = audio.select("file_id", "samples").mapInPandas(run, f"file_id {key}, start double, end double")
        return intervals.drop_brief(intervals.merge_gaps(found, self.vad.min_off), self.vad.min_on)

    def diarize(self, path: str, strict: bool = True) -> Diarization:
        """Diarizes all WAV files under `path`; with `strict`, one of the wrong format raises."""
        audio, rejected = wav.read_wavs(self.spark, path, strict)
        return self.diarize_audio(audio, rejected)

    def diarize_audio(self, audio: DataFrame, rejected: DataFrame | None = None) -> Diarization:
        timing, began = {}, time.time()

        def done(name: str) -> None:
            nonlocal began
            now = time.time()
            timing[name] = round(now - began, 2)
            began = now

        speech = cut(self.speech(audio))
        done("vad")
        windows = intervals.number_windows(intervals.subsegments(speech, self.shape))
        found = cut(embedding.embed(signal.features(windows, audio), self.embeddings))
        done("embeddings")
        labels = cut(cluster.cluster_files(found, self.spectral, self.density))
        done("clustering")
        named = intervals.normalise_labels(labels).select("file_id", "idx", "speaker")
        labelled = found.join(named, ["file_id", "idx"])
        raw = intervals.raw_segments(labelled.select("file_id", "idx", "speaker", "start", "end"))
        merged = intervals.merged_segments(raw)
        ranks = cut(intervals.rank_speakers(raw, merged))
        cents = vectors.centroids(labelled, by="speaker").select("file_id", "speaker", "centroid")
        done("segments")
        return Diarization(
            audio.select("file_id").distinct(), speech, found.select("file_id", "idx", "start", "end"), intervals.rename(raw, ranks), intervals.rename(merged, ranks),
            intervals.rename(cents, ranks), rejected if rejected is not None else audio.limit(0), timing,
        )


def main(args: list[str] | None = None) -> int:
    """python -m turnspan.plans.diarizer FOLDER OUT: diarizes the folder's WAV files; writes RTTM, JSON and colours."""
    import argparse

    from turnspan.session import local_session

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--vad", default="auto")
    p.add_argument("--lenient", action="store_true", help="skip recordings of the wrong format")
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    d = Diarizer(spark, a.vad).diarize(a.folder, strict=not a.lenient)
    save_rttm(d.merged_segments, f"{a.out}/rttm")
    save_json(d.merged_segments, f"{a.out}/json")
    colours.as_maps(d.colour_sets()).write.json(f"{a.out}/colours")
    print(d.timing)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
