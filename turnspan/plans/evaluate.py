"""Scores the pipeline on a folder of recordings with reference annotations, and makes such
annotations from meeting files."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnspan.operators import evaluation
from turnspan.session import cut
from turnspan.sources import meetings, rttm, wav

from .diarizer import Diarizer

FILE_SCHEMA = "file_id string, path string, seconds double, n_samples long, samples array<float>, error string"


def load_audio(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(file_id, path, seconds, n_samples, samples, error) of paths (audio_path): any readable WAV as
    16 kHz mono; a file that can't be read has its error instead of samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for stem, path, content in zip(pdf["stem"], pdf["path"], pdf["content"]):
                try:
                    x, error = wav.to_mono_16k(content), None
                except ValueError as e:
                    x, error = None, str(e)
                n = 0 if x is None else len(x)
                yield pd.DataFrame({"file_id": [stem], "path": [path], "seconds": [n / wav.RATE], "n_samples": [n], "samples": [x], "error": [error]})

    folders = [r.d for r in paths.select(F.regexp_replace("audio_path", "/[^/]*$", "").alias("d")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], FILE_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folders).select("path", "content")
    wanted = paths.select("stem", F.col("audio_path").alias("path"))
    return files.join(wanted, "path").select("stem", "path", "content").mapInPandas(run, FILE_SCHEMA)


def list_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, recordings without an annotation) of a folder, its `audio` and its `rttm`."""

    def listed(pattern: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        return files.select("path")

    return rttm.pair_files(listed("*.wav"), listed("*.rttm"))


def three_places(segments: DataFrame) -> DataFrame:
    """Segments as they come back from an RTTM file: start and duration to the millisecond."""
    lines = segments.select(rttm.rttm_line(F.col("file_id"), F.col("start"), F.col("end"), F.col("speaker")).alias("value"))
    return rttm.parse_lines(lines).select("file_id", "start", "end", "speaker")


def evaluate(spark: SparkSession, folder: str, diarizer: Diarizer | None = None, max_files: int | None = None, collar: float = evaluation.COLLAR) -> tuple[DataFrame, DataFrame]:
    """(files, summary). files: a row for each pair, with the components of the error, the numbers of
    speakers, the length, and the error text of a recording that could not be read."""
    pairs, lost = list_pairs(spark, folder)
    for r in lost.select("audio_path").take(20):
        print(f"no annotation for {r.audio_path}")
    pairs = pairs.orderBy("stem")
    pairs = cut(pairs.limit(max_files) if max_files is not None else pairs)
    audio = cut(load_audio(spark, pairs))
    good = audio.filter("error is null")
    began = time.time()
    d = (diarizer or Diarizer(spark)).diarize_audio(good.select("file_id", "samples"))
    hypothesis = cut(three_places(d.merged_segments))
    seconds = time.time() - began
    folders = [r.d for r in pairs.select(F.regexp_replace("rttm_path", "/[^/]*$", "").alias("d")).distinct().collect()]
    notes = [rttm.read_rttm(spark, f"{f}/*.rttm").withColumn("stem", rttm.stem(F.col("path"))) for f in folders]
    reference = notes[0] if notes else spark.createDataFrame([], "path string, file_id string, channel string, start double, end double, speaker string, stem string")
    for more in notes[1:]:
        reference = reference.unionByName(more)
    reference = reference.join(pairs.select("stem"), "stem").select(F.col("stem").alias("file_id"), "start", "end", "speaker")
    scored = evaluation.error_components(reference, hypothesis, collar)
    speakers = lambda s, n: s.groupBy("file_id").agg(F.count_distinct("speaker").alias(n))
    length = audio.agg(F.sum("seconds").alias("s")).first().s or 0.0
    # All files are worked on at once, so a file's time is its share, by length, of the whole.
    rows = audio.select("file_id", "error", F.col("seconds").alias("duration")).join(scored, "file_id", "left")
    rows = rows.join(speakers(reference, "reference_speakers"), "file_id", "left").join(speakers(hypothesis, "speakers"), "file_id", "left")
    rows = rows.withColumn("seconds", F.col("duration") / F.lit(max(length, 1e-9)) * F.lit(seconds)).fillna(0, ["reference_speakers", "speakers"])
    files = cut(rows.withColumn("der", F.when(F.col("error").isNull(), F.col("der"))))
    timing = files.select("file_id", F.col("seconds"), "duration")
    totals = evaluation.summary(files.filter("error is null").select("file_id", "total", "false_alarm", "missed", "confusion", "der"), timing)
    means = files.agg(F.avg("reference_speakers").alias("mean_reference_speakers"), F.avg("speakers").alias("mean_speakers"), F.count("error").alias("failed"))
    return files, totals.crossJoin(means)  # one row each


def write_results(files: DataFrame, summary: DataFrame, path: str) -> None:
    """One JSON document: the summary and the files in order."""
    listed = files.agg(F.array_sort(F.collect_list(F.struct(*files.columns))).alias("files"))
    whole = summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(listed)  # one row each
    whole.select(F.to_json(F.struct("summary", "files"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def convert_meetings(spark: SparkSession, meetings_xml: str, segments: str, out: str, names: list[str] | None = None) -> dict[str, list[str]]:
    """Writes the annotations of meetings as RTTM under out/stem=<meeting>; a meeting that is there
    already is skipped. Returns the names that were written, skipped and not found."""
    names = names or [r.meeting for r in meetings.split_meetings(spark).collect()]
    agents = meetings.read_agents(spark, meetings_xml)
    known = {r.meeting for r in agents.select("meeting").distinct().collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(f"{out}/stem={name}")
        return bool(p.getFileSystem(conf).exists(p))

    skipped = [n for n in names if there(n)]
    todo = [n for n in names if n in known and n not in skipped]
    if todo:
        rows = meetings.to_annotation(meetings.read_segments(spark, segments), agents).filter(F.col("file_id").isin(todo))
        lines = rows.select(F.col("file_id").alias("stem"), "start", rttm.rttm_line(F.col("file_id"), F.col("start"), F.col("end"), F.col("speaker")).alias("value"))
        lines.repartition("stem").sortWithinPartitions("stem", "start", "value").select("stem", "value").write.mode("append").partitionBy("stem").text(out)
    return {"written": todo, "skipped": skipped, "missing": [n for n in names if n not in known and n not in skipped]}


def main(args: list[str] | None = None) -> int:
    """python -m turnspan.plans.evaluate FOLDER OUT: scores the folder's recordings; writes one JSON document."""
    import argparse

    from turnspan.session import local_session

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--vad", default="auto")
    p.add_argument("--collar", type=float, default=evaluation.COLLAR)
    p.add_argument("--max-files", type=int)
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    files, summary = evaluate(spark, a.folder, Diarizer(spark, a.vad), a.max_files, a.collar)
    write_results(files, summary, a.out)
    summary.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
