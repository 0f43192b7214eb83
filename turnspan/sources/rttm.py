"""RTTM annotation files, read and written with Spark's text source; segments as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(file_id, channel, start, end, speaker, ...) of SPEAKER lines with ten fields or more; blank
    lines, comments, other records and lines whose times are no numbers are skipped."""
    part = F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")
    rows = lines.withColumn("__p", part).filter(F.size("__p") >= 10)
    at = lambda i: F.col("__p").getItem(i)
    rows = rows.filter((at(0) == "SPEAKER") & ~at(0).startswith("#"))
    start, length = F.expr("try_cast(__p[3] as double)"), F.expr("try_cast(__p[4] as double)")
    rest = [c for c in lines.columns if c != line]
    out = rows.select(*rest, at(1).alias("file_id"), at(2).alias("channel"), start.alias("start"), (start + length).alias("end"), at(7).alias("speaker"))
    return out.filter("start is not null and end is not null")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Segments of RTTM files with the file's path. Of lines with the same times, the last counts."""
    # A line's place in its file is not kept by the text source, so whole files are split instead.
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = parse_lines(files)
    last = F.row_number().over(Window.partitionBy("path", "file_id", "start", "end").orderBy(F.desc("line")))
    return rows.withColumn("__n", last).filter("__n = 1").drop("__n", "line")


def rttm_line(file_id: Column, start: Column, end: Column, speaker: Column) -> Column:
    return F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", file_id.cast("string"), start, end - start, speaker)


def write_rttm(segments: DataFrame, path: str) -> None:
    """One folder `stem=<file_id>` for each file, its lines in order of start."""
    rows = segments.select(F.col("file_id").cast("string").alias("stem"), "start", rttm_line(F.col("file_id"), F.col("start"), F.col("end"), F.col("speaker")).alias("value"))
    rows.repartition("stem").sortWithinPartitions("stem", "start", "value").select("stem", "value").write.partitionBy("stem").text(path)


def write_json(segments: DataFrame, path: str) -> None:
    """One JSON document for each file, a list of its segments in order, in a folder of its own."""
    items = F.array_sort(F.collect_list(F.struct("start", "end", "speaker")))
    rows = segments.groupBy(F.col("file_id").cast("string").alias("stem")).agg(F.to_json(items, {"pretty": "true"}).alias("value"))
    rows.write.partitionBy("stem").text(path)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pair_files(audio: DataFrame, rttm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unmatched) of two listings (path): audio and annotations that share a stem. Of several
    annotations the one in the root comes first, then `audio/`, then `rttm/`."""
    folder = F.element_at(F.split("path", "/"), -2)
    order = F.when(folder == "rttm", 2).when(folder == "audio", 1).otherwise(0)
    best = rttm.select(stem(F.col("path")).alias("stem"), F.col("path").alias("rttm_path"), order.alias("order"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("order", "rttm_path"))).filter("n = 1").select("stem", "rttm_path")
    named = audio.select(stem(F.col("path")).alias("stem"), F.col("path").alias("audio_path"))
    return named.join(best, "stem"), named.join(best, "stem", "left_anti")
