"""Interval operators: windows over speech, gap merging, and turning labelled windows into segments.

Every table has a `file_id`; order inside a file is `idx` (or start). All window functions of a chain
partition by file_id and sort by the same column, so one exchange serves the chain. Times are
seconds, double. Nulls: rows with a null file_id form a file of their own; a null time or speaker
leaves its row's derived values null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the pipeline.
MIN_ON, MIN_OFF = 0.25, 0.1
MERGE_GAP, SHORT = 4.0, 0.78
SPECTRAL_BELOW = 1200.0


@dataclass(frozen=True)
class WindowShape:
    """Length and shift of the windows cut from speech."""

    length: float = 1.5
    shift: float = 1.5 / 2.5

    @classmethod
    def for_backend(cls, vad: str, accelerated: bool) -> WindowShape:
        return cls(1.45, 1.45 / 3.0) if vad == "pyannote" and accelerated else cls()


def _in_file(order: str = "idx") -> Window:
    return Window.partitionBy("file_id").orderBy(order)


def subsegments(vad: DataFrame, shape: WindowShape = WindowShape(), exact_ties: bool = False) -> DataFrame:
    """Windows of fixed length over each speech interval (file_id, seg_idx, start, end): one at each
    shift while it ends before the interval does, and a last one that ends with it.

    A shorter interval gives one window that reaches back before its start. With `exact_ties`, window
    starts come from repeated addition, as a sequential reader would make them; otherwise in closed form.
    """
    d, s = shape.length, shape.shift
    if exact_ties:
        most = F.greatest(F.ceil((F.col("end") - F.col("start") - d) / s) + 2, F.lit(0))
        first = F.struct(F.col("start").alias("t"), F.expr("cast(array() as array<double>)").alias("out"))
        starts = F.aggregate(
            F.when(most > 0, F.sequence(F.lit(1), most.cast("int"))).otherwise(F.expr("cast(array() as array<int>)")),
            first,
            lambda a, _: F.when(a["t"] + d < F.col("end"), F.struct((a["t"] + s).alias("t"), F.concat(a["out"], F.array(a["t"])).alias("out"))).otherwise(a),
            lambda a: a["out"],
        )
    else:
        n = F.greatest(F.ceil((F.col("end") - F.col("start") - d) / s), F.lit(0)).cast("int")
        starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("start") + i * F.lit(s))).otherwise(F.expr("cast(array() as array<double>)"))
    whole = F.transform(starts, lambda t: F.struct(t.alias("start"), (t + d).alias("end")))
    tail = F.array(F.struct((F.col("end") - d).alias("start"), F.col("end").alias("end")))
    rows = vad.filter("end > start").select("file_id", "seg_idx", F.posexplode(F.concat(whole, tail)).alias("win", "w"))
    return rows.select("file_id", "seg_idx", "win", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def number_windows(windows: DataFrame) -> DataFrame:
    """Adds idx, the windows' number in their file by interval and place."""
    return windows.withColumn("idx", F.row_number().over(Window.partitionBy("file_id").orderBy("seg_idx", "win")) - 1)


def active_runs(frames: DataFrame, step: float = 0.016875, chunk_seconds: float = 10.0) -> DataFrame:
    """Runs of active frames (file_id, chunk, frame, active) as intervals [first, first inactive)."""
    w = Window.partitionBy("file_id", "chunk").orderBy("frame")
    started = F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))
    runs = frames.withColumn("run", F.sum(started.cast("int")).over(w)).filter("active")
    offset = F.col("chunk") * F.lit(chunk_seconds)
    return runs.groupBy("file_id", "chunk", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select(
        "file_id", "chunk", (offset + F.col("a") * F.lit(step)).alias("start"), (offset + (F.col("b") + 1) * F.lit(step)).alias("end")
    )


def merge_gaps(intervals: DataFrame, gap: float = MIN_OFF) -> DataFrame:
    """Joins intervals (file_id, start, end) that are at most `gap` apart; the end of what came
    before is a running maximum, as intervals may be nested."""
    w = Window.partitionBy("file_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - reach) > gap, F.lit(True))
    grouped = intervals.select("file_id", "start", "end").withColumn("seg", F.sum(new.cast("int")).over(w))
    return grouped.groupBy("file_id", "seg").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("file_id", (F.col("seg") - 1).alias("seg_idx"), "start", "end")


def drop_brief(intervals: DataFrame, least: float = MIN_ON) -> DataFrame:
    """Intervals of at least `least` seconds; goes after merge_gaps."""
    return intervals.filter((F.col("end") - F.col("start")) >= least)


def speaker_name(rank: Column) -> Column:
    return F.format_string("SPEAKER_%02d", rank.cast("int"))


def normalise_labels(labels: DataFrame) -> DataFrame:
    """Adds rank (0, 1, ... by label in each file) and speaker to (file_id, label, ...)."""
    rank = F.dense_rank().over(Window.partitionBy("file_id").orderBy("label")) - 1
    return labels.withColumn("rank", rank).withColumn("speaker", speaker_name(F.col("rank") + 1))


def raw_segments(windows: DataFrame) -> DataFrame:
    """Folds labelled windows (file_id, idx, start, end, speaker) into raw segments.

    Times below zero become zero. A window of the same speaker extends the segment unless it begins
    after its end; one of another speaker begins a new segment and, if they overlap, both are cut at
    the middle. Only the window before matters, so this is lag and lead over one sort.
    """
    w = _in_file()
    z = F.lit(0.0)
    t = windows.select("file_id", "idx", "speaker", F.greatest(z, "start").alias("s"), F.greatest(z, "end").alias("e"))
    t = t.withColumn("le", F.lag("e").over(w)).withColumn("ls", F.lag("speaker").over(w))
    other = F.col("speaker") != F.col("ls")
    t = t.withColumn("cut", F.coalesce(other & (F.col("s") < F.col("le")), F.lit(False)))
    t = t.withColumn("new", F.col("le").isNull() | other | (F.col("s") > F.col("le")))
    t = t.withColumn("start", F.when(F.col("cut"), F.greatest(z, (F.col("le") + F.col("s")) / 2)).otherwise(F.col("s")))
    ahead = F.greatest(z, (F.col("e") + F.lead("s").over(w)) / 2)
    t = t.withColumn("end", F.when(F.coalesce(F.lead("cut").over(w), F.lit(False)), ahead).otherwise(F.col("e")))
    t = t.withColumn("sid", F.sum(F.col("new").cast("int")).over(w) - 1)
    return t.groupBy("file_id", "sid").agg(
        F.max("speaker").alias("speaker"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end")
    )


def merge_turns(segments: DataFrame, gap: float = MERGE_GAP) -> DataFrame:
    """Joins consecutive segments (file_id, sid, speaker, start, end) of one speaker at most `gap` apart."""
    w = _in_file("sid")
    same = (F.col("speaker") == F.lag("speaker").over(w)) & (F.col("start") - F.lag("end").over(w) <= gap)
    t = segments.withColumn("mid", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w) - 1)
    return t.groupBy("file_id", "mid").agg(
        F.max("speaker").alias("speaker"), F.min_by("start", "sid").alias("start"), F.max_by("end", "sid").alias("end")
    )


def drop_short_turns(segments: DataFrame, short: float = SHORT) -> DataFrame:
    """Removes segments (file_id, mid, speaker, start, end) of at most `short` seconds; if those on
    either side of one are of one speaker, the left takes in the right, whatever the gap.

    A segment longer than `short` is always kept or taken in, so the one on the left of each is of the
    last long segment's speaker. A short one is dropped, unless it is of that speaker and one was
    dropped since that speaker's last: then it is taken in. Short ones of that speaker in a row thus
    take turns, and their number since the last other row tells which. All is window functions over
    one sort, linear in a file's segments. A null speaker is nobody's; a null time is not short.
    """
    w = _in_file("mid")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = segments.withColumn("pos", F.row_number().over(w)).withColumn("brief", F.coalesce(F.col("end") - F.col("start") <= short, F.lit(False)))
    t = t.withColumn("last", F.last(F.when(~F.col("brief"), F.struct("speaker")), ignorenulls=True).over(before))
    t = t.withColumn("own", F.coalesce(F.col("speaker") == F.col("last.speaker"), F.lit(False)))
    other = F.when(~F.col("brief") | ~F.col("own"), F.struct("pos", "brief"))
    t = t.withColumn("other", F.last(other, ignorenulls=True).over(before))
    odd = (F.col("pos") - 1 - F.col("other.pos")) % 2 == 1
    taken = F.col("own") & F.coalesce(F.col("other.brief") != odd, F.lit(False))
    t = t.withColumn("taken", taken).filter("taken or not brief")
    t = t.withColumn("turn", F.sum((~F.col("taken")).cast("int")).over(w) - 1)
    return t.groupBy("file_id", "turn").agg(
        F.min_by("speaker", "mid").alias("speaker"), F.min_by("start", "mid").alias("start"), F.max_by("end", "mid").alias("end")
    )


def merged_segments(raw: DataFrame) -> DataFrame:
    """Gap merging and short removal: (file_id, turn, speaker, start, end)."""
    return drop_short_turns(merge_turns(raw))


def speaking_time(segments: DataFrame, order: str = "turn") -> DataFrame:
    """(file_id, speaker, seconds, first): total time and first place of each speaker."""
    return segments.groupBy("file_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.min(order).alias("first"))


def rank_speakers(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """(file_id, speaker, rank, name): speakers by merged time, longest first, then first appearance;
    those without a merged segment come last, by raw time."""
    m = speaking_time(merged).withColumnsRenamed({"seconds": "ms", "first": "mf"})
    r = speaking_time(raw, "sid")
    both = r.join(m, ["file_id", "speaker"], "left")
    order = [F.col("ms").isNull(), F.desc("ms"), F.col("mf"), F.desc("seconds"), F.col("first")]
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(*order))
    return both.select("file_id", "speaker", rank.alias("rank"), speaker_name(rank).alias("name"))


def rename(segments: DataFrame, ranks: DataFrame) -> DataFrame:
    """Puts the ranked names in place of the speakers, once."""
    named = segments.join(ranks.select("file_id", "speaker", "name"), ["file_id", "speaker"], "left")
    return named.withColumn("speaker", F.coalesce("name", "speaker")).select(*segments.columns)


def speaker_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("file_id").agg(F.count_distinct("speaker").alias("speakers"))


def result(files: DataFrame, raw: DataFrame, merged: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """One row for each file, those without speech included: raw and merged segments, the numbers of
    speakers, and the centroids by speaker."""

    def nested(s: DataFrame, order: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "start", "end", "speaker")))
        plain = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker")))
        return s.groupBy("file_id").agg(plain.alias(f"{name}_segments"), F.count_distinct("speaker").alias(f"{name}_speakers_detected"))

    out = files.select("file_id").distinct().join(nested(raw, "sid", "raw"), "file_id", "left").join(nested(merged, "turn", "merged"), "file_id", "left")
    if centroids is not None:
        by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "centroid"))))
        out = out.join(centroids.groupBy("file_id").agg(by.alias("speaker_centroids")), "file_id", "left")
    return out.fillna(0, ["raw_speakers_detected", "merged_speakers_detected"])
