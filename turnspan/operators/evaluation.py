"""Diarization error rate: a sweep over elementary intervals, the best one-to-one mapping of
speakers by file, and totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnspan.session import cut

COLLAR = 0.25
BUCKET = 10.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost one-to-one pairs (row, column) of a matrix, by shortest augmenting paths."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            reduced = c[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            free = np.where(used[1:], np.inf, least[1:])
            k = int(free.argmin()) + 1
            delta = free[k - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if turned else pairs


def elementary(reference: DataFrame, hypothesis: DataFrame, collar: float = COLLAR) -> DataFrame:
    """(file_id, a, b): the stretches between neighbouring boundaries that are scored: all but those
    within half the collar of a reference boundary, from the first boundary to the last."""
    half = collar / 2
    edges = reference.select("file_id", F.explode(F.array("start", "end")).alias("t"))
    wide = edges.select("file_id", (F.col("t") - half).alias("l"), (F.col("t") + half).alias("r"))
    both = reference.select("file_id", "start", "end").unionByName(hypothesis.select("file_id", "start", "end"))
    points = both.select("file_id", F.explode(F.array("start", "end")).alias("t"))
    if half > 0:
        points = points.unionByName(wide.select("file_id", F.explode(F.array("l", "r")).alias("t")))
    # A sweep: collars open and close like brackets, so whether a stretch lies in one is a running sum.
    marks = points.select("file_id", "t", F.lit(0).alias("d"))
    if half > 0:
        marks = marks.unionByName(wide.select("file_id", F.col("l").alias("t"), F.lit(1).alias("d"))).unionByName(wide.select("file_id", F.col("r").alias("t"), F.lit(-1).alias("d")))
    at = marks.groupBy("file_id", "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("file_id").orderBy("t")
    swept = at.withColumn("open", F.sum("d").over(w)).withColumn("next", F.lead("t").over(w))
    return swept.filter("next is not null and open = 0").select("file_id", F.col("t").alias("a"), F.col("next").alias("b"))


def active(stretches: DataFrame, segments: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """(file_id, a, b, speaker): who speaks in each stretch, once for each of their segments there. A
    range join on equal buckets of time."""
    parts = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    s = segments.filter("end > start").select("file_id", "speaker", "start", "end", parts("start", "end").alias("bucket"))
    e = stretches.withColumn("bucket", F.floor((F.col("a") + F.col("b")) / 2 / bucket))
    return e.join(s, ["file_id", "bucket"]).filter("start <= a and b <= end").select("file_id", "a", "b", "speaker")


def stretch_counts(reference: DataFrame, hypothesis: DataFrame, collar: float = COLLAR) -> DataFrame:
    """(file_id, a, b, ref, hyp): for each scored stretch in which anyone speaks, the sets of speakers."""
    e = elementary(reference, hypothesis, collar)
    side = lambda s, n: s.select("file_id", "start", "end", F.struct(F.lit(n).alias("side"), F.col("speaker").alias("name")).alias("speaker"))
    who = active(e, side(reference, 0).unionByName(side(hypothesis, 1)))
    of = lambda n: F.array_sort(F.collect_set(F.when(F.col("speaker.side") == n, F.col("speaker.name"))))
    return who.groupBy("file_id", "a", "b").agg(of(0).alias("ref"), of(1).alias("hyp"))


def overlaps(stretches: DataFrame) -> DataFrame:
    """(file_id, ref, hyp, seconds): time that each pair of speakers shares."""
    pairs = stretches.select("file_id", (F.col("b") - F.col("a")).alias("d"), F.explode("ref").alias("r"), "hyp").select("file_id", "d", "r", F.explode("hyp").alias("h"))
    return pairs.groupBy("file_id", "r", "h").agg(F.sum("d").alias("seconds"))


def best_mapping(shared: DataFrame) -> DataFrame:
    """(file_id, to): the one-to-one mapping (a map from reference to hypothesis speakers) that shares
    the most time in each file. A row holds the pairs of one file's speakers; rows go to Python in batches."""

    @F.pandas_udf("map<string, string>")
    def solved(refs: pd.Series, hyps: pd.Series, seconds: pd.Series) -> pd.Series:
        def one(r, h, s) -> dict[str, str]:
            (rows, i), (columns, j) = (np.unique(np.asarray(x, dtype=str), return_inverse=True) for x in (r, h))
            time = np.zeros((len(rows), len(columns)))
            np.add.at(time, (i, j), s)
            return {str(rows[a]): str(columns[b]) for a, b in assign(-time) if time[a, b] > 0}

        return pd.Series([one(*x) for x in zip(refs, hyps, seconds)], dtype=object)

    named = shared.filter("r is not null and h is not null").groupBy("file_id").agg(F.collect_list(F.struct("r", "h", "seconds")).alias("pairs"))
    return named.select("file_id", solved("pairs.r", "pairs.h", "pairs.seconds").alias("to"))


def error_components(reference: DataFrame, hypothesis: DataFrame, collar: float = COLLAR) -> DataFrame:
    """(file_id, total, false_alarm, missed, confusion, correct, der), overlapped speech scored; a
    file of only one of the two tables is scored too. der is null where no time counts."""
    s = cut(stretch_counts(reference, hypothesis, collar))  # read twice: for the mapping and for the sums
    s = s.join(best_mapping(overlaps(s)), "file_id", "left")
    d, nr, nh = F.col("b") - F.col("a"), F.size("ref"), F.size("hyp")
    right = F.coalesce(F.expr("size(filter(ref, r -> array_contains(hyp, to[r])))"), F.lit(0))
    right = F.when(F.col("to").isNull(), F.lit(0)).otherwise(right)
    sums = s.groupBy("file_id").agg(
        F.sum(d * nr).alias("total"),
        F.sum(d * F.greatest(nh - nr, F.lit(0))).alias("false_alarm"),
        F.sum(d * F.greatest(nr - nh, F.lit(0))).alias("missed"),
        F.sum(d * (F.least(nr, nh) - right)).alias("confusion"),
        F.sum(d * right).alias("correct"),
    )
    files = reference.select("file_id").union(hypothesis.select("file_id")).distinct()
    out = files.join(sums, "file_id", "left").fillna(0.0)
    return out.withColumn("der", F.when(F.col("total") > 0, (F.col("false_alarm") + F.col("missed") + F.col("confusion")) / F.col("total")))


def summary(components: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """One row: the global rate (sums over files), mean and median rate, and with timing
    (file_id, seconds, duration) the real-time factors."""
    c = components if timing is None else components.join(timing, "file_id", "left")
    aggs = [
        F.count(F.lit(1)).alias("files"),
        (F.sum(F.col("false_alarm") + F.col("missed") + F.col("confusion")) / F.nullif(F.sum("total"), F.lit(0.0))).alias("global_der"),
        F.avg("der").alias("mean_der"),
        F.percentile("der", 0.5).alias("median_der"),
    ]
    if timing is not None:
        rtf = F.col("seconds") / F.nullif(F.col("duration"), F.lit(0.0))
        aggs += [F.avg(rtf).alias("mean_rtf"), F.min(rtf).alias("min_rtf"), F.max(rtf).alias("max_rtf"), (F.sum("seconds") / F.nullif(F.sum("duration"), F.lit(0.0))).alias("global_rtf")]
    return c.agg(*aggs)
