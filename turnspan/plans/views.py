"""Fixture views over the driver tables, in Spark and as SQL common table expressions.

V_SEG: pre-labelled windows of users' events. V_VAD: speech intervals of the same. V_SCORES: class
scores of frames. V_SIG: short signals. V_VEC: labelled vectors. V_TURN: conversation turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import table


def _seconds(ts: Column) -> Column:
    """Scaled seconds since 2024-01-01 of a timestamp without zone."""
    zero = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return (F.unix_micros(ts.cast("timestamp")) - zero) / F.lit(1e6) / F.lit(14400.0)


def v_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, idx, speaker, start, end). The key is renamed before the window, so one exchange serves."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "ts", "event_id", "event_type")
    e = e.withColumn("idx", F.row_number().over(Window.partitionBy("file_id").orderBy("ts", "event_id")))
    speaker = F.when(F.col("event_type").isin("click", "view", "error"), F.lit("A")).otherwise(F.lit("B"))
    start = _seconds(F.col("ts"))
    return e.select("file_id", "idx", speaker.alias("speaker"), start.alias("start"), (start + 1.5).alias("end"))


def v_vad_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, start, end): intervals that may overlap."""
    start = _seconds(F.col("ts"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), start.alias("start"), (start + 0.25 + F.col("value") / 20).alias("end"))


def v_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, chunk, frame, scores): frames of 10-second chunks of 589 frames."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 7).cast("array<double>").alias("scores"))
    return v.select(F.lit(0).cast("long").alias("file_id"), (F.col("vec_id") / 589).cast("long").alias("chunk"), (F.col("vec_id") % 589).alias("frame"), "scores")


def v_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("file_id"), F.col("vec_id").alias("idx"), "embedding", "label")


def v_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), F.coalesce(F.length("text"), F.lit(0)).alias("length"))


SECONDS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE / 14400.0::DOUBLE)"

V_SEG = f"""v_seg AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN 'A' ELSE 'B' END AS speaker,
         {SECONDS} AS "start", {SECONDS} + 1.5::DOUBLE AS "end"
  FROM events
)"""
RAW = """clamped AS (
  SELECT file_id, idx, speaker, greatest(0::DOUBLE, "start") AS s, greatest(0::DOUBLE, "end") AS e FROM v_seg
), seen AS (
  SELECT *, lag(e) OVER w AS le, lag(s) OVER w AS prev_s, lag(speaker) OVER w AS ls FROM clamped WINDOW w AS (PARTITION BY file_id ORDER BY idx)
), marked AS (
  SELECT *, coalesce(speaker <> ls AND s < le, false) AS cut, (le IS NULL OR speaker <> ls OR s > le) AS fresh FROM seen
), bounded AS (
  SELECT *, CASE WHEN cut THEN greatest(0::DOUBLE, (le + s) / 2) ELSE s END AS a,
         CASE WHEN coalesce(lead(cut) OVER w, false) THEN greatest(0::DOUBLE, (e + lead(s) OVER w) / 2) ELSE e END AS b,
         sum(fresh::INT) OVER w - 1 AS sid
  FROM marked WINDOW w AS (PARTITION BY file_id ORDER BY idx)
), raw AS (
  SELECT file_id, sid::BIGINT AS sid, max(speaker) AS speaker, arg_min(a, idx) AS "start", arg_max(b, idx) AS "end" FROM bounded GROUP BY file_id, sid
)"""
GAP4 = """turns0 AS (
  SELECT *, coalesce(speaker = lag(speaker) OVER w AND "start" - lag("end") OVER w <= 4, false) AS same FROM raw WINDOW w AS (PARTITION BY file_id ORDER BY sid)
), turns1 AS (
  SELECT *, sum((NOT same)::INT) OVER (PARTITION BY file_id ORDER BY sid) - 1 AS mid FROM turns0
), gap4 AS (
  SELECT file_id, mid::BIGINT AS mid, max(speaker) AS speaker, arg_min("start", sid) AS "start", arg_max("end", sid) AS "end" FROM turns1 GROUP BY file_id, mid
)"""
#: Needs WITH RECURSIVE.
MERGED = """walk AS (
  SELECT file_id, mid, CASE WHEN "end" - "start" <= 0.78 THEN NULL ELSE speaker END AS last, "end" - "start" <= 0.78 AS pending,
         CASE WHEN "end" - "start" <= 0.78 THEN 'd' ELSE 'k' END AS code
  FROM gap4 WHERE mid = 0
  UNION ALL
  SELECT g.file_id, g.mid,
         CASE WHEN w.pending AND w.last IS NOT DISTINCT FROM g.speaker THEN w.last WHEN g."end" - g."start" <= 0.78 THEN w.last ELSE g.speaker END,
         NOT (w.pending AND w.last IS NOT DISTINCT FROM g.speaker) AND g."end" - g."start" <= 0.78,
         CASE WHEN w.pending AND w.last IS NOT DISTINCT FROM g.speaker THEN 'a' WHEN g."end" - g."start" <= 0.78 THEN 'd' ELSE 'k' END
  FROM walk w JOIN gap4 g ON g.file_id = w.file_id AND g.mid = w.mid + 1
), kept AS (
  SELECT g.*, sum((code = 'k')::INT) OVER (PARTITION BY g.file_id ORDER BY g.mid) - 1 AS turn
  FROM gap4 g JOIN walk w ON g.file_id = w.file_id AND g.mid = w.mid WHERE code <> 'd'
), merged AS (
  SELECT file_id, turn::BIGINT AS turn, arg_min(speaker, mid) AS speaker, arg_min("start", mid) AS "start", arg_max("end", mid) AS "end" FROM kept GROUP BY file_id, turn
)"""
RANKED = """raw_time AS (
  SELECT file_id, speaker, sum("end" - "start") AS seconds, min(sid) AS first FROM raw GROUP BY file_id, speaker
), merged_time AS (
  SELECT file_id, speaker, sum("end" - "start") AS ms, min(turn) AS mf FROM merged GROUP BY file_id, speaker
), ranked AS (
  SELECT r.file_id, r.speaker, r.seconds, m.ms,
         row_number() OVER (PARTITION BY r.file_id ORDER BY (m.ms IS NULL), m.ms DESC, m.mf, r.seconds DESC, r.first) AS rank
  FROM raw_time r LEFT JOIN merged_time m ON r.file_id = m.file_id AND r.speaker = m.speaker
)"""
V_VAD = f"""vad_raw AS (
  SELECT user_id AS file_id, {SECONDS} AS "start", {SECONDS} + 0.25::DOUBLE + value / 20::DOUBLE AS "end" FROM events
), vad_reach AS (
  SELECT *, max("end") OVER (PARTITION BY file_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM vad_raw
), vad_seg AS (
  SELECT *, sum(coalesce(("start" - reach > 0.1)::INT, 1)) OVER (PARTITION BY file_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM vad_reach
), vad AS (
  SELECT file_id, seg::BIGINT AS seg_idx, min("start") AS "start", max("end") AS "end" FROM vad_seg GROUP BY file_id, seg
)"""
