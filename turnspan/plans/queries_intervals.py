"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspan.operators import intervals as iv
from turnspan.operators import vad

from . import views as v
from .registry import register, table

CHAIN = f"WITH RECURSIVE {v.V_SEG}, {v.RAW}, {v.GAP4}, {v.MERGED}"


def _chain(spark, sf_dir):
    raw = iv.raw_segments(v.v_seg(spark, sf_dir))
    return raw, iv.merged_segments(raw)


@register("raw_segments", f"WITH {v.V_SEG}, {v.RAW} SELECT * FROM raw")
def raw_segments(spark, sf_dir):
    return iv.raw_segments(v.v_seg(spark, sf_dir))


@register("merge_gap4", f"WITH {v.V_SEG}, {v.RAW}, {v.GAP4} SELECT * FROM gap4")
def merge_gap4(spark, sf_dir):
    return iv.merge_turns(iv.raw_segments(v.v_seg(spark, sf_dir)))


@register("merge_short", f"{CHAIN} SELECT * FROM merged")
def merge_short(spark, sf_dir):
    return _chain(spark, sf_dir)[1]


@register("speaker_rank", f"{CHAIN}, {v.RANKED} SELECT file_id, speaker, rank::INT AS rank, printf('SPEAKER_%02d', rank) AS name FROM ranked")
def speaker_rank(spark, sf_dir):
    return iv.rank_speakers(*_chain(spark, sf_dir))


@register(
    "speaker_segments",
    f"{CHAIN}, {v.RANKED} SELECT m.file_id, turn, printf('SPEAKER_%02d', rank) AS speaker, \"start\", \"end\" FROM merged m JOIN ranked r ON m.file_id = r.file_id AND m.speaker = r.speaker",
)
def speaker_segments(spark, sf_dir):
    """The flagship: from labelled windows to merged segments under ranked names."""
    raw, merged = _chain(spark, sf_dir)
    return iv.rename(merged, iv.rank_speakers(raw, merged)).select("file_id", "turn", "speaker", "start", "end")


@register(
    "speaking_time",
    f"{CHAIN} SELECT file_id, speaker, floor(sum(\"end\" - \"start\") * 1e6 + 0.5) / 1e6 AS seconds, min(turn) AS first FROM merged GROUP BY file_id, speaker",
)
def speaking_time(spark, sf_dir):
    t = iv.speaking_time(_chain(spark, sf_dir)[1])
    return t.withColumn("seconds", F.floor(F.col("seconds") * 1e6 + 0.5) / 1e6)


@register(
    "speaker_counts",
    f"""{CHAIN}, a AS (SELECT file_id, count(DISTINCT speaker) AS raw_speakers FROM raw GROUP BY file_id),
b AS (SELECT file_id, count(DISTINCT speaker) AS merged_speakers FROM merged GROUP BY file_id)
SELECT a.file_id, raw_speakers, coalesce(merged_speakers, 0) AS merged_speakers FROM a LEFT JOIN b ON a.file_id = b.file_id""",
)
def speaker_counts(spark, sf_dir):
    raw, merged = _chain(spark, sf_dir)
    a = iv.speaker_counts(raw).withColumnRenamed("speakers", "raw_speakers")
    b = iv.speaker_counts(merged).withColumnRenamed("speakers", "merged_speakers")
    return a.join(b, "file_id", "left").fillna(0, ["merged_speakers"])


@register("result_rows")
def result_rows(spark, sf_dir):
    """The nested result, a row for each file; its parts are held against SQL by the other queries."""
    raw, merged = _chain(spark, sf_dir)
    ranks = iv.rank_speakers(raw, merged)
    return iv.result(v.v_seg(spark, sf_dir).select("file_id"), iv.rename(raw, ranks), iv.rename(merged, ranks))


@register(
    "label_normalise",
    "SELECT 0::BIGINT AS file_id, vec_id AS idx, label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS rank, printf('SPEAKER_%02d', dense_rank() OVER (ORDER BY label)) AS speaker FROM embeddings",
)
def label_normalise(spark, sf_dir):
    return iv.normalise_labels(v.v_vec(spark, sf_dir).select("file_id", "idx", "label"))


@register(
    "subsegments",
    f"""WITH {v.V_VAD}, counted AS (
  SELECT *, greatest(ceil(("end" - "start" - 1.5) / 0.6::DOUBLE), 0)::INT AS n FROM vad WHERE "end" > "start"
), wins AS (
  SELECT file_id, seg_idx, i::INT AS win, "start" + i * 0.6::DOUBLE AS "start", ("start" + i * 0.6::DOUBLE) + 1.5 AS "end"
  FROM (SELECT *, unnest(range(n)) AS i FROM counted)
  UNION ALL SELECT file_id, seg_idx, n, "end" - 1.5, "end" FROM counted
) SELECT * FROM wins""",
)
def subsegments(spark, sf_dir):
    return iv.subsegments(iv.merge_gaps(v.v_vad_raw(spark, sf_dir)))


@register("vad_merge_gap", f"WITH {v.V_VAD} SELECT * FROM vad")
def vad_merge_gap(spark, sf_dir):
    return iv.merge_gaps(v.v_vad_raw(spark, sf_dir))


@register("vad_min_duration", f"WITH {v.V_VAD} SELECT * FROM vad WHERE \"end\" - \"start\" >= 0.25")
def vad_min_duration(spark, sf_dir):
    return iv.drop_brief(iv.merge_gaps(v.v_vad_raw(spark, sf_dir)))


SCORES = """scores AS (
  SELECT 0::BIGINT AS file_id, vec_id // 589 AS chunk, vec_id % 589 AS frame, list_transform(embedding[1:7], lambda x: x::DOUBLE) AS s FROM embeddings
), decoded AS (
  SELECT file_id, chunk, frame, (list_position(s, list_max(s)) - 1)::INT AS class FROM scores
)"""


@register(
    "vad_powerset",
    f"""WITH {SCORES} SELECT file_id, chunk, frame, class, class <> 0 AS active,
CASE class WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '01' WHEN 5 THEN '02' ELSE '12' END AS speakers FROM decoded""",
)
def vad_powerset(spark, sf_dir):
    out = vad.powerset(v.v_scores(spark, sf_dir)).drop("scores")
    return out.withColumn("speakers", F.array_join(F.col("speakers").cast("array<string>"), ""))


@register(
    "vad_runs",
    f"""WITH {SCORES}, marked AS (
  SELECT *, class <> 0 AS active, (class <> 0 AND NOT coalesce(lag(class <> 0) OVER w, false))::INT AS began FROM decoded WINDOW w AS (PARTITION BY file_id, chunk ORDER BY frame)
), numbered AS (
  SELECT *, sum(began) OVER (PARTITION BY file_id, chunk ORDER BY frame) AS run FROM marked
) SELECT file_id, chunk, chunk * 10.0::DOUBLE + min(frame) * 0.016875::DOUBLE AS "start", chunk * 10.0::DOUBLE + (max(frame) + 1) * 0.016875::DOUBLE AS "end"
FROM numbered WHERE active GROUP BY file_id, chunk, run""",
)
def vad_runs(spark, sf_dir):
    return iv.active_runs(vad.powerset(v.v_scores(spark, sf_dir)).select("file_id", "chunk", "frame", "active"))


@register(
    "vad_chunks",
    """SELECT file_id, chunk::INT AS chunk, chunk * 160000 AS first_sample, least(160000, n - chunk * 160000) AS samples, 160000 - least(160000, n - chunk * 160000) AS padding
FROM (SELECT doc_id AS file_id, n_chars * 100 AS n, unnest(range(0, ((n_chars * 100 + 159999) // 160000)::BIGINT)) AS chunk FROM documents WHERE n_chars > 0)""",
)
def vad_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (F.col("n_chars") * 100).alias("n_samples"))
    return vad.chunks(files)


@register(
    "turn_stats",
    "SELECT conv_id AS file_id, role AS speaker, count(*) AS turns, sum(coalesce(length(text), 0))::BIGINT AS chars, min(turn) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY sum(coalesce(length(text), 0)) DESC, min(turn))::INT AS rank FROM conversations GROUP BY conv_id, role",
)
def turn_stats(spark, sf_dir):
    from pyspark.sql.window import Window

    g = v.v_turn(spark, sf_dir).groupBy("file_id", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum("length").alias("chars"), F.min("idx").alias("first"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("chars"), "first")))
