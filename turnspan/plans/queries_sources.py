"""Queries of the annotation, colour and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspan.functions import colours
from turnspan.operators import evaluation
from turnspan.operators import intervals as iv
from turnspan.session import cut
from turnspan.sources import rttm

from . import views as v
from .registry import register

CHAIN = f"WITH RECURSIVE {v.V_SEG}, {v.RAW}, {v.GAP4}, {v.MERGED}"
LINE = "'SPEAKER ' || file_id || ' 1 ' || printf('%.3f', \"start\") || ' ' || printf('%.3f', \"end\" - \"start\") || ' <NA> <NA> ' || speaker || ' <NA> <NA>'"


def _merged(spark, sf_dir):
    return iv.merged_segments(iv.raw_segments(v.v_seg(spark, sf_dir)))


# Times are moved to odd multiples of 1/4096 s, and their differences to odd multiples of 1/2048 s:
# such numbers are exact and never lie half-way between two thousandths, so both engines print them alike.
GRID = "(floor({} * 1024) + {}) / 1024"


def _grid(df):
    g = lambda c, part: (F.floor(F.col(c) * 1024) + part) / 1024
    return df.withColumn("start", g("start", 0.25)).withColumn("end", g("end", 0.75))


ON_GRID = f"grid AS (SELECT file_id, turn, speaker, {GRID.format(chr(34) + 'start' + chr(34), 0.25)} AS \"start\", {GRID.format(chr(34) + 'end' + chr(34), 0.75)} AS \"end\" FROM merged)"


@register("rttm_format", f"{CHAIN}, {ON_GRID} SELECT file_id, turn, {LINE} AS line FROM grid")
def rttm_format(spark, sf_dir):
    m = _grid(_merged(spark, sf_dir))
    return m.select("file_id", "turn", rttm.rttm_line(F.col("file_id"), F.col("start"), F.col("end"), F.col("speaker")).alias("line"))


@register(
    "rttm_parse",
    f"""{CHAIN}, {ON_GRID}, lines AS (SELECT {LINE} AS line FROM grid), fields AS (SELECT string_split(line, ' ') AS p FROM lines)
SELECT p[2] AS file_id, p[3] AS channel, p[4]::DOUBLE AS "start", p[4]::DOUBLE + p[5]::DOUBLE AS "end", p[8] AS speaker FROM fields WHERE len(p) >= 10 AND p[1] = 'SPEAKER'""",
)
def rttm_parse(spark, sf_dir):
    return rttm.parse_lines(rttm_format(spark, sf_dir).select(F.col("line").alias("value")))


LIGHT = f"""{CHAIN}, t AS (
  SELECT file_id, speaker, sum("end" - "start") AS seconds, count(*) AS turns, min(turn) AS first FROM merged GROUP BY file_id, speaker
), s AS (
  SELECT *, 0.5::DOUBLE * (turns / sum(turns) OVER f) + 0.5::DOUBLE * (1 - seconds / sum(seconds) OVER f) AS score FROM t WINDOW f AS (PARTITION BY file_id)
), l AS (
  SELECT *, 0.325::DOUBLE + CASE WHEN max(score) OVER f = min(score) OVER f THEN 0.5::DOUBLE ELSE pow((score - min(score) OVER f) / (max(score) OVER f - min(score) OVER f), 0.33) END * (0.85::DOUBLE - 0.325::DOUBLE) AS lightness
  FROM s WINDOW f AS (PARTITION BY file_id)
)"""


@register("lightness", f"{LIGHT} SELECT file_id, speaker, turns, first, floor(seconds * 1e6 + 0.5) / 1e6 AS seconds, floor(lightness * 1e6 + 0.5) / 1e6 AS lightness FROM l")
def lightness(spark, sf_dir):
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return colours.lightness(_merged(spark, sf_dir)).withColumn("seconds", six("seconds")).withColumn("lightness", six("lightness"))


HUES = f"{LIGHT}, h AS (SELECT l.*, k AS set, ((row_number() OVER (PARTITION BY file_id, k ORDER BY seconds DESC, first) - 1 + k) * 137.508::DOUBLE) % 360 AS hue FROM l, range(10) AS r(k))"


@register("hue", f"{HUES} SELECT file_id, speaker, set::INT AS set, floor(hue * 1e6 + 0.5) / 1e6 AS hue FROM h")
def hue(spark, sf_dir):
    h = colours.hues(colours.lightness(_merged(spark, sf_dir)))
    return h.select("file_id", "speaker", "set", (F.floor(F.col("hue") * 1e6 + 0.5) / 1e6).alias("hue"))


@register("colour_sets")
def colour_sets(spark, sf_dir):
    return colours.colour_sets(_merged(spark, sf_dir))


def _perturbed(spark, sf_dir):
    """The merged segments as reference, and as hypothesis with swapped names, shifted by 0.2 s, every
    fifth segment given to the other speaker."""
    ref = cut(_merged(spark, sf_dir))
    other = F.when(F.col("speaker") == "A", "B").otherwise("A")
    hyp = ref.withColumn("speaker", F.when(F.col("turn") % 5 == 4, F.col("speaker")).otherwise(other))
    return ref, hyp.withColumn("start", F.col("start") + 0.2).withColumn("end", F.col("end") + 0.2)


DER = f"""{CHAIN}, ref AS (SELECT file_id, speaker, "start", "end" FROM merged),
hyp AS (SELECT file_id, CASE WHEN turn % 5 = 4 THEN speaker WHEN speaker = 'A' THEN 'B' ELSE 'A' END AS speaker, "start" + 0.2::DOUBLE AS "start", "end" + 0.2::DOUBLE AS "end" FROM merged),
edges AS (SELECT file_id, unnest(["start", "end"]) AS t FROM ref),
points AS (SELECT DISTINCT file_id, t FROM (SELECT file_id, unnest(["start", "end"]) AS t FROM hyp UNION ALL SELECT * FROM edges UNION ALL SELECT file_id, unnest([t - 0.125, t + 0.125]) FROM edges)),
steps AS (SELECT file_id, t AS a, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS b FROM points),
scored AS (SELECT * FROM steps s WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.file_id = s.file_id AND e.t - 0.125 <= s.a AND e.t + 0.125 >= s.b)),
who AS (
  SELECT s.file_id, s.a, s.b,
         coalesce((SELECT bool_or(speaker = 'A') FROM ref r WHERE r.file_id = s.file_id AND r."start" <= s.a AND r."end" >= s.b), false)::INT AS ra,
         coalesce((SELECT bool_or(speaker = 'B') FROM ref r WHERE r.file_id = s.file_id AND r."start" <= s.a AND r."end" >= s.b), false)::INT AS rb,
         coalesce((SELECT bool_or(speaker = 'A') FROM hyp r WHERE r.file_id = s.file_id AND r."start" <= s.a AND r."end" >= s.b), false)::INT AS ha,
         coalesce((SELECT bool_or(speaker = 'B') FROM hyp r WHERE r.file_id = s.file_id AND r."start" <= s.a AND r."end" >= s.b), false)::INT AS hb
  FROM scored s
), sums AS (
  SELECT file_id, sum((b - a) * (ra + rb)) AS total, sum((b - a) * greatest(ha + hb - ra - rb, 0)) AS false_alarm, sum((b - a) * greatest(ra + rb - ha - hb, 0)) AS missed,
         sum((b - a) * least(ra + rb, ha + hb)) AS matched, greatest(sum((b - a) * (ra * ha + rb * hb)), sum((b - a) * (ra * hb + rb * ha))) AS correct
  FROM who GROUP BY file_id
), comp AS (SELECT file_id, total, false_alarm, missed, matched - correct AS confusion, correct, CASE WHEN total > 0 THEN (false_alarm + missed + matched - correct) / total END AS der FROM sums)"""
MICRO = ", ".join(f"floor({c} * 1e5 + 0.5) / 1e5 AS {c}" for c in ("total", "false_alarm", "missed", "confusion", "correct", "der"))


@register("der_components", f"{DER} SELECT file_id, {MICRO} FROM comp")
def der_components(spark, sf_dir):
    c = evaluation.error_components(*_perturbed(spark, sf_dir))
    return c.select("file_id", *[(F.floor(F.col(x) * 1e5 + 0.5) / 1e5).alias(x) for x in ("total", "false_alarm", "missed", "confusion", "correct", "der")])


@register(
    "der_summary",
    f"""{DER} SELECT count(*) AS files, floor(sum(false_alarm + missed + confusion) / sum(total) * 1e6 + 0.5) / 1e6 AS global_der,
floor(avg(der) * 1e6 + 0.5) / 1e6 AS mean_der, floor(median(der) * 1e6 + 0.5) / 1e6 AS median_der FROM comp""",
)
def der_summary(spark, sf_dir):
    s = evaluation.summary(evaluation.error_components(*_perturbed(spark, sf_dir)))
    return s.select("files", *[(F.floor(F.col(x) * 1e6 + 0.5) / 1e6).alias(x) for x in ("global_der", "mean_der", "median_der")])
