"""Queries of the signal operators, on embedding vectors taken as signals of 64 samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from turnspan.functions import signal

from .registry import register, table

SIG = "sig AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
WHOLE = "array_to_string(list_transform({}, lambda v: floor(v * 1e6 + 0.5)::BIGINT), ' ')"


def _sig(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _whole(c):
    """Values as whole millionths, joined: the last digits differ between the engines' libraries."""
    return F.array_join(F.transform(c, lambda v: F.floor(v * 1e6 + 0.5).cast("string")), " ")


@register("dc_removal", f"WITH {SIG} SELECT id, {WHOLE.format('list_transform(x, lambda y: y - list_sum(x) / len(x))')} AS y FROM sig")
def dc_removal(spark, sf_dir):
    return _sig(spark, sf_dir).select("id", _whole(signal.remove_mean(F.col("x"))).alias("y"))


@register("preemphasis", f"WITH {SIG} SELECT id, {WHOLE.format('list_transform(x, lambda y, i: y - 0.97::DOUBLE * x[greatest(i - 1, 1)])')} AS y FROM sig")
def preemphasis(spark, sf_dir):
    return _sig(spark, sf_dir).select("id", _whole(signal.preemphasise(F.col("x"))).alias("y"))


def _window_sql(form: str) -> str:
    return f"WITH {SIG} SELECT id, {WHOLE.format(f'list_transform(x, lambda y, i: y * ({form}))')} AS y FROM sig"


_A = f"({2 * math.pi!r} * (i - 1) / (len(x) - 1))"
_FORMS = {
    "povey": f"pow(0.5 - 0.5 * cos({_A}), 0.85)",
    "hanning": f"0.5 - 0.5 * cos({_A})",
    "hamming": f"0.54 - 0.46 * cos({_A})",
    "sine": f"sin({_A} / 2)",
    "blackman": f"0.42 - 0.5 * cos({_A}) + 0.08 * cos(2 * {_A})",
    "rectangular": "1.0",
}


def _window_query(kind):
    @register(kind if kind == "povey" else f"window_{kind}", _window_sql(_FORMS[kind]))
    def query(spark, sf_dir):
        return _sig(spark, sf_dir).select("id", _whole(signal.windowed(F.col("x"), kind)).alias("y"))

    return query


for _kind in _FORMS:
    _window_query(_kind)


@register(
    "cmn",
    f"""WITH {SIG}, long AS (SELECT id // 10 AS file_id, 0::BIGINT AS idx, id % 10 AS frame, i - 1 AS bin, x[i] AS v FROM (SELECT id, x, unnest(range(1, 65)) AS i FROM sig))
SELECT file_id, idx, frame, bin, floor((v - avg(v) OVER (PARTITION BY file_id, idx, bin)) * 1e6 + 0.5) / 1e6 AS v FROM long""",
)
def cmn(spark, sf_dir):
    """Ten neighbouring vectors stand for the frames of one window."""
    s = _sig(spark, sf_dir).select((F.col("id") / 10).cast("long").alias("file_id"), F.lit(0).cast("long").alias("idx"), (F.col("id") % 10).alias("frame"), F.posexplode("x").alias("bin", "v"))
    return signal.mean_normalise(s.withColumn("bin", F.col("bin").cast("long"))).withColumn("v", F.floor(F.col("v") * 1e6 + 0.5) / 1e6)


@register(
    "dft_power",
    f"""WITH {SIG}, long AS (SELECT id, i - 1 AS i, x[i] AS v FROM (SELECT id, x, unnest(range(1, 65)) AS i FROM sig)),
parts AS (SELECT id, bin, sum(v * cos({2 * math.pi!r} * ((bin * i) % 64) / 64)) AS re, sum(v * sin({2 * math.pi!r} * ((bin * i) % 64) / 64)) AS im FROM long, range(32) AS b(bin) GROUP BY id, bin)
SELECT id, bin, floor((re * re + im * im) * 1e6 + 0.5) / 1e6 AS power FROM parts""",
)
def dft_power(spark, sf_dir):
    return signal.dft_power(_sig(spark, sf_dir), 64).withColumn("power", F.floor(F.col("power") * 1e6 + 0.5) / 1e6)


@register(
    "mel_filterbank",
    """WITH c AS (SELECT 1127.0::DOUBLE * ln(1 + 20.0::DOUBLE / 700) AS lo, 1127.0::DOUBLE * ln(1 + 8000.0::DOUBLE / 700) AS hi),
g AS (SELECT bin, fft_bin, 1127.0::DOUBLE * ln(1 + fft_bin * 31.25::DOUBLE / 700) AS m, lo + bin * ((hi - lo) / 81) AS l, lo + (bin + 1) * ((hi - lo) / 81) AS c, lo + (bin + 2) * ((hi - lo) / 81) AS r
FROM c, range(80) AS b(bin), range(256) AS f(fft_bin))
SELECT bin, fft_bin, floor(CASE WHEN m <= c THEN (m - l) / (c - l) ELSE (r - m) / (r - c) END * 1e6 + 0.5) / 1e6 AS weight FROM g WHERE m > l AND m < r""",
)
def mel_filterbank(spark, sf_dir):
    return signal.mel_filterbank(spark).withColumn("weight", F.floor(F.col("weight") * 1e6 + 0.5) / 1e6)


@register("frame_count", "SELECT doc_id, (1 + (greatest(n_chars * 10, 400) - 400) // 160)::INT AS frames FROM documents")
def frame_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", signal.frames_in(F.col("n_chars") * 10).alias("frames"))


@register("fft_size", "SELECT DISTINCT n_chars AS n, pow(2, ceil(log2(n_chars)))::INT AS size FROM documents WHERE n_chars > 0")
def fft_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("n_chars > 0").select(F.col("n_chars").alias("n")).distinct()
    return d.select("n", signal.power_of_two(F.col("n")).alias("size"))
