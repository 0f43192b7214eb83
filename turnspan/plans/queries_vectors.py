"""Queries of the vector and clustering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnspan.operators import cluster, vectors

from . import views as v
from .registry import register

VEC = "vec AS (SELECT 0::BIGINT AS file_id, vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings)"
CENT = f"""{VEC}, long AS (
  SELECT file_id, label, d, e[d] AS x FROM (SELECT file_id, label, e, unnest(range(1, len(e) + 1)) AS d FROM vec)
), means AS (SELECT file_id, label, d, avg(x) AS x, count(*) AS n FROM long GROUP BY file_id, label, d),
cent AS (SELECT file_id, label, list(x ORDER BY d) AS c, max(n) AS n FROM means GROUP BY file_id, label)"""
SIX = "floor({} * 1e6 + 0.5) / 1e6"


def _six(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


@register("centroids", f"WITH {CENT} SELECT file_id, label, n, array_to_string(list_transform(c, lambda x: floor(x * 1e6 + 0.5)::BIGINT), ' ') AS centroid FROM cent")
def centroids(spark, sf_dir):
    """Components as whole millionths, joined: sums come in another order in each engine."""
    c = vectors.centroids(v.v_vec(spark, sf_dir))
    whole = F.transform("centroid", lambda x: F.floor(x * 1e6 + 0.5).cast("string"))
    return c.select("file_id", "label", "n", F.array_join(whole, " ").alias("centroid"))


@register(
    "speaker_similarity",
    f"""WITH {CENT} SELECT a.file_id, a.label AS a, b.label AS b, {SIX.format("list_cosine_similarity(a.c, b.c)")} AS similarity
FROM cent a JOIN cent b ON a.file_id = b.file_id AND a.label < b.label""",
)
def speaker_similarity(spark, sf_dir):
    c = vectors.centroids(v.v_vec(spark, sf_dir))
    return vectors.pair_similarity(c, "label").withColumn("similarity", _six(F.col("similarity")))


SIMS = f"""{VEC}, sims AS (
  SELECT a.file_id, a.idx AS i, b.idx AS j, greatest(-1, least(1, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))) AS sim
  FROM vec a JOIN vec b ON a.file_id = b.file_id
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, i ORDER BY {SIX.format("sim")} DESC, j) AS rank, count(*) OVER (PARTITION BY file_id, i) AS n FROM sims
), pruned AS (SELECT file_id, i, j, {SIX.format("sim")} AS sim, rank FROM numbered WHERE rank <= n - least(floor((1 - 0.012::DOUBLE) * n), n - 6))"""


@register("sim_topk", f"WITH {SIMS} SELECT file_id, i, j, sim, rank::INT AS rank FROM pruned")
def sim_topk(spark, sf_dir):
    """All vectors are of one file."""
    return vectors.pruned_affinity(v.v_vec(spark, sf_dir), digits=6)


SYM = f"""{SIMS}, half AS (
  SELECT file_id, i, j, sim * 0.5 AS w FROM pruned UNION ALL SELECT file_id, j, i, sim * 0.5 FROM pruned
), sym AS (SELECT file_id, i, j, sum(w) AS w FROM half WHERE i <> j GROUP BY file_id, i, j)"""


@register("laplacian_degree", f"WITH {SYM} SELECT file_id, i, floor(sum(abs(w)) * 2e6 + 0.5) / 2e6 AS degree, count(*) AS links FROM sym GROUP BY file_id, i")
def laplacian_degree(spark, sf_dir):
    return vectors.pruned_degrees(v.v_vec(spark, sf_dir), digits=6)


MINOR = "CASE WHEN vec_id < 9 THEN 100 + vec_id // 3 ELSE label END"


@register(
    "filter_minor",
    f"""WITH vec0 AS (SELECT 0::BIGINT AS file_id, vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS e, ({MINOR})::INT AS label FROM embeddings),
sizes AS (SELECT label, count(*) AS size FROM vec0 GROUP BY label),
vec AS (SELECT vec0.*, size >= 4 AS major FROM vec0 JOIN sizes USING (label)),
long AS (SELECT label, d, e[d] AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS d FROM vec WHERE major)),
cent AS (SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS x FROM long GROUP BY label, d) GROUP BY label),
best AS (SELECT idx, arg_max(cent.label, list_cosine_similarity(e, c)) AS dest FROM vec, cent WHERE NOT major GROUP BY idx)
SELECT vec.file_id, vec.idx, vec.label, CASE WHEN major THEN vec.label ELSE coalesce(dest, 0) END AS new_label FROM vec LEFT JOIN best ON vec.idx = best.idx""",
)
def filter_minor(spark, sf_dir):
    t = v.v_vec(spark, sf_dir)
    minor = F.when(F.col("idx") < 9, (F.lit(100) + F.floor(F.col("idx") / 3)).cast("int")).otherwise(F.col("label"))
    return vectors.reassign_minor(t.withColumn("label", minor)).drop("embedding")


@register("merge_by_cos")
def merge_by_cos(spark, sf_dir):
    """A threshold of 0.2, at which labels of these tables do merge."""
    return vectors.merge_similar(vectors.centroids(v.v_vec(spark, sf_dir)), 0.2)


@register("cluster_spectral")
def cluster_spectral(spark, sf_dir):
    t = v.v_vec(spark, sf_dir).withColumn("end", F.col("idx") * 0.6)
    return cluster.cluster_files(t, boundary=float("inf"))


@register("cluster_density")
def cluster_density(spark, sf_dir):
    t = v.v_vec(spark, sf_dir).withColumn("end", F.col("idx") * 0.6)
    return cluster.cluster_files(t, boundary=0.0)
