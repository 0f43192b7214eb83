import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnspan.operators import cluster, vectors


def planted(k=3, n=40, d=24, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d))
    y = np.repeat(np.arange(k), n)
    return centres[y] + spread * rng.normal(size=(k * n, d)), y


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_spectral_finds_planted_clusters():
    x, y = planted()
    assert same_partition(cluster.spectral_labels(x).tolist(), y.tolist())
    assert same_partition(cluster.cluster(x, cluster.SpectralConfig()).tolist(), y.tolist())


@pytest.mark.parametrize("k", [1, 3, 9])
def test_spectral_of_kept_entries_equals_the_full_matrix(monkeypatch, k):
    x, _ = planted(k, 540 // k)
    full = cluster.spectral_labels(x)
    monkeypatch.setattr(cluster, "FULL_MATRIX", 0)
    assert (cluster.spectral_labels(x) == full).all() and len(set(full)) == k


def test_smallest_eigen_finds_equal_values():
    d = np.concatenate([np.zeros(7), np.full(5, 1.5), np.linspace(2, 90, 300)])
    values, basis = cluster.smallest_eigen(lambda v: d * v, len(d), 11, 90.0)
    assert np.allclose(values, [0] * 7 + [1.5] * 4, atol=1e-7) and np.allclose(basis.T @ basis, np.eye(11), atol=1e-6)


def test_spectral_holds_no_full_matrix():
    x, y = planted(4, 900)
    tracemalloc.start()
    got = cluster.spectral_labels(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same_partition(got.tolist(), y.tolist()) and peak < 8 * len(x) ** 2


def test_density_finds_planted_clusters():
    x, y = planted(3, 60, 12, 0.1)
    got = cluster.hdbscan_labels(x, 10, 10)
    assert same_partition(got[got >= 0].tolist(), y[got >= 0].tolist()) and (got >= 0).mean() > 0.9
    label = cluster.cluster(x, cluster.DensityConfig(neighbours=15, components=8))
    assert same_partition(label.tolist(), y.tolist())
    assert (label == cluster.cluster(x, cluster.DensityConfig(neighbours=15, components=8))).all()


def reachability_lengths(x, samples):
    """The lengths of a minimum spanning tree by a whole matrix, one row after another (Prim)."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, samples - 1]
    d = np.maximum(np.maximum(d, core), core[:, None])
    out, best, inside = [], d[0].copy(), np.arange(len(x)) == 0
    for _ in range(len(x) - 1):
        at = np.where(inside, np.inf, best).argmin()
        out.append(best[at])
        inside[at] = True
        best = np.minimum(best, d[at])
    return sorted(out)


@pytest.mark.parametrize("near", [1, 12, 1000])
@pytest.mark.parametrize("case", ["apart", "one", "copies"])
def test_reachability_tree_is_of_least_length(case, near):
    x = {"apart": planted(5, 60, 6)[0], "one": planted(1, 300, 3, 1.0)[0], "copies": np.repeat(planted(40, 1, 4)[0], 8, axis=0)}[case]
    edges = cluster.reachability_tree(x, 5, near)
    assert np.allclose(sorted(e[0] for e in edges), reachability_lengths(x, 5), atol=1e-6)
    assert {e[2] for e in cluster.from_first(edges, len(x))} == set(range(1, len(x)))


def test_layout_holds_a_block_of_edges():
    x, _ = planted(3, 1400, 8, 1.0)
    tracemalloc.start()
    y = cluster.umap_layout(x, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    edges = len(cluster.fuzzy_graph(*cluster.neighbours(x, 40))[2])
    assert np.isfinite(y).all() and y.shape == (len(x), 60) and peak < 2 * 8 * edges * 60


def test_few_vectors_are_one_speaker():
    x = np.random.default_rng(0).normal(size=(9, 8))
    assert (cluster.cluster(x, cluster.SpectralConfig()) == 1).all()
    assert len(cluster.cluster(np.vstack([x, x[:1]]), cluster.SpectralConfig())) == 10


def test_minor_and_merge():
    x = np.array([[1.0, 0]] * 5 + [[0, 1.0]] * 5 + [[0.9, 0.1]])
    y = np.array([0] * 5 + [1] * 5 + [2])
    assert cluster.reassign_minor(x, y, 4)[-1] == 0
    assert (cluster.reassign_minor(x[:3], np.array([5, 6, 7]), 4) == 0).all()
    sums, n = np.array([[5.0, 0], [0, 5.0], [4.5, 0.5]]), np.array([5.0, 5, 5])
    assert cluster.merge_labels_by_cosine(sums, n, 0.875).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        cluster.merge_labels_by_cosine(sums, n, 0)


def test_eigen_gap_takes_the_first_of_equal():
    assert cluster.eigen_gap(np.array([0, 0, 0, 1, 1.1, 1.2]), 1, 5) == 3
    assert cluster.eigen_gap(np.array([0, 1, 2, 3.0]), 1, 3) == 1


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("cluster_type: spectral\npval: 0.02\n")
    assert cluster.load_config(str(f)).pval == 0.02
    f.write_text("cluster_type: AHC\n")
    with pytest.raises(ValueError):
        cluster.load_config(str(f))


def test_dataframe_forms_equal_numpy(spark):
    x, y = planted(3, 8, 6)
    y[-2:] = 9
    rows = [(0, i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "file_id long, idx long, embedding array<double>, label int")
    got = [r.new_label for r in vectors.reassign_minor(df).orderBy("idx").collect()]
    assert got == cluster.reassign_minor(x, y, 4).tolist()
    sims = vectors.prune(vectors.affinity(df))
    assert sims.groupBy("i").count().filter("count <> 6").count() == 0
    assert sims.filter("i = j").count() == len(x)
    lap = vectors.laplacian(vectors.symmetric(sims))
    assert all(abs(r[1]) < 1e-9 for r in lap.groupBy("i").sum("value").collect())
    c = {r.label: np.array(r.centroid) for r in vectors.centroids(df).collect()}
    assert np.allclose(c[0], x[y == 0].mean(axis=0))


def test_zero_vector_and_boundary(spark):
    from turnspan import speaker_similarity

    assert speaker_similarity([0, 0], [1, 0]) == 0
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0])], "file_id long, idx long, embedding array<double>")
    assert vectors.affinity(df).filter("i <> j and sim <> 0").count() == 0
    x, y = planted(2, 12, 8)
    rows = [(f, i, end, v.tolist()) for f, end in ((0, 1199.9), (1, 1200.0)) for i, v in enumerate(x)]
    out = cluster.cluster_files(spark.createDataFrame(rows, "file_id long, idx long, end double, embedding array<double>"))
    labels = [r.label for r in out.filter("file_id = 0").orderBy("idx").collect()]
    assert same_partition(labels, y.tolist()) and out.count() == 48


def one_file_and_a_short_one(spark):
    x, _ = planted(4, 160, 6)
    x[300:] = np.round(x[300:])  # with copies, so with ties
    x[5] = 0
    rows = [(0, 3 * i, v.tolist()) for i, v in enumerate(x)] + [(None, i, v.tolist()) for i, v in enumerate(x[:4])]
    return spark.createDataFrame(rows, "file_id long, idx long, embedding array<double>")


def by_partition(spark, df):
    """Rows, and in how many partitions a file's are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return [tuple(r)[:-1] for r in rows], len({r["at"] for r in rows if r.file_id == 0})


def test_pruned_affinity_of_a_file_in_several_tasks(spark):
    df = one_file_and_a_short_one(spark)
    keyed = df.withColumn("file_id", F.coalesce("file_id", F.lit(-1)))  # the plain form joins, which drops null keys
    want = vectors.prune(vectors.affinity(keyed).withColumn("sim", F.floor(F.col("sim") * 1e6 + 0.5) / 1e6)).collect()
    got, tasks = by_partition(spark, vectors.pruned_affinity(df, digits=6))
    assert sorted((-1 if f is None else f, *r) for f, *r in got) == sorted(map(tuple, want)) and tasks > 1


def test_degrees_without_entries_equal_those_of_the_symmetric_matrix(spark):
    df = one_file_and_a_short_one(spark)
    keyed = df.withColumn("file_id", F.coalesce("file_id", F.lit(-1)))
    w = vectors.symmetric(vectors.prune(vectors.affinity(keyed).withColumn("sim", F.floor(F.col("sim") * 1e6 + 0.5) / 1e6)))
    want = w.groupBy("file_id", "i").agg((F.floor(F.sum(F.abs("w")) * 2e6 + 0.5) / 2e6).alias("degree"), F.count(F.lit(1)).alias("links"))
    got, tasks = by_partition(spark, vectors.pruned_degrees(df, digits=6))
    assert sorted((-1 if f is None else f, *r) for f, *r in got) == sorted(map(tuple, want.collect())) and tasks > 1
