import itertools
import random

import numpy as np

from turnspan.operators import evaluation

SEG = "file_id long, start double, end double, speaker string"


def brute_force_der(reference: list[tuple[float, float, str]], hypothesis: list[tuple[float, float, str]], collar: float = evaluation.COLLAR) -> float | None:
    """The error rate of one small file by trying every mapping."""
    half = collar / 2
    edges = [t for a, b, _ in reference for t in (a, b)]
    points = sorted({t for a, b, _ in [*reference, *hypothesis] for t in (a, b)} | {t + s for t in edges for s in (-half, half)})
    rows = []
    for a, b in zip(points, points[1:]):
        m = (a + b) / 2
        if b > a and not any(e - half < m < e + half for e in edges):
            rows.append((b - a, {s for x, y, s in reference if x <= m < y}, {s for x, y, s in hypothesis if x <= m < y}))
    total = sum(d * len(r) for d, r, _ in rows)
    if not total:
        return None
    rs, hs = sorted({s for *_, s in reference}), sorted({s for *_, s in hypothesis})
    hs += [f"\0{i}" for i in range(len(rs))]
    wrong = min(sum(d * (max(len(r), len(h)) - sum(m.get(x) in h for x in r)) for d, r, h in rows) for p in itertools.permutations(hs, len(rs)) for m in [dict(zip(rs, p))])
    return wrong / total


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2), (4, 4)):
        c = rng.random((n, m))
        got = sum(c[a, b] for a, b in evaluation.assign(c))
        k = min(n, m)
        want = min(sum(c[a, b] for a, b in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(got - want) < 1e-12


def test_der_equals_brute_force(spark):
    rng = random.Random(5)
    ref, hyp = {}, {}
    for f in range(12):
        t = 0.0
        ref[f] = []
        for _ in range(6):
            d = rng.uniform(0.5, 4)
            ref[f].append((round(t, 2), round(t + d, 2), rng.choice("abc")))
            t += d + rng.choice([0, 0.5, -0.3])
        hyp[f] = [(max(0, a + rng.uniform(-0.3, 0.3)), b + rng.uniform(-0.1, 0.3), rng.choice("xyz") if rng.random() < 0.2 else {"a": "x", "b": "y", "c": "z"}[s]) for a, b, s in ref[f]]
    frame = lambda d: spark.createDataFrame([(f, float(a), float(b), s) for f, rows in d.items() for a, b, s in rows], SEG)
    got = {r.file_id: r.der for r in evaluation.error_components(frame(ref), frame(hyp)).collect()}
    for f in ref:
        assert abs(got[f] - brute_force_der(ref[f], hyp[f])) < 1e-9, f


def test_der_zero_and_one_sided(spark):
    r = spark.createDataFrame([(0, 0.0, 5.0, "a"), (0, 4.0, 9.0, "b"), (1, 0.0, 3.0, "a")], SEG)
    swapped = spark.createDataFrame([(0, 0.0, 5.0, "q"), (0, 4.0, 9.0, "p")], SEG)
    assert all(abs(x.der) < 1e-12 for x in evaluation.error_components(r, r).collect())
    got = {x.file_id: x for x in evaluation.error_components(r, swapped).collect()}
    assert abs(got[0].der) < 1e-12 and got[1].der == 1.0 and got[1].missed > 0
    timing = spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, 10.0)], "file_id long, seconds double, duration double")
    s = evaluation.summary(evaluation.error_components(r, swapped), timing).first()
    assert s.files == 2 and s.mean_rtf == 0.15000000000000002 and s.global_rtf == 0.15


def test_mapping_of_many_speakers_and_unshared_ones(spark):
    shared = spark.createDataFrame([(0, "a", "x", 1.0), (0, "a", "y", 5.0), (0, "b", "y", 4.5), (0, "b", "x", 0.0), (1, "a", "x", 2.0), (1, "c", "x", 3.0)], "file_id long, r string, h string, seconds double")
    got = {r.file_id: r.to for r in evaluation.best_mapping(shared).collect()}
    assert got[0] in ({"a": "y"}, {"a": "x", "b": "y"}) and sum({("a", "x"): 1, ("a", "y"): 5, ("b", "y"): 4.5}[p] for p in got[0].items()) == 5.5
    assert got[1] == {"c": "x"}
    assert evaluation.best_mapping(shared.limit(0)).count() == 0
