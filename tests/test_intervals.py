import random

from pyspark.sql import functions as F

from turnspan.operators import intervals as iv
from turnspan.operators import vad

SEG = "file_id long, idx long, speaker string, start double, end double"


def sequential_raw(rows):
    out = []
    for sp, a, b in rows:
        a, b = max(0.0, a), max(0.0, b)
        if out and out[-1][0] == sp and not a > out[-1][2]:
            out[-1][2] = b
        else:
            if out and out[-1][0] != sp and a < out[-1][2]:
                out[-1][2] = a = max(0.0, (out[-1][2] + a) / 2)
            out.append([sp, a, b])
    return [tuple(x) for x in out]


def sequential_merge(segments):
    out = []
    for sp, a, b in segments:
        if out and out[-1][0] == sp and a - out[-1][2] <= 4:
            out[-1][2] = b
        else:
            out.append([sp, a, b])
    i = 0
    while i < len(out):
        if out[i][2] - out[i][1] > 0.78:
            i += 1
            continue
        if 0 < i < len(out) - 1 and out[i - 1][0] == out[i + 1][0]:
            out[i - 1][2] = out[i + 1][2]
            del out[i + 1]
        del out[i]
    return [tuple(x) for x in out]


def random_files(n, seed):
    rng = random.Random(seed)
    files = {}
    for f in range(n):
        t, rows = rng.uniform(-1, 1), []
        for _ in range(rng.randint(1, 25)):
            rows.append((rng.choice("AAB"), t, t + 1.5))
            t += rng.choice([0.3, 0.6, 0.6, 0.75, 1.5, 2.0, 5.5, 6.0, 20.0])
        files[f] = rows
    return files


def frame(spark, files):
    return spark.createDataFrame([(f, i, *r) for f, rows in files.items() for i, r in enumerate(rows)], SEG)


def by_file(df, order):
    out = {}
    for r in df.orderBy("file_id", order).collect():
        out.setdefault(r.file_id, []).append((r.speaker, r.start, r.end))
    return out


def test_folds_equal_sequential_reading(spark):
    files = random_files(300, 7)
    raw = iv.raw_segments(frame(spark, files))
    want = {f: sequential_raw(r) for f, r in files.items()}
    assert by_file(raw, "sid") == want
    assert by_file(iv.merged_segments(raw), "turn") == {f: m for f, r in want.items() if (m := sequential_merge(r))}


def test_edges(spark):
    def raw(*rows):
        return by_file(iv.raw_segments(frame(spark, {0: list(rows)})), "sid")[0]

    def merged(*rows):
        s = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "file_id long, sid long, speaker string, start double, end double")
        return by_file(iv.merged_segments(s), "turn").get(0, [])

    assert raw(("A", 0.0, 1.5), ("A", 1.5, 3.0)) == [("A", 0.0, 3.0)]
    assert raw(("A", 0.0, 1.5), ("B", 1.5, 3.0)) == [("A", 0.0, 1.5), ("B", 1.5, 3.0)]
    assert raw(("A", -0.9, 0.6)) == [("A", 0.0, 0.6)]
    assert merged(("A", 0.0, 0.6)) == []
    assert merged(("A", 0.0, 2.0), ("A", 6.0, 8.0)) == [("A", 0.0, 8.0)]
    assert len(merged(("A", 0.0, 2.0), ("A", 6.001, 8.0))) == 2
    assert merged(("A", 0.0, 0.78)) == []
    assert merged(("A", 0.0, 2.0), ("B", 60.0, 60.5), ("A", 120.0, 122.0)) == [("A", 0.0, 122.0)]
    assert merged(("B", 0.0, 0.5), ("A", 1.0, 3.0), ("B", 4.0, 4.5)) == [("A", 1.0, 3.0)]
    assert merged(("A", 0.0, 2.0), ("B", 2.0, 2.5), ("C", 2.5, 3.0), ("A", 3.0, 5.0)) == [("A", 0.0, 5.0)]


def test_subsegments(spark):
    rows = [(0, 0, 0.0, 1.5), (0, 1, 10.0, 10.5), (0, 2, 20.0, 24.3), (0, 3, 30.0, 32.1)]
    vad_rows = spark.createDataFrame(rows, "file_id long, seg_idx long, start double, end double")
    for ties in (False, True):
        got = iv.subsegments(vad_rows, exact_ties=ties).collect()
        assert all(abs(r.end - r.start - 1.5) < 1e-9 for r in got)
        assert sum(r.seg_idx == 0 for r in got) == 1
        assert [r.start for r in got if r.seg_idx == 1] == [9.0]
        assert max(r.end for r in got if r.seg_idx == 2) == 24.3
    t, n = 30.0, 0
    while t + 1.5 < 32.1:
        t, n = t + 0.6, n + 1
    assert sum(r.seg_idx == 3 for r in iv.subsegments(vad_rows, exact_ties=True).collect()) == n + 1


def test_merge_gaps_with_nested_intervals(spark):
    rng = random.Random(3)
    rows = [(f, a := rng.uniform(0, 50), a + rng.choice([0.1, 1.0, 8.0])) for f in range(40) for _ in range(20)]
    want = {}
    for f in range(40):
        out = []
        for a, b in sorted((a, b) for g, a, b in rows if g == f):
            if out and a - out[-1][1] <= 0.1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want[f] = [tuple(x) for x in out]
    got = {}
    for r in iv.merge_gaps(spark.createDataFrame(rows, "file_id long, start double, end double")).orderBy("file_id", "seg_idx").collect():
        got.setdefault(r.file_id, []).append((r.start, r.end))
    assert got == want
    brief = spark.createDataFrame([(0, 0.0, 0.25), (0, 1.0, 1.2)], "file_id long, start double, end double")
    assert iv.drop_brief(brief).count() == 1


def test_ranking_ties_and_unmerged_speakers(spark):
    raw = spark.createDataFrame([(0, 0, "B", 0.0, 2.0), (0, 1, "A", 3.0, 5.0), (0, 2, "C", 6.0, 6.5)], "file_id long, sid long, speaker string, start double, end double")
    merged = iv.merged_segments(raw)
    names = {r.speaker: r.name for r in iv.rank_speakers(raw, merged).collect()}
    assert names == {"B": "SPEAKER_01", "A": "SPEAKER_02", "C": "SPEAKER_03"}
    assert {r.speaker for r in iv.rename(merged, iv.rank_speakers(raw, merged)).collect()} == {"SPEAKER_01", "SPEAKER_02"}
    files = spark.createDataFrame([(0,), (1,)], "file_id long")
    rows = {r.file_id: r for r in iv.result(files, raw, merged).collect()}
    assert rows[0].raw_speakers_detected == 3 and rows[1].raw_segments is None and rows[1].merged_speakers_detected == 0


def test_vad_frames(spark):
    frames = [(0, c, f, f in (0, 1, 5) or (c == 0 and f > 580)) for c in (0, 1) for f in range(589)]
    df = spark.createDataFrame(frames, "file_id long, chunk long, frame long, active boolean")
    runs = sorted((r.start, r.end) for r in iv.active_runs(df).collect())
    assert len(runs) == 5 and runs[0] == (0.0, 2 * 0.016875)
    assert abs(runs[2][1] - 589 * 0.016875) < 1e-12
    joined = vad.from_frames(df).collect()  # the hole between the chunks is closed
    assert len(joined) == 0 or all(r.end - r.start >= 0.25 for r in joined)
    s = spark.createDataFrame([(0, [0.1, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0]), (1, [0.9] + [0.0] * 6)], "frame long, scores array<double>")
    got = {r.frame: (r["class"], r.speakers, r.active) for r in vad.powerset(s).collect()}
    assert got == {0: (1, [0], True), 1: (0, [], False)}
    n = spark.createDataFrame([(0, 160_001), (1, 0)], "file_id long, n_samples long")
    assert [(r.chunk, r.samples, r.padding) for r in vad.chunks(n).orderBy("chunk").collect()] == [(0, 160_000, 0), (1, 1, 159_999)]


def test_vad_choice():
    import pytest

    assert vad.choose("energy").name == "energy"
    assert vad.choose("auto").name == "energy"
    assert vad.choose("auto", True, {"pyannote": lambda x: x}).name == "pyannote"
    with pytest.raises(ValueError):
        vad.choose("other")
    with pytest.raises(ValueError):
        vad.choose("pyannote")


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], SEG)
    assert iv.merged_segments(iv.raw_segments(empty)).count() == 0
    odd = spark.createDataFrame([(None, 0, "A", 0.0, 1.5), (0, 0, None, 0.0, 1.5), (0, 1, "A", None, None)], SEG)
    assert iv.raw_segments(odd).count() >= 2
    assert iv.merged_segments(iv.raw_segments(odd)).select(F.count("*")).first()[0] >= 1
