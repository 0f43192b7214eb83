import numpy as np

from turnspan import Diarizer
from turnspan.sources import wav
from turnspan.streaming import turns


def voice(hz, seconds, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * 16_000)) / 16_000
    wobble = 1 + 0.3 * np.sin(2 * np.pi * 3 * t + rng.uniform(0, 6))
    x = sum(a * np.sin(2 * np.pi * hz * k * t) for k, a in ((1, 0.4), (2, 0.2), (3, 0.1)))
    return 0.4 * wobble * x + 0.01 * rng.normal(size=len(t))


def test_two_voices(spark, tmp_path):
    parts = [voice(150, 8, 0), np.zeros(16_000), voice(900, 8, 1), np.zeros(16_000), voice(150, 8, 2)]
    (tmp_path / "talk.wav").write_bytes(wav.encode(np.concatenate(parts)))
    (tmp_path / "silent.wav").write_bytes(wav.encode(np.zeros(32_000)))
    d = Diarizer(spark).diarize(str(tmp_path))
    merged = sorted((r.start, r.end, r.speaker) for r in d.merged_segments.filter("file_id = 'talk'").collect())
    assert merged and abs(merged[0][0]) < 0.5 and abs(merged[-1][1] - 26) < 0.5
    assert set(d.timing) == {"vad", "embeddings", "clustering", "segments"}
    rows = {r.file_id: r for r in d.rows().collect()}
    assert rows["silent"].merged_segments is None and rows["silent"].raw_speakers_detected == 0
    assert set(rows["talk"].speaker_centroids) >= {m[2] for m in merged}
    assert d.colour_sets().count() % 10 == 0


def test_stream_equals_batch(spark, tmp_path):
    from test_intervals import SEG, frame, random_files, sequential_raw

    files = random_files(6, 11)
    rows = frame(spark, files).orderBy("file_id", "idx").collect()
    out = tmp_path / "out"
    for k in range(3):  # a third of each file's windows at a time
        part = [r for r in rows if r.idx * 3 // len(files[r.file_id]) == k]
        spark.createDataFrame(part, SEG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SEG).parquet(str(tmp_path / "in"))
        q = turns.stream_segments(stream, quiet_ms=None).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = {}
    for r in spark.read.parquet(str(out)).orderBy("file_id", "start").collect():
        got.setdefault(r.file_id, []).append((r.speaker, r.start, r.end))
    for f, r in files.items():
        assert got.get(f, []) == sequential_raw(r)[:-1]


def test_evaluate_folder(spark, tmp_path):
    from turnspan.plans import evaluate as ev

    (tmp_path / "audio").mkdir()
    (tmp_path / "rttm").mkdir()
    talk = np.concatenate([voice(150, 8, 0), np.zeros(16_000), voice(900, 8, 1)])
    (tmp_path / "audio" / "talk.wav").write_bytes(wav.encode(talk))
    (tmp_path / "audio" / "broken.wav").write_bytes(b"RIFF" * 10)
    (tmp_path / "audio" / "alone.wav").write_bytes(wav.encode(talk))
    lines = ["SPEAKER talk 1 0.000 8.000 <NA> <NA> a <NA> <NA>", "SPEAKER talk 1 9.000 8.000 <NA> <NA> b <NA> <NA>"]
    (tmp_path / "rttm" / "talk.rttm").write_text("\n".join(lines))
    (tmp_path / "rttm" / "broken.rttm").write_text(lines[0])
    files, summary = ev.evaluate(spark, str(tmp_path))
    rows = {r.file_id: r for r in files.collect()}
    assert set(rows) == {"talk", "broken"} and rows["broken"].error and rows["broken"].der is None
    assert rows["talk"].der is not None and rows["talk"].reference_speakers == 2
    s = summary.first()
    assert s.files == 1 and s.failed == 1 and abs(s.global_der - rows["talk"].der) < 1e-12
    ev.write_results(files, summary, str(tmp_path / "out"))
    assert '"global_der"' in next((tmp_path / "out").glob("*.txt")).read_text()


def test_convert_meetings(spark, tmp_path):
    from turnspan.plans import evaluate as ev

    (tmp_path / "m.xml").write_text('<root><meeting observation="M1"><speaker nxt_agent="A" global_name="X"/></meeting></root>')
    (tmp_path / "s").mkdir()
    for agent, at in (("A", "5"), ("B", "1")):
        (tmp_path / "s" / f"M1.{agent}.segments.xml").write_text(
            f'<nite:root xmlns:nite="http://nite"><segment nite:id="i" transcriber_start="{at}" transcriber_end="{at}.5"/></nite:root>'
        )
    run = lambda: ev.convert_meetings(spark, str(tmp_path / "m.xml"), str(tmp_path / "s"), str(tmp_path / "out"), ["M1", "M2"])
    assert run() == {"written": ["M1"], "skipped": [], "missing": ["M2"]}
    text = next((tmp_path / "out" / "stem=M1").glob("*.txt")).read_text().splitlines()
    assert text == ["SPEAKER M1 1 1.000 0.500 <NA> <NA> UNKNOWN <NA> <NA>", "SPEAKER M1 1 5.000 0.500 <NA> <NA> X <NA> <NA>"]
    assert run() == {"written": [], "skipped": ["M1"], "missing": ["M2"]}
