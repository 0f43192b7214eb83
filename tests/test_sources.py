import numpy as np
import pytest

from turnspan.sources import meetings, rttm, wav


def tone(seconds=1.0, hz=440, rate=16_000):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("bits,tolerance", [(8, 0.01), (16, 1e-4), (32, 1e-7)])
def test_wav_round_trip(bits, tolerance):
    x = tone()
    y, info = wav.decode(wav.encode(x, bits=bits))
    assert np.abs(x - y).max() < tolerance and info.seconds == 1.0
    y, _ = wav.decode(wav.encode(x, as_float=True))
    assert np.abs(x - y).max() < 1e-6


def test_wav_chunks():
    content = wav.encode(tone())
    extra = b"LIST" + (5).to_bytes(4, "little") + b"abcde\0"
    y, info = wav.decode(content[:36] + extra + content[36:])
    assert len(y) == 16_000
    zero = content[:40] + (0).to_bytes(4, "little") + content[44:]
    assert len(wav.decode(zero)[0]) == 16_000
    assert len(wav.decode(content[:-100])[0]) == 15_950
    for bad in (b"", b"RIFF", content[:36], b"x" * 100):
        with pytest.raises(wav.AudioFormatError):
            wav.decode(bad)
    stereo = wav.encode(np.repeat(tone(), 2), channels=2)
    assert len(wav.decode(stereo, first_channel=True)[0]) == 16_000
    assert wav.level(np.array([2.0, -4.0])).tolist() == [0.5, -1.0] and wav.level(np.array([0.5])).tolist() == [0.5]


def test_resample():
    y = wav.to_mono_16k(wav.encode(tone(rate=44_100), rate=44_100))
    assert len(y) == 16_000 and np.abs(y[200:-200] - tone()[200:-200]).max() < 0.02


def test_read_wavs(spark, tmp_path):
    (tmp_path / "good.wav").write_bytes(wav.encode(tone(2)))
    (tmp_path / "bad.wav").write_bytes(wav.encode(tone(), rate=44_100))
    (tmp_path / "tiny.wav").write_bytes(b"RIFF")
    with pytest.raises(wav.AudioFormatError):
        wav.read_wavs(spark, str(tmp_path))
    audio, rejected = wav.read_wavs(spark, str(tmp_path), strict=False)
    rows = audio.collect()
    assert [(r.file_id, r.n_samples, r.seconds) for r in rows] == [("good", 32_000, 2.0)]
    assert sorted(r.file_id for r in rejected.collect()) == ["bad", "tiny"]


def test_rttm(spark, tmp_path):
    lines = ["SPEAKER f 1 0.000 1.500 <NA> <NA> a <NA> <NA>", "", "# note", "SPEAKER f 1 1 2", "LEXEME f 1 0 1 <NA> <NA> a <NA> <NA>",
             "SPEAKER f 1 2.0 1.0 <NA> <NA> a <NA> <NA>", "SPEAKER f 1 2.0 1.0 <NA> <NA> b <NA> <NA>", "SPEAKER f 1 x 1.0 <NA> <NA> b <NA> <NA>"]
    (tmp_path / "f.rttm").write_text("\n".join(lines))
    got = sorted((r.start, r.end, r.speaker) for r in rttm.read_rttm(spark, str(tmp_path)).collect())
    assert got == [(0.0, 1.5, "a"), (2.0, 3.0, "b")]
    s = spark.createDataFrame([("f", 2.0, 3.25, "b"), ("f", 0.0, 1.5, "a")], "file_id string, start double, end double, speaker string")
    rttm.write_rttm(s, str(tmp_path / "out"))
    text = [p.read_text() for p in (tmp_path / "out" / "stem=f").glob("*.txt")]
    assert text == ["SPEAKER f 1 0.000 1.500 <NA> <NA> a <NA> <NA>\nSPEAKER f 1 2.000 1.250 <NA> <NA> b <NA> <NA>\n"]
    rttm.write_json(s, str(tmp_path / "json"))
    assert '"speaker" : "a"' in next((tmp_path / "json" / "stem=f").glob("*.txt")).read_text()


def test_pairs(spark):
    audio = spark.createDataFrame([("/d/a.wav",), ("/d/audio/b.wav",), ("/d/c.wav",)], "path string")
    notes = spark.createDataFrame([("/d/rttm/a.rttm",), ("/d/audio/a.rttm",), ("/d/rttm/b.rttm",)], "path string")
    pairs, lost = rttm.pair_files(audio, notes)
    assert {(r.stem, r.rttm_path) for r in pairs.collect()} == {("a", "/d/audio/a.rttm"), ("b", "/d/rttm/b.rttm")}
    assert [r.stem for r in lost.collect()] == ["c"]


def test_meetings(spark, tmp_path):
    (tmp_path / "meetings.xml").write_text(
        '<root><meeting observation="ES2004a"><speaker nxt_agent="A" global_name="FEE013"/><speaker nxt_agent="B" global_name="MEE014"/></meeting></root>'
    )
    agents = meetings.read_agents(spark, str(tmp_path / "meetings.xml"))
    assert {r.agent: r.speaker for r in agents.collect()} == {"A": "FEE013", "B": "MEE014", "C": "UNKNOWN", "D": "UNKNOWN"}
    with pytest.raises(ValueError):
        meetings.require_meeting(agents, "none")
    d = tmp_path / "segments"
    d.mkdir()
    (d / "ES2004a.A.segments.xml").write_text(
        '<nite:root xmlns:nite="http://nite"><segment nite:id="s1" transcriber_start="1.5" transcriber_end="2.75"/>'
        '<segment nite:id="s2" transcriber_start="x" transcriber_end="3"/><segment transcriber_start="1" transcriber_end="2"/></nite:root>'
    )
    segments = meetings.read_segments(spark, str(d))
    rows = meetings.to_annotation(segments, agents).collect()
    assert [(r.file_id, r.start, r.end, r.speaker) for r in rows] == [("ES2004a", 1.5, 2.75, "FEE013")]
    assert meetings.split_meetings(spark).count() == 16
