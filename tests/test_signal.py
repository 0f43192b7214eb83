import numpy as np

from turnspan.functions import colours, signal
from turnspan.operators import embedding


def test_frame_counts():
    assert [signal.frame_count(n) for n in (24_000, 23_200, 400, 10)] == [148, 143, 1, 1]
    assert signal.FeatureOptions().padded == 512


def test_fft_and_tone():
    t = np.arange(24_000) / 16_000
    x = (0.5 * np.sin(2 * np.pi * 1000 * t)).astype(np.float32)
    f = signal.log_mel(x, normalise=False)
    assert f.shape == (148, 80)
    centre = signal.hz_of_mel(np.linspace(signal.mel(20), signal.mel(8000), 82)[1:-1])
    assert abs(centre[f.mean(axis=0).argmax()] - 1000) < 60
    assert abs(signal.log_mel(x).mean(axis=0)).max() < 1e-3
    o = signal.FeatureOptions()
    frames = signal.shape_frames(signal.frames_of(x), o)
    whole = np.abs(np.fft.fft(frames, 512, axis=1)[:, :256]) ** 2
    assert np.allclose(signal.spectrum(frames, o), whole)


def test_silence():
    f = signal.log_mel(np.zeros(24_000, np.float32), normalise=False)
    assert np.allclose(f, np.log(1.1920929e-7))
    assert np.abs(signal.log_mel(np.zeros(24_000, np.float32))).max() < 1e-6


def test_filters_cover_all_bins():
    w = signal.mel_weights()
    assert w.shape == (80, 256) and (w.sum(axis=1) > 0).all() and (w[:, 0] == 0).all()


def test_preemphasis_first_sample():
    o = signal.FeatureOptions(window="rectangular")
    x = np.arange(400.0)[None]
    y = signal.shape_frames(x, o)[0]
    c = x[0] - x[0].mean()
    assert np.isclose(y[0], 0.03 * c[0]) and np.isclose(y[5], c[5] - 0.97 * c[4])


def test_features_over_windows(spark):
    x = np.random.default_rng(0).normal(scale=0.1, size=48_000).astype(np.float32)
    audio = spark.createDataFrame([("a", x.tolist())], "file_id string, samples array<float>")
    rows = [("a", 0, -0.9, 0.6), ("a", 1, 0.6, 2.1), ("a", 300, 2.9, 4.4)]
    w = spark.createDataFrame(rows, "file_id string, idx long, start double, end double")
    got = {r.idx: np.array(r.features) for r in signal.features(w, audio).collect()}
    assert got[0].shape == (148, 80) and got[300].shape[0] == signal.frame_count(48_000 - 46_400)
    want = signal.log_mel(x[int(0.6 * 16_000) : int(0.6 * 16_000) + int((2.1 - 0.6) * 16_000)])
    assert np.allclose(got[1], want, atol=1e-4)


def test_embedding_backends(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 148, 80)).astype(np.float32)
    v = embedding.statistics_embedding(x)
    assert v.shape == (3, 192) and (v >= 0).all() and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
    weights = {}
    for k, s in embedding.DensityNetwork.shapes().items():
        weights[k] = np.ones(s) if k.endswith("running_var") else np.zeros(s) if k.endswith("running_mean") else rng.normal(scale=0.05, size=s)
    net = embedding.network_backend(weights)
    out = net.embed(x[:, :20])
    assert out.shape == (3, 192) and (out >= 0).all()
    assert np.allclose(net.embed(x[:1, :20]), out[:1], atol=1e-4)  # not dependent on the batch
    fixed = embedding.network_backend(weights, pooled_context=True)
    assert fixed.fixed_frames == 150 and len(embedding.fit_frames(x[0], 150)) == 150
    rows = [("a", i, 0.0, 1.5, f.tolist()) for i, f in enumerate((x[0], x[1, :100], x[2]))]
    df = spark.createDataFrame(rows, "file_id string, idx long, start double, end double, features array<array<float>>")
    got = {r.idx: np.array(r.embedding) for r in embedding.embed(df, embedding.statistics_backend()).collect()}
    assert np.allclose(got[2], v[2], atol=1e-5)


def test_colours(spark):
    rows = [(0, 0, "A", 0.0, 10.0), (0, 1, "B", 10.0, 12.0), (1, 0, "A", 0.0, 1.0)]
    s = spark.createDataFrame(rows, "file_id long, turn long, speaker string, start double, end double")
    light = {(r.file_id, r.speaker): r.lightness for r in colours.lightness(s).collect()}
    assert abs(light[0, "B"] - 0.85) < 1e-12 and abs(light[0, "A"] - 0.325) < 1e-12 and abs(light[1, "A"] - 0.5875) < 1e-12
    sets = colours.colour_sets(s).collect()
    assert len(sets) == 30 and all(len(r.hex) == 7 and r.hex[0] == "#" for r in sets)
    assert {r.hue for r in sets if r.file_id == 1} == {(k * 137.508) % 360 for k in range(10)}
    m = {r.file_id: r.speaker_color_sets for r in colours.as_maps(colours.colour_sets(s)).collect()}
    assert set(m[0]["3"]) == {"A", "B"}


def test_oklab_white(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(colours.xyz_to_hex(colours.oklch_to_xyz(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("w")).first()
    assert one.w == "#ffffff"
