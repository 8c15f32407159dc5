"""Loudness, pitch, tempo and spectra against one pass in plain Python or numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import signal

SCHEMA = "clip_id string, channel int, idx long, v double, sample_rate int"


def table(spark, clips):
    """clips: name -> (rate, channels as a list of arrays)."""
    rows = [(k, c, i, float(v), rate) for k, (rate, channels) in clips.items() for c, x in enumerate(channels) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def one_pass_lufs(x, rate):
    for b, a in signal._biquads(rate):
        y, s1, s2 = [], 0.0, 0.0
        for v in x:
            o = b[0] * v + s1
            s1, s2 = b[1] * v - a[0] * o + s2, b[2] * v - a[1] * o
            y.append(o)
        x = y
    return -0.691 + 10 * math.log10(sum(v * v for v in x) / len(x) + 1e-30)


def test_loudness_however_it_is_cut(spark):
    rng = np.random.default_rng(0)
    clips = {"noise": (8000, [rng.normal(size=3001)]), "stereo": (44100, [rng.normal(size=1500), np.sin(np.arange(1500) / 9)]), "short": (8000, [[0.5]]), "silent": (8000, [np.zeros(700)]), "offset": (48000, [np.full(2000, 0.25)])}
    df = table(spark, clips)
    want = {k: one_pass_lufs(np.mean(c, axis=0), rate) for k, (rate, c) in clips.items()}
    for piece in (1, 7, 256, 300, 1 << 18):
        some = df if piece > 1 else df.where("idx < 120")
        wanted = want if piece > 1 else {k: one_pass_lufs(np.mean(c, axis=0)[:120], rate) for k, (rate, c) in clips.items()}
        got = {r.clip_id: r.lufs for r in signal.loudness(some, piece).collect()}
        assert set(got) == set(wanted) and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted), piece


def test_loudness_with_a_gap(spark):
    x = np.random.default_rng(1).normal(size=1000)
    x[200:800] = 0
    df = table(spark, {"a": (8000, [x])}).where("idx < 200 or idx >= 800")
    assert abs(signal.loudness(df, 100).first().lufs - one_pass_lufs(x, 8000)) < 1e-9


def test_differences():
    x = np.random.default_rng(2).normal(size=501)
    assert np.allclose(signal.differences(x, 250), [((x[:250] - x[t : t + 250]) ** 2).sum() for t in range(250)])
    assert not signal.differences(np.full(400, 0.3), 200).any() and not signal.differences(np.zeros(400), 200).any()


def test_pitch(spark):
    t = np.arange(6000) / 8000
    tone = lambda hz: np.sin(2 * np.pi * hz * t)
    rng = np.random.default_rng(3)
    clips = {"a4": [tone(440)], "sharp": [tone(450) + 0.3 * tone(900)], "low": [tone(27.5)], "silent": [np.zeros(6000)], "level": [np.full(6000, 0.5)], "noise": [rng.normal(size=6000)], "short": [tone(440)[:2047]], "enough": [tone(440)[:2048]], "sides": [tone(440) + 0.4, tone(440) - 0.4]}
    got = {r.clip_id: r for r in signal.pitch(table(spark, {k: (8000, c) for k, c in clips.items()})).collect()}
    assert set(got) == set(clips)
    assert all(abs(got[k].hz - 440) < 1 and got[k].note == "A4" and abs(got[k].cents) <= 4 for k in ("a4", "enough", "sides"))
    assert abs(got["sharp"].hz - 450) < 1 and got["sharp"].note == "A4" and 36 <= got["sharp"].cents <= 43
    assert abs(got["low"].hz - 27.5) < 0.2 and got["low"].note == "A0"
    assert all(got[k].hz is None and got[k].note is None and got[k].cents is None for k in ("silent", "level", "noise", "short"))


def clicks(bpm, rate=8000, seconds=12):
    x = np.zeros(rate * seconds)
    burst = np.random.default_rng(bpm).normal(size=200) * np.hanning(200)
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * rate) + 900
        x[at : at + 200] += burst[: len(x[at : at + 200])]
    return x


def plain_tempo(x, rate, fft=1024, hop=512):
    n = (len(x) - fft) // hop
    if n < 4:
        return None
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    m = [np.abs(np.fft.rfft(x[f * hop : f * hop + fft] * w))[: fft // 2] for f in range(n)]
    flux = [0.0] + [np.maximum(m[f] - m[f - 1], 0).sum() for f in range(1, n)]
    o = np.zeros(n)
    for f in range(8, n - 8):
        o[f] = flux[f] if flux[f] > 1.5 * np.mean(flux[f - 8 : f + 9]) and flux[f] > 1e-9 else 0
    low, high = math.floor(rate / hop * 0.3), math.ceil(rate / hop)
    if high >= n:
        return None
    c = [float((o[: n - lag] * o[lag:]).sum()) for lag in range(high + 2)]
    best = max(range(low, high + 1), key=lambda k: (c[k], -k))
    lag = float(best)
    if low < best < high:
        bend = c[best - 1] - 2 * c[best] + c[best + 1]
        shift = 0.5 * (c[best - 1] - c[best + 1]) / bend if abs(bend) > 1e-12 else 1
        lag += shift if abs(shift) < 1 else 0
    bpm = 60 * rate / hop / lag
    return math.floor(bpm + 0.5) if 60 <= bpm <= 200 else None


@pytest.mark.parametrize("together", [5, 2048])
def test_tempo(spark, together):
    clips = {f"b{b}": clicks(b) for b in (62, 75, 90, 120, 150, 180, 196)}
    clips |= {"silent": np.zeros(40000), "short": clicks(120)[:7000], "tiny": np.ones(10), "noise": np.random.default_rng(5).normal(size=50000)}
    df = table(spark, {k: (8000, [x]) for k, x in clips.items()})
    got = {r.clip_id: r.bpm for r in signal.tempo(df, together=together).collect()}
    assert got == {k: plain_tempo(x, 8000) for k, x in clips.items()}
    assert all(abs(got[f"b{b}"] - b) <= 0.04 * b for b in (62, 75, 90, 120, 150, 180, 196))
    assert got["silent"] is None and got["short"] is None and got["tiny"] is None


def test_centroid_and_spectrum(spark):
    rng = np.random.default_rng(6)
    clips = {"a": rng.normal(size=203), "silent": np.zeros(64), "short": np.ones(15), "half": np.r_[np.zeros(32), rng.normal(size=32)]}
    df = table(spark, {k: (8000, [x]) for k, x in clips.items()})
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)

    def centre(x):
        found = []
        for f in range(len(x) // 16):
            m = np.abs(np.fft.rfft(x[16 * f : 16 * f + 16] * w))[:8]
            found.append((m * np.arange(8) * 500).sum() / m.sum() if m.sum() > 1e-12 else 0.0)
        return sum(found) / len(found) if found else None

    got = {r.clip_id: r.centroid_hz for r in signal.spectral_centroid(df, 16, 3).collect()}
    assert all(got[k] is None if centre(x) is None else abs(got[k] - centre(x)) < 1e-6 for k, x in clips.items()) and set(got) == set(clips)

    stats = {r.clip_id: r for r in signal.spectrum_stats(signal.spectrogram(df, 16, 4, together=3)).collect()}
    db = np.array([r.db for r in signal.spectrogram(df.where("clip_id = 'a'"), 16, 4).orderBy("frame").collect()])
    top = db.max(axis=0)
    near = [b for b in range(1, 8) if top[b] >= db.max() - 60]
    loud = sorted(v for v in top if v > -120)
    want = (int(db.argmax()) % 8 * 500, near[0] * 500, near[-1] * 500, db.max() - loud[int(len(loud) * 0.1)])
    assert np.allclose([stats["a"].peak_hz, stats["a"].low_hz, stats["a"].high_hz, stats["a"].dynamic_range], want)
    assert stats["silent"].dynamic_range == 0 and "short" not in stats


def test_level_only_band(spark):
    spec = spark.createDataFrame([("x", 0, 8000, [0.0, -90.0, -95.0, -130.0]), ("x", 1, 8000, [-1.0, -80.0, -95.0, -130.0])], "clip_id string, frame long, rate long, db array<double>")
    r = signal.spectrum_stats(spec).first()
    assert (r.peak_hz, r.low_hz, r.high_hz, r.dynamic_range) == (0.0, None, None, 95.0)


def test_clips_of_any_key_type(spark):
    df = table(spark, {"1": (8000, [clicks(120)])}).withColumn("clip_id", F.col("clip_id").cast("long"))
    assert dict(signal.tempo(df).dtypes)["clip_id"] == "bigint" and signal.pitch(df).count() == signal.loudness(df).count() == signal.tempo(df).count() == 1
