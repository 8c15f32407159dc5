"""Pictures against plain numpy, over whole pictures at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import pixels

SCHEMA = "image_id string, x int, y int, r int, g int, b int"


def table(spark, pictures):
    """pictures: name -> array of height x width x 3."""
    rows = [(k, x, y, *map(int, p[y, x])) for k, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def gray(p):
    return 0.299 * p[..., 0] + 0.587 * p[..., 1] + 0.114 * p[..., 2]


def edges(p):
    g = gray(p)
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(0)
    flat = np.full((40, 50, 3), 90)
    spot = flat.copy()
    spot[21, 33] = 255
    twice = flat.copy()
    twice[5, 5] = twice[5, 21] = twice[21, 5] = 200
    return {"noise": rng.integers(0, 256, (37, 61, 3)), "flat": flat, "spot": spot, "twice": twice, "line": rng.integers(0, 256, (1, 20, 3)), "slope": np.arange(2400).reshape(40, 60, 1) % 256 * np.ones(3, int)}


def test_focus_and_sharpness(spark, pictures, monkeypatch):
    tiles = pixels._tiles
    monkeypatch.setattr(pixels, "_tiles", lambda p, cell, least=16: tiles(p, cell, 16))  # pictures of several tiles
    df = table(spark, pictures)
    focus = {r.image_id: r for r in pixels.focus_region(df, 8).collect()}
    sharp = {r.image_id: r for r in pixels.sharpness(df).collect()}
    assert set(focus) == set(sharp) == set(pictures)
    for k, p in pictures.items():
        h, w = p.shape[:2]
        lap = np.full((h, w), np.nan)
        if h > 2 and w > 2:
            lap[1:-1, 1:-1] = edges(p)
        best = (0.0, 0, 0)
        for cy in range(-(-h // 8)):
            for cx in range(-(-w // 8)):
                cell = lap[cy * 8 : cy * 8 + 8, cx * 8 : cx * 8 + 8]
                mean = round(float(np.nanmean(cell**2)), 9) if (~np.isnan(cell)).any() else 0.0
                if mean > best[0]:
                    best = (mean, cy, cx)
        r = focus[k]
        assert (r.cell_y, r.cell_x) == best[1:] and abs(r.energy - best[0]) < 1e-6 and (r.center_x, r.center_y) == (best[2] * 8 + 4, best[1] * 8 + 4), k
        energy = float(np.nanmean(lap**2)) if (~np.isnan(lap)).any() else 0.0
        score = int(np.floor(100 * (1 - np.exp(-0.35 * energy / (gray(p).var() + 1))) + 0.5))
        assert sharp[k].score == score and sharp[k].label == next(name for top, name in pixels.LABELS if score < top)


def test_phash(spark):
    rng = np.random.default_rng(1)
    pictures = {"noise": rng.integers(0, 256, (32, 32, 3)), "flat": np.full((32, 32, 3), 77), "black": np.zeros((32, 32, 3), int), "slope": np.add.outer(np.arange(32), 3 * np.arange(32))[..., None] * np.ones(3, int)}
    cos = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32) + 1) / 64)
    df = table(spark, pictures)
    got = {r.image_id: r.phash for r in pixels.phash(df).collect()}
    for k, p in pictures.items():
        c = np.round(cos @ gray(p) @ cos.T, 6).ravel()
        bits = "".join("1" if v > sorted(c)[32] else "0" for v in c)
        assert got[k] == "".join(f"{int(bits[i : i + 4], 2):x}" for i in range(0, 64, 4)), k
    assert got == {r.image_id: r.phash for r in pixels.phash(df.repartition(9)).collect()}


def plain_lookup(t, size, r, g, b):
    f = np.clip(np.array([r, g, b]) / 255, 0, 1) * (size - 1)
    a = np.floor(f).astype(int)
    e, d = np.minimum(a + 1, size - 1), f - a
    out = np.zeros(3)
    for k in range(8):
        at = [e[c] if k >> c & 1 else a[c] for c in range(3)]
        out += np.prod([d[c] if k >> c & 1 else 1 - d[c] for c in range(3)]) * t[at[0] + at[1] * size + at[2] * size * size]
    return out


def test_lut_gives_a_row_for_each_row(spark):
    rng = np.random.default_rng(2)
    t = rng.random((64, 3)) * 255
    lut = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(t)], "i long, r double, g double, b double").repartition(3)
    rows = [("a", x, 0, *map(int, rng.integers(-20, 300, 3))) for x in range(40)] + [("a", 1, 1, 255, 255, 255), ("a", 1, 1, 255, 255, 255), ("a", 1, 1, 0, 0, 0), ("b", 0, 0, None, 5, 5)]
    df = pixels.apply_lut(spark.createDataFrame(rows, SCHEMA), lut, 4)
    got = df.collect()
    assert len(got) == len(rows) and "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    for r in got:
        if r.r is None:
            assert r.lr is None and r.lg is None and r.lb is None
        else:
            assert np.allclose([r.lr, r.lg, r.lb], plain_lookup(t, 4, r.r, r.g, r.b))
    curve = spark.createDataFrame([(i, float(i * i), 3.0 * i, 7.0) for i in range(5)], "i int, r double, g double, b double")
    one = pixels.apply_lut(spark.createDataFrame([("a", 0, 0, 1, 2, 3)], SCHEMA), curve, 5, low=(0.0, 1.0, 0.0), high=(4.0, 3.0, 2.0), kind="1D").first()
    assert (one.lr, one.lg, one.lb) == (1.0, 6.0, 7.0)
    with pytest.raises(ValueError, match="entries 0 to 7"):
        pixels.apply_lut(spark.createDataFrame(rows, SCHEMA), lut, 2)


def test_luminance_is_one_everywhere(spark):
    df = spark.createDataFrame([("a", 0, 0, 200, 10, 30)], SCHEMA)
    assert pixels.channel_histogram(df).where(F.col("channel") == "l").first()["value"] == int(0.299 * 200 + 0.587 * 10 + 0.114 * 30)
