"""Colour and sharpness statistics over tables of pixels (image_id, x, y, r, g, b)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import ensure_on_workers

# Sharpness labels by their upper bounds, and the weights of red, green and blue in luminance.
LABELS = ((20, "blurry"), (40, "soft"), (60, "normal"), (80, "sharp"), (101, "very sharp"))
WEIGHTS = (0.299, 0.587, 0.114)


def luminance() -> Column:
    return WEIGHTS[0] * F.col("r") + WEIGHTS[1] * F.col("g") + WEIGHTS[2] * F.col("b")


def channel_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, value, n) of r, g, b and floored luminance (l)."""
    four = F.array(*(F.struct(F.lit(k).alias("channel"), v.cast("int").alias("value")) for k, v in (("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")), ("l", F.floor(luminance())))))
    return pixels.select("image_id", F.explode(four).alias("x")).groupBy("image_id", "x.channel", "x.value").agg(F.count("*").alias("n"))


def color_stats(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, shadow, midtone, highlight): rounded means and luminance shares in percent, one decimal."""
    y, n = luminance(), F.count("*")
    share = lambda c: F.floor(1000.0 * F.count_if(c) / n + 0.5) / 10
    return pixels.groupBy("image_id").agg(*(F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"), share(y < 64).alias("shadow"), share((y >= 64) & (y < 192)).alias("midtone"), share(y >= 192).alias("highlight"))


def dominant_colors(pixels: DataFrame, n: int = 8, apart: int = 60) -> DataFrame:
    """(image_id, colors): buckets of 32 by population (ties by bucket), skipping those within L1 distance `apart` of one taken, n at most.

    A fold over at most 512 counts an image.
    """
    k = lambda c: F.floor(F.col(c) / 32).cast("int")
    c = pixels.groupBy("image_id", k("r").alias("r"), k("g").alias("g"), k("b").alias("b")).agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (F.col("r") * 32 + 16).alias("r"), (F.col("g") * 32 + 16).alias("g"), (F.col("b") * 32 + 16).alias("b"))))
    per = c.groupBy("image_id").agg(order.alias("o"))
    none = F.expr("cast(array() as array<struct<r: int, g: int, b: int, n: bigint>>)")

    def take(a, x):
        near = F.exists(a, lambda y: F.abs(y["r"] - x["r"]) + F.abs(y["g"] - x["g"]) + F.abs(y["b"] - x["b"]) < apart)
        new = F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), (-x["n"]).alias("n"))
        return F.when((F.size(a) >= n) | near, a).otherwise(F.concat(a, F.array(new)))

    return per.select("image_id", F.aggregate("o", none, take).alias("colors"))


def _tiles(pixels: DataFrame, cell: int, least: int = 256) -> DataFrame:
    """(image_id, cx, cy, energy, inner, pixels, lum, lum2): sums over each cell of cell x cell pixels.

    energy and inner: squared Laplacian of luminance over pixels that have all four neighbours, and how many these are; lum and
    lum2: luminance and its square over all pixels. One shuffle: a pixel goes to its tile of whole cells, and to the tiles
    beside it when it stands at the border, so a task has one tile in memory and a picture is many tasks. Of pixels with the
    same place one with the least luminance counts.
    """
    side = cell * max(1, -(-least // cell))
    ensure_on_workers(pixels.sparkSession)
    reach = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - 1) / side)), F.floor((F.col(c) + 1) / side))
    p = pixels.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), luminance().alias("lum"))
    dealt = p.withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        left, top = int(key[1]) * side - 1, int(key[2]) * side - 1
        pdf = pdf.sort_values("lum", ascending=False)
        grid = np.full((side + 2, side + 2), np.nan)
        grid[(pdf["y"] - top).to_numpy(), (pdf["x"] - left).to_numpy()] = pdf["lum"].to_numpy(float)
        own = grid[1:-1, 1:-1]
        lap = grid[:-2, 1:-1] + grid[2:, 1:-1] + grid[1:-1, :-2] + grid[1:-1, 2:] - 4 * own
        cells = lambda v: np.nan_to_num(v).reshape(side // cell, cell, -1, cell).sum(axis=(1, 3)).ravel()
        n = cells(~np.isnan(own) * 1.0)
        cy, cx = np.divmod(np.arange(len(n)), side // cell)
        some = n > 0
        sums = {"energy": cells(lap**2), "inner": cells(~np.isnan(lap) * 1.0).astype(int), "pixels": n.astype(int), "lum": cells(own), "lum2": cells(own**2)}
        out = {"cx": int(key[1]) * (side // cell) + cx[some], "cy": int(key[2]) * (side // cell) + cy[some]} | {k: v[some] for k, v in sums.items()}
        return pd.DataFrame({"image_id": [key[0]] * int(some.sum())} | out)

    kind = dict(pixels.dtypes)["image_id"]
    return dealt.groupBy("image_id", "tx", "ty").applyInPandas(run, f"image_id {kind}, cx long, cy long, energy double, inner long, pixels long, lum double, lum2 double")


def sharpness(pixels: DataFrame) -> DataFrame:
    """(image_id, score, label): mean squared Laplacian over luminance variance plus 1, mapped to whole numbers 0 to 100."""
    s = _tiles(pixels, 64).groupBy("image_id").agg(*(F.sum(c).alias(c) for c in ("energy", "inner", "pixels", "lum", "lum2")))
    mean = F.col("lum") / F.col("pixels")
    spread = F.greatest(F.lit(0.0), F.col("lum2") / F.col("pixels") - mean * mean)
    energy = F.when(F.col("inner") > 0, F.col("energy") / F.col("inner")).otherwise(0.0)
    score = F.floor(100 * (1 - F.exp(-0.35 * (energy / (spread + 1)))) + 0.5).cast("int")
    label = None
    for top, name in LABELS:
        label = F.when(score < top, name) if label is None else label.when(score < top, name)
    return s.select("image_id", score.alias("score"), label.alias("label"))


def focus_region(pixels: DataFrame, grid: int = 32) -> DataFrame:
    """(image_id, cell_x, cell_y, energy, center_x, center_y): of cells of grid x grid pixels the one with the highest mean squared Laplacian.

    The first in reading order on a tie, so the first cell of a picture without any edge.
    """
    mean = F.when(F.col("inner") > 0, F.col("energy") / F.col("inner")).otherwise(0.0)
    first = F.max(F.struct(F.round(mean, 9).alias("energy"), (-F.col("cy")).alias("cy"), (-F.col("cx")).alias("cx"))).alias("b")
    best = _tiles(pixels, grid).groupBy("image_id").agg(first)
    flat = F.col("b.energy") <= 0
    cell = lambda c: F.when(flat, 0).otherwise(-F.col(c)).cast("int")
    middle = lambda c: cell(c) * grid + grid / 2
    return best.select("image_id", cell("b.cx").alias("cell_x"), cell("b.cy").alias("cell_y"), F.col("b.energy").alias("energy"), middle("b.cx").alias("center_x"), middle("b.cy").alias("center_y"))


def phash(pixels32: DataFrame) -> DataFrame:
    """(image_id, phash): 16 hex digits from the 8 x 8 low cosine coefficients of a 32 x 32 picture; a bit is set above the 33rd smallest.

    One aggregation: each pixel adds to 64 sums, which are combined before they move. Sums are rounded at 1e-6, so that rounding
    noise decides no bit. A missing pixel is black.
    """
    wave = lambda k, c: F.element_at(F.array(*(F.lit(math.cos(math.pi * k * (2 * x + 1) / 64)) for x in range(32))), (F.col(c) + 1).cast("int"))
    p = pixels32.select("image_id", luminance().alias("lum"), *(wave(k, "x").alias(f"x{k}") for k in range(8)), *(wave(k, "y").alias(f"y{k}") for k in range(8)))
    sums = p.groupBy("image_id").agg(*(F.sum(F.col("lum") * F.col(f"x{u}") * F.col(f"y{v}")).alias(f"s{8 * v + u}") for v in range(8) for u in range(8)))
    c = sums.select("image_id", F.array(*(F.round(f"s{k}", 6) for k in range(64))).alias("c"))
    c = c.withColumn("mid", F.get(F.sort_array("c"), F.lit(32)))
    bits = F.array_join(F.transform("c", lambda x: F.when(x > F.col("mid"), "1").otherwise("0")), "")
    digits = c.select("image_id", bits.alias("b"))
    return digits.select("image_id", F.lower(F.concat(*(F.conv(F.substring("b", 1 + 4 * i, 4), 2, 16) for i in range(16)))).alias("phash"))


def lsb_share(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b): share of odd values in each channel."""
    return pixels.groupBy("image_id").agg(*(F.avg(F.pmod(c, F.lit(2))).alias(c) for c in "rgb"))


#: The largest colour table that is broadcast: entries of a 3D table of 129 a side (24 bytes each).
MOST_ENTRIES = 129**3


def apply_lut(pixels: DataFrame, lut: DataFrame, size: int, low: float | tuple = 0.0, high: float | tuple = 255.0, kind: str = "3D") -> DataFrame:
    """pixels plus lr, lg, lb through a table lut(i, r, g, b): one row out for each row in.

    kind 3D: size**3 entries, red index fastest, trilinear; 1D: size entries, linear by channel. Input is clamped to low..high
    (of each channel, if three are given). The table, whose size is checked, is one broadcast row of arrays, so pixels are
    only projected. A null colour gives nulls.
    """
    want = size**3 if kind == "3D" else size
    facts = lut.agg(F.count("*").alias("n"), F.count_distinct("i").alias("k"), F.min("i").alias("a"), F.max("i").alias("b")).first()
    if want > MOST_ENTRIES or tuple(facts) != (want, want, 0, want - 1):
        raise ValueError(f"a {kind} table of size {size} has entries 0 to {want - 1}, {MOST_ENTRIES} at most; this has {facts['n']}, {facts['a']} to {facts['b']}")
    rows = F.sort_array(F.collect_list(F.struct("i", *(F.col(c).cast("double").alias(c) for c in "rgb"))))
    arrays = lut.agg(rows.alias("_t")).select(*(F.col("_t").getField(c).alias(f"_t{c}") for c in "rgb"))
    three = lambda v: v if isinstance(v, tuple) else (v, v, v)
    place = {}
    for c, a, b in zip("rgb", three(low), three(high)):
        v = (F.col(c) - a) / (b - a) if b > a else F.col(c).cast("double")
        place[f"_{c}"] = F.when(F.col(c).isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (size - 1))
    p = pixels.withColumns(place).withColumns({f"_{c}0": F.floor(f"_{c}").cast("int") for c in "rgb"})
    p = p.withColumns({f"_{c}1": F.least(F.col(f"_{c}0") + 1, F.lit(size - 1)) for c in "rgb"}).withColumns({f"_{c}d": F.col(f"_{c}") - F.col(f"_{c}0") for c in "rgb"})
    met = p.crossJoin(F.broadcast(arrays))  # one row
    mix = lambda a, b, t: a * (1 - t) + b * t

    def at(channel: str, corner: str) -> Column:
        r, g, b = (F.col(f"_{c}{k}") for c, k in zip("rgb", corner))
        return F.get(f"_t{channel}", r + g * size + b * size * size)

    def looked_up(c: str) -> Column:
        if kind != "3D":
            return mix(F.get(f"_t{c}", F.col(f"_{c}0")), F.get(f"_t{c}", F.col(f"_{c}1")), F.col(f"_{c}d"))
        along = lambda gb: mix(at(c, "0" + gb), at(c, "1" + gb), F.col("_rd"))
        return mix(mix(along("00"), along("10"), F.col("_gd")), mix(along("01"), along("11"), F.col("_gd")), F.col("_bd"))

    return met.select(*pixels.columns, *(looked_up(c).alias(f"l{c}") for c in "rgb"))


def lut_facts(lut: DataFrame) -> DataFrame:
    """(lut_id, rows, complete, low, high): whether a table has all its rows, and its value range."""
    return lut.groupBy("lut_id").agg(F.count("*").alias("rows"), (F.count("*") == F.max(F.when(F.col("type") == "3D", F.pow("size", F.lit(3))).otherwise(F.col("size")))).alias("complete"), F.min(F.least("r", "g", "b")).alias("low"), F.max(F.greatest("r", "g", "b")).alias("high"))
