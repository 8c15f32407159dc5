"""GPS tracks, sensor logs, edit timelines and machine paths: ordered series, one per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.folds import fold_in_order

RADIUS = 6_371_000.0  # metres


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points given in degrees."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def track_distance(points: DataFrame, track: str = "track_id", seq: str = "seq") -> DataFrame:
    """points plus step_m and distance_m (running), in seq order within each track."""
    w = W.partitionBy(track).orderBy(seq)
    p = points.withColumns({"_a": F.lag("lat").over(w), "_o": F.lag("lon").over(w)})
    step = F.coalesce(great_circle(F.col("_a"), F.col("_o"), F.col("lat"), F.col("lon")), F.lit(0.0))
    return p.withColumn("step_m", step).drop("_a", "_o").withColumn("distance_m", F.sum("step_m").over(w.rowsBetween(W.unboundedPreceding, 0)))


def track_moving(points: DataFrame, pause: float = 60, track: str = "track_id", seq: str = "seq") -> DataFrame:
    """(track, distance_m, moving_m, moving_s, kmh, min_per_km): steps of more than 0 and at most `pause` seconds are moving."""
    w = W.partitionBy(track).orderBy(seq)
    p = track_distance(points, track, seq).withColumn("dt", (F.unix_micros("time") - F.lag(F.unix_micros("time")).over(w)) / 1e6)
    moving = (F.col("dt") > 0) & (F.col("dt") <= pause)
    s = p.groupBy(track).agg(F.sum("step_m").alias("distance_m"), F.coalesce(F.sum(F.when(moving, F.col("step_m"))), F.lit(0.0)).alias("moving_m"), F.coalesce(F.sum(F.when(moving, F.col("dt"))), F.lit(0.0)).alias("moving_s"))
    return s.withColumns({"kmh": F.when(F.col("moving_s") > 0, F.col("moving_m") / F.col("moving_s") * 3.6), "min_per_km": F.when(F.col("moving_m") > 0, F.col("moving_s") / 60 / (F.col("moving_m") / 1000))})


def track_climb(points: DataFrame, threshold: float = 2.0, track: str = "track_id", seq: str = "seq") -> DataFrame:
    """(track, ascent, descent): a reference elevation moves only when the change reaches the threshold.

    Each step depends on the last accepted reference, so this is a fold over the track's points in order.
    """

    def step(state, heights):
        ref, up, down, begun = state
        for x in heights.tolist():
            if not begun:
                ref, begun = x, True
            elif x - ref >= threshold:
                ref, up = x, up + (x - ref)
            elif ref - x >= threshold:
                ref, down = x, down + (ref - x)
        return ref, up, down, begun

    e = points.withColumn("_e", F.col("ele").cast("double"))
    return fold_in_order(e, track, seq, "_e", (0.0, 0.0, 0.0, False), step, f"{track} {dict(points.dtypes)[track]}, ref double, ascent double, descent double, begun boolean").drop("ref", "begun")


def track_sensors(points: DataFrame, track: str = "track_id", columns: tuple[str, ...] = ("hr", "cad", "temp")) -> DataFrame:
    """(track, avg_x, max_x, ...) with missing values skipped."""
    return points.groupBy(track).agg(*(a for c in columns for a in (F.avg(c).alias(f"avg_{c}"), F.max(c).alias(f"max_{c}"))))


def track_profile(points: DataFrame, track: str = "track_id", seq: str = "seq") -> DataFrame:
    """(track, seq, distance_m, ele) of the points that have an elevation."""
    return track_distance(points, track, seq).where(F.col("ele").isNotNull()).select(track, seq, "distance_m", "ele")


def normalise_imu(imu: DataFrame, clip: str = "clip_id", seq: str = "seq", first: int = 2000) -> DataFrame:
    """imu with scaled axes (gyro also in degrees), t from the clip's start, duration and rate.

    rate = 1 / the upper-middle step among the clip's first samples; unreadable axes are 0.
    """
    w, whole = W.partitionBy(clip).orderBy(seq), W.partitionBy(clip)
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    k = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    t = imu.withColumn("t", F.col("t") * k("tscale")).withColumns({a: z(a) * k("gscale") for a in ("gx", "gy", "gz")} | {a: z(a) * k("ascale") for a in ("ax", "ay", "az")})
    t = t.withColumns({f"{a}_deg": F.degrees(a) for a in ("gx", "gy", "gz")}).withColumn("t", F.col("t") - F.first("t").over(w))
    t = t.withColumns({"_dt": F.col("t") - F.lag("t").over(w), "_rn": F.row_number().over(w), "duration": F.max("t").over(whole)})
    steps = t.where((F.col("_rn") <= first) & F.col("_dt").isNotNull()).groupBy(clip).agg(F.sort_array(F.collect_list("_dt")).alias("s"))
    rate = steps.select(clip, F.try_divide(F.lit(1.0), F.get("s", F.floor(F.size("s") / 2).cast("int"))).alias("rate"))
    return t.join(rate, clip, "left").drop("_dt", "_rn")


def decimate(df: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Every k-th row of each key, k = ceil(rows / limit)."""
    w = W.partitionBy(key).orderBy(*order)
    d = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy(key))})
    return d.where(F.pmod("_rn", F.ceil(F.col("_n") / limit)) == 0).drop("_rn", "_n")


def imu_clock(frames: DataFrame, fps: float, samples: str = "samples") -> DataFrame:
    """(clip_id, frame, i, t, raw...): sub-samples of a frame spread over its time, t = (frame + i / n) / fps; accel in g, gyro in rad/s."""
    e = frames.select("clip_id", "frame", F.size(samples).alias("n"), "accel_per_g", "gyro_per_dps", F.posexplode(samples).alias("i", "s"))
    g = {f"a{a}": F.col(f"s.a{a}") / F.col("accel_per_g") for a in "xyz"} | {f"g{a}": F.radians(F.col(f"s.g{a}") / F.col("gyro_per_dps")) for a in "xyz"}
    return e.select("clip_id", "frame", "i", ((F.col("frame") + F.col("i") / F.col("n")) / fps).alias("t"), *(v.alias(k) for k, v in g.items()))


def timeline(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, sequences) of clips(project, track, start, duration): clips per track and latest end per project."""
    tracks = clips.groupBy("project", "track").agg(F.count("*").alias("clips"), F.sum("duration").alias("used"))
    return tracks, clips.groupBy("project").agg(F.count("*").alias("clips"), F.max(F.col("start") + F.col("duration")).alias("length"))


def placed(clips: DataFrame, order: str = "seq") -> DataFrame:
    """clips (with gaps as rows) plus start: durations laid end to end within a track."""
    w = W.partitionBy("project", "track").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return clips.withColumn("start", F.coalesce(F.sum("duration").over(w), F.lit(0.0)))


def midi_duration(tempo: DataFrame) -> DataFrame:
    """(file, seconds, first_bpm) of tempo(file, tick, us, ppq, max_tick): each tempo lasts to the next; 120 a minute before the first."""
    start = tempo.groupBy("file").agg(F.min("tick").alias("t0"), F.max("ppq").alias("ppq"), F.max("max_tick").alias("max_tick")).where("t0 > 0").select("file", F.lit(0).cast("long").alias("tick"), F.lit(500_000).alias("us"), "ppq", "max_tick")
    t = tempo.select("file", "tick", "us", "ppq", "max_tick").unionByName(start)
    ends = F.coalesce(F.lead("tick").over(W.partitionBy("file").orderBy("tick")), F.col("max_tick"))
    return t.withColumn("_n", F.greatest(ends - F.col("tick"), F.lit(0))).groupBy("file").agg(F.sum(F.col("_n") / F.col("ppq") * F.col("us") / 1e6).alias("seconds"), (60e6 / F.min_by("us", "tick")).alias("first_bpm"))


def scene_changes(frames: DataFrame, threshold: float = 55.0) -> DataFrame:
    """(clip_id, t, diff, confidence): consecutive frames (rgb arrays) whose mean absolute difference is over the threshold."""
    before = F.lag("rgb").over(W.partitionBy("clip_id").orderBy("t"))
    d = frames.withColumn("_b", before).where(F.col("_b").isNotNull())
    diff = F.aggregate(F.zip_with("rgb", "_b", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size("rgb")
    return d.select("clip_id", "t", diff.alias("diff")).where(F.col("diff") > threshold).withColumn("confidence", F.least(F.lit(99), F.floor(50 * F.col("diff") / threshold + 0.5)).cast("int"))


def timed_lines(lines: DataFrame, by: str = "path", line: str = "line") -> DataFrame:
    """(path, seconds, text): a row per time stamp [mm:ss.xx] of a line, in order; untimed lines last."""
    stamps = F.regexp_extract_all(line, F.lit(r"\[(\d+:\d+(?:[.:]\d+)?)\]"), F.lit(1))
    text = F.trim(F.regexp_replace(line, r"\[\d+:\d+(?:[.:]\d+)?\]", ""))
    e = lines.select(by, "line_no", text.alias("text"), F.explode_outer(stamps).alias("s"))
    p = F.split(F.regexp_replace("s", r":(\d+)$", ":$1"), ":")
    secs = F.get(p, F.lit(0)).cast("double") * 60 + F.get(p, F.lit(1)).cast("double") + F.coalesce(F.try_divide(F.get(p, F.lit(2)).cast("double"), F.lit(100.0)), F.lit(0.0))
    return e.select(by, "line_no", secs.alias("seconds"), "text").orderBy(by, F.asc_nulls_last("seconds"), "line_no")


def toolpath_moves(lines: DataFrame, by: str = "path") -> DataFrame:
    """(path, line_no, mode, absolute, x, y, z, e, f, length, extrude): moves of machine code, modal words carried down the file.

    Every modal word is the last one seen; relative moves add up from the last absolute position. No line looks at the
    result of another, so it is windows only.
    """
    code = F.upper(F.regexp_replace("line", r"\([^)]*\)|;.*$", ""))
    num = lambda w: F.nullif(F.regexp_extract(code, rf"{w}\s*([+-]?\d*\.?\d+)", 1), F.lit("")).cast("double")
    g = F.nullif(F.regexp_extract(code, r"\bG0*([0-3])\b(?!\d)", 1), F.lit("")).cast("int")
    w = W.partitionBy(by).orderBy("line_no")
    carry = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    absolute = F.when(code.rlike(r"\bG90\b"), 1).when(code.rlike(r"\bG91\b"), 0)
    unit = F.when(code.rlike(r"\bG20\b"), 25.4).when(code.rlike(r"\bG21\b"), 1.0)
    t = lines.select(by, "line_no", g.alias("g"), absolute.alias("a"), unit.alias("u"), num("F").alias("f"), *(num(a).alias(a.lower()) for a in "XYZE"))
    t = t.withColumns({"mode": carry("g"), "absolute": F.coalesce(carry("a"), F.lit(1)), "unit": F.coalesce(carry("u"), F.lit(1.0)), "f": carry("f")})
    for a in "xyz":
        v = F.col(a) * F.col("unit")
        t = t.withColumn(f"_{a}s", F.sum(F.when(F.col(a).isNotNull() & (F.col("absolute") == 1), 1).otherwise(0)).over(w))
        run = W.partitionBy(by, f"_{a}s").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
        base = F.first(F.when(F.col("absolute") == 1, v), ignorenulls=True).over(run)
        t = t.withColumn(f"p{a}", F.coalesce(base, F.lit(0.0)) + F.sum(F.when(F.col("absolute") == 0, F.coalesce(v, F.lit(0.0))).otherwise(0.0)).over(run))
    d = lambda a: F.col(f"p{a}") - F.coalesce(F.lag(f"p{a}").over(w), F.lit(0.0))
    t = t.withColumn("length", F.sqrt(d("x") * d("x") + d("y") * d("y") + d("z") * d("z")))
    moves = t.where((F.col("x").isNotNull() | F.col("y").isNotNull() | F.col("z").isNotNull()) & F.col("mode").isNotNull())
    return moves.select(by, "line_no", "mode", "absolute", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), "e", "f", "length", F.coalesce(F.col("e") > 0, F.lit(False)).alias("extrude"))


def toolpath_summary(lines: DataFrame, by: str = "path") -> DataFrame:
    """One row per file: counts by kind of move, lengths, feed range, bounds, layers and the upper-middle layer gap."""
    m = toolpath_moves(lines, by)
    per = m.groupBy(by).agg(
        F.count_if(F.col("mode") == 0).alias("rapid"), F.count_if(F.col("mode") == 1).alias("feed"), F.count_if(F.col("mode") > 1).alias("arc"), F.count_if("extrude").alias("extrude"),
        F.sum(F.when(F.col("extrude"), F.col("length")).otherwise(0.0)).alias("extruded_mm"), F.sum(F.when((F.col("mode") > 0) & ~F.col("extrude"), F.col("length")).otherwise(0.0)).alias("cut_mm"),
        F.min("f").alias("feed_min"), F.max("f").alias("feed_max"), *(x(a).alias(f"{n}_{a}") for a in "xyz" for n, x in (("min", F.min), ("max", F.max))),
    )
    z = m.where("mode > 0").select(by, F.round("z", 3).alias("z")).distinct()
    gaps = z.withColumn("gap", F.col("z") - F.lag("z").over(W.partitionBy(by).orderBy("z"))).groupBy(by).agg(F.count("*").alias("layers"), F.sort_array(F.collect_list("gap")).alias("g"))
    return per.join(gaps.select(by, "layers", F.get("g", F.floor(F.size("g") / 2).cast("int")).alias("layer_gap")), by, "left")
