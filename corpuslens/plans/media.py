"""Queries over tracks, samples, pixels, meshes, hashes and findings, on stand-ins from the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import scalars
from corpuslens.operators import geometry, pixels, profile, search, signal, similarity, tracks, usage
from corpuslens.session import table


def _points(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), (40 + F.pmod(F.col("event_id") * 37, F.lit(1000)) / 10000).alias("lat"), (20 + F.pmod(F.col("event_id") * 53, F.lit(1000)) / 10000).alias("lon"), F.col("value").alias("ele"), F.col("ts").alias("time"), (F.col("event_id") % 90 + 60).cast("double").alias("hr"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("cad"), F.lit(None).cast("double").alias("temp"))


def _samples(s, d):
    e = table(s, d, "events")
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 1000))
    return e.select(F.col("user_id").alias("clip_id"), F.lit(0).alias("channel"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("idx"), v.alias("v"), F.lit(100).alias("sample_rate"))


def _pixels(s, d):
    li = table(s, d, "lineitem")
    m = lambda c: F.pmod(c, F.lit(256)).cast("int")
    return li.select(F.col("l_suppkey").alias("image_id"), m(F.col("l_partkey") * 7).alias("r"), m(F.col("l_orderkey") * 5).alias("g"), m(F.col("l_linenumber") * 31 + F.col("l_partkey")).alias("b"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"))


def _triangles(s, d):
    li = table(s, d, "lineitem")
    c = {"ax": "l_quantity", "ay": "l_discount", "az": "l_tax", "bx": "l_tax", "by": "l_quantity", "bz": "l_discount", "cx": "l_discount", "cy": "l_tax", "cz": "l_quantity"}
    return li.select(F.col("l_returnflag").alias("mesh_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tri"), *(F.col(v).alias(k) for k, v in c.items()))


def _identity(s, size=5):
    return s.range(size**3).select(F.col("id").alias("i"), *((F.expr(f"id div {size**k} % {size}") * (255.0 / (size - 1))).alias(c) for k, c in enumerate("rgb")))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _clips(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_returnflag").alias("track"), F.col("l_linenumber").cast("double").alias("start"), F.col("l_quantity").alias("duration"))


def _hashes(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_bits(F.col("embedding")).alias("hash"))


def _fans(s, d):
    """Triangles that share a corner within 50 groups of each mesh."""
    g = F.col("l_orderkey") % 50
    corners = {"ax": g, "ay": F.lit(0), "az": F.lit(0), "bx": g, "by": F.lit(1), "bz": F.lit(0), "cx": F.col("l_linenumber"), "cy": F.lit(7), "cz": g + 5}
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("mesh_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tri"), *(c.cast("double").alias(k) for k, c in corners.items()))


QUERIES = {
    "w1_track_distance": lambda s, d: _r(tracks.track_distance(_points(s, d)).groupBy("track_id").agg(F.max("distance_m").alias("distance_m"), F.count("*").alias("n")), "distance_m"),
    "w2_track_moving": lambda s, d: _r(tracks.track_moving(_points(s, d), 3600.0), "distance_m", "moving_m", "moving_s", "kmh", "min_per_km"),
    "w3_track_climb": lambda s, d: _r(tracks.track_climb(_points(s, d)), "ascent", "descent"),
    "w4_track_sensors": lambda s, d: _r(tracks.track_sensors(_points(s, d), columns=("hr", "cad")), "avg_hr", "avg_cad", "max_cad", "max_hr"),
    "w5_track_profile": lambda s, d: _r(tracks.track_profile(_points(s, d).withColumn("ele", F.when(F.col("seq") % 2 == 0, F.col("ele")))), "ele").withColumn("distance_m", F.round("distance_m", 2)),
    "w6_normalise_imu": lambda s, d: _r(tracks.normalise_imu(table(s, d, "events").select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"), (F.unix_micros("ts") / 1e6).alias("t"), *(F.col("value").alias(c) for c in ("gx", "gy", "gz", "ax", "ay", "az")), F.lit(1.0).alias("tscale"), F.lit(0.5).alias("gscale"), F.lit(2.0).alias("ascale"))).groupBy("clip_id").agg(F.max("rate").alias("rate"), F.max("duration").alias("duration"), F.max("gx").alias("gx"), F.max("ax").alias("ax"), F.max("gx_deg").alias("gx_deg")), "rate", "duration", "gx", "ax", "gx_deg"),
    "w7_decimate": lambda s, d: tracks.decimate(table(s, d, "events"), "user_id", ["ts", "event_id"], 20).select("event_id"),
    "w18_timeline": lambda s, d: tracks.timeline(_clips(s, d))[1],
    "w18_placed": lambda s, d: tracks.placed(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("project"), F.lit("v").alias("track"), F.col("l_linenumber").alias("seq")).agg(F.sum("l_quantity").alias("duration"))).select("project", "seq", "start"),
    "w21_envelope": lambda s, d: _r(signal.envelope(_samples(s, d), 10), "min", "max"),
    "w22_loudest_moment": lambda s, d: _r(signal.loudest_moment(_samples(s, d)), "at_s", "level_db"),
    "w23_amplitude_histogram": lambda s, d: signal.amplitude_histogram(_samples(s, d)),
    "g1_level_stats": lambda s, d: _r(signal.level_stats(_samples(s, d)), "peak", "rms", "peak_db", "rms_db"),
    "g3_stereo_stats": lambda s, d: _r(signal.stereo_stats(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("clip_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx")).agg(F.max("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax")).select("clip_id", "idx", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("l_discount").alias("v")), F.struct(F.lit(1).alias("channel"), F.col("l_tax").alias("v")))).alias("c")).select("clip_id", "idx", "c.channel", "c.v")), "correlation", "width", "mid_rms", "side_rms"),
    "g9_channel_histogram": lambda s, d: pixels.channel_histogram(_pixels(s, d)),
    "g10_color_stats": lambda s, d: pixels.color_stats(_pixels(s, d)),
    "g11_dominant_colors": lambda s, d: pixels.dominant_colors(_pixels(s, d)).select("image_id", F.array_join(F.transform("colors", lambda c: scalars.rgb_hex(c["r"], c["g"], c["b"])), " ").alias("colors")),
    "g15_lsb_share": lambda s, d: _r(pixels.lsb_share(_pixels(s, d)), "r", "g", "b"),
    "g16_apply_lut": lambda s, d: _r(pixels.apply_lut(_pixels(s, d), _identity(s), 5), "lr", "lg", "lb"),
    "g17_mesh_stats": lambda s, d: _r(geometry.mesh_stats(_triangles(s, d)), "area", "volume").select("mesh_id", "triangles", "area", "volume", "min_x", "max_x", "min_z", "max_z"),
    "g18_graph_bodies": lambda s, d: geometry.graph_bodies(table(s, d, "lineitem"), "l_suppkey", "l_partkey"),
    "g18_mesh_bodies": lambda s, d: geometry.mesh_bodies(_fans(s, d)),
    "a35_summarise_nets": lambda s, d: geometry.summarise_nets(table(s, d, "lineitem").select(F.col("l_returnflag").alias("board"), F.col("l_linenumber").cast("string").alias("net"), F.col("l_suppkey").cast("string").alias("ref"), F.col("l_linestatus").alias("pin"), F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"))),
    "f10_rgb": lambda s, d: _pixels(s, d).select("image_id", "x", "y", scalars.rgb_hex("r", "g", "b").alias("hex"), scalars.rgb_hsl("r", "g", "b").alias("c")).select("image_id", "x", "y", "hex", "c.h", "c.s", "c.l"),
    "j7_near_duplicates": lambda s, d: similarity.near_duplicates(_hashes(s, d), 20),
    "q1_findings": lambda s, d: search.to_findings(profile.fill_rates(table(s, d, "customer")), "customer", "Profile", F.col("column"), ["filled", "total", "fill_percent"]),
    "q2_search": lambda s, d: search.search_texts(table(s, d, "documents"), "License", synonyms={"license": ["licence", "copyright", "mit"]}),
    "q4_number_matches": lambda s, d: search.number_matches(search.search_texts(table(s, d, "documents"), "token"), ["doc_id"]),
    "j1_lookup_join": lambda s, d: usage.top_counts(table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"), "n_name", 10),
}

_PTS = "(select user_id as track_id, event_id as seq, 40 + (event_id * 37 % 1000) / 10000.0 as lat, 20 + (event_id * 53 % 1000) / 10000.0 as lon, value as ele, ts, event_id % 90 + 60.0 as hr, case when event_id % 3 = 0 then value end as cad from events)"
_STEPS = f"""(with p as (select *, lag(lat) over w as a, lag(lon) over w as o, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as dt from {_PTS} window w as (partition by track_id order by seq))
  select *, case when a is null then 0.0 else (2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - o) / 2), 2), 1.0)))) end as step_m from p)"""
_SMP = "(select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, greatest(-1.0, least(1.0, value / 1000)) as v from events)"
_PIX = "(select l_suppkey as image_id, l_partkey * 7 % 256 as r, l_orderkey * 5 % 256 as g, (l_linenumber * 31 + l_partkey) % 256 as b, l_orderkey as x, l_linenumber as y from lineitem)"
_LUM = "299e-3 * r + 587e-3 * g + 114e-3 * b"
ORACLE = {
    "w1_track_distance": f"select track_id, round(sum(step_m), 6) as distance_m, count(*) as n from {_STEPS} group by 1",
    "w2_track_moving": f"""with s as (select track_id, sum(step_m) as distance_m, coalesce(sum(step_m) filter (where dt > 0 and dt <= 3600), 0) as moving_m, coalesce(sum(dt) filter (where dt > 0 and dt <= 3600), 0) as moving_s from {_STEPS} group by 1)
      select track_id, round(distance_m, 6) as distance_m, round(moving_m, 6) as moving_m, round(moving_s, 6) as moving_s, round(case when moving_s > 0 then moving_m / moving_s * 3.6 end, 6) as kmh, round(case when moving_m > 0 then moving_s / 60 / (moving_m / 1000) end, 6) as min_per_km from s""",
    "w3_track_climb": """with l as (select user_id as track_id, list(value order by event_id) as e from events group by 1),
      f as (select track_id, list_reduce(list_transform(e, lambda x: [x, 0.0, 0.0]), lambda a, x: [case when abs(x[1] - a[1]) >= 2 then x[1] else a[1] end, a[2] + case when x[1] - a[1] >= 2 then x[1] - a[1] else 0 end, a[3] + case when a[1] - x[1] >= 2 then a[1] - x[1] else 0 end]) as r from l)
      select track_id, round(r[2], 6) as ascent, round(r[3], 6) as descent from f""",
    "w4_track_sensors": f"select track_id, round(avg(hr), 6) as avg_hr, round(max(hr), 6) as max_hr, round(avg(cad), 6) as avg_cad, round(max(cad), 6) as max_cad from {_PTS} group by 1",
    "w5_track_profile": f"select track_id, seq, round(d, 2) as distance_m, round(ele, 6) as ele from (select *, sum(step_m) over (partition by track_id order by seq) as d from {_STEPS}) where seq % 2 = 0",
    "w6_normalise_imu": """with t as (select user_id as clip_id, event_id as seq, epoch_us(ts) / 1e6 as t, value from events), s as (select *, t - first_value(t) over w as u, t - lag(t) over w as dt, row_number() over w as rn from t window w as (partition by clip_id order by seq)),
      m as (select clip_id, list_sort(list(dt) filter (where dt is not null and rn <= 2000)) as l, max(u) as duration, max(value) as v from s group by 1)
      select clip_id, round(1 / nullif(l[len(l) // 2 + 1], 0), 6) as rate, round(duration, 6) as duration, round(v * 0.5, 6) as gx, round(v * 2, 6) as ax, round(degrees(v * 0.5), 6) as gx_deg from m""",
    "w7_decimate": "select event_id from (select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as rn, count(*) over (partition by user_id) as n from events) where rn % cast(ceil(n / 20.0) as bigint) = 0",
    "w18_timeline": "select l_orderkey as project, count(*) as clips, max(l_linenumber + l_quantity) as length from lineitem group by 1",
    "w18_placed": "select l_orderkey as project, l_linenumber as seq, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as start from (select l_orderkey, l_linenumber, sum(l_quantity) as l_quantity from lineitem group by all)",
    "w21_envelope": f"""with n as (select clip_id, max(idx) + 1 as n from {_SMP} group by 1) select clip_id, cast(floor(idx * 10 / n) as int) as slice, round(min(v), 6) as min, round(max(v), 6) as max, max(abs(v)) >= 0.999 as clipped from {_SMP} join n using (clip_id) group by 1, 2""",
    "w22_loudest_moment": f"""with b as (select clip_id, idx // 5 as block, avg(v * v) as ms from {_SMP} group by 1, 2), r as (select *, row_number() over (partition by clip_id order by ms desc, block) as r from b)
      select clip_id, round((block + 0.5) * 5 / 100, 6) as at_s, round(20 * log10(sqrt(ms) + 1e-12), 6) as level_db from r where r = 1""",
    "w23_amplitude_histogram": f"select clip_id, cast(greatest(0, least(255, floor((v + 1) / 2 * 256))) as int) as bin, count(*) as n from {_SMP} group by 1, 2",
    "g1_level_stats": f"select clip_id, count(*) as n, round(max(abs(v)), 6) as peak, round(sqrt(avg(v * v)), 6) as rms, count(*) filter (where abs(v) >= 0.999) as clipped, round(20 * log10(max(abs(v)) + 1e-12), 6) as peak_db, round(20 * log10(sqrt(avg(v * v)) + 1e-12), 6) as rms_db from {_SMP} group by 1",
    "g3_stereo_stats": """with s as (select l_suppkey as clip_id, sum(l_discount * l_tax) as lr, sum(l_discount * l_discount) as ll, sum(l_tax * l_tax) as rr, sqrt(avg(pow(l_discount + l_tax, 2) / 4)) as m, sqrt(avg(pow(l_discount - l_tax, 2) / 4)) as d from (select l_suppkey, max(l_discount) as l_discount, max(l_tax) as l_tax from lineitem group by l_suppkey, l_orderkey * 10 + l_linenumber) group by 1)
      select clip_id, round(lr / sqrt(ll * rr), 6) as correlation, round(1 - abs(lr / sqrt(ll * rr)), 6) as width, round(m, 6) as mid_rms, round(d, 6) as side_rms from s""",
    "g9_channel_histogram": f"select image_id, channel, cast(value as int) as value, count(*) as n from (select image_id, unnest(['r', 'g', 'b', 'l']) as channel, unnest([r, g, b, cast(floor({_LUM}) as bigint)]) as value from {_PIX}) group by all",
    "g10_color_stats": f"""select image_id, cast(floor(avg(r) + 0.5) as int) as r, cast(floor(avg(g) + 0.5) as int) as g, cast(floor(avg(b) + 0.5) as int) as b, floor(1000.0 * count(*) filter (where {_LUM} < 64) / count(*) + 0.5) / 10 as shadow,
      floor(1000.0 * count(*) filter (where {_LUM} >= 64 and {_LUM} < 192) / count(*) + 0.5) / 10 as midtone, floor(1000.0 * count(*) filter (where {_LUM} >= 192) / count(*) + 0.5) / 10 as highlight from {_PIX} group by 1""",
    "g11_dominant_colors": f"""with c as (select image_id, r // 32 * 32 + 16 as r, g // 32 * 32 + 16 as g, b // 32 * 32 + 16 as b, count(*) as n from {_PIX} group by all),
      l as (select image_id, list([[r, g, b]] order by n desc, r, g, b) as o from c group by 1),
      f as (select image_id, list_reduce(o, lambda a, x: case when len(a) >= 8 or len(list_filter(a, lambda y: abs(y[1] - x[1][1]) + abs(y[2] - x[1][2]) + abs(y[3] - x[1][3]) < 60)) > 0 then a else list_concat(a, x) end) as t from l)
      select image_id, array_to_string(list_transform(t, lambda c: printf('#%02x%02x%02x', c[1], c[2], c[3])), ' ') as colors from f""",
    "g15_lsb_share": f"select image_id, round(avg(r % 2), 6) as r, round(avg(g % 2), 6) as g, round(avg(b % 2), 6) as b from {_PIX} group by 1",
    "g16_apply_lut": f"select image_id, x, y, r, g, b, round(r * 1.0, 6) as lr, round(g * 1.0, 6) as lg, round(b * 1.0, 6) as lb from {_PIX}",
    "g17_mesh_stats": """with t as (select l_returnflag as m, l_quantity as q, l_discount as d, l_tax as t from lineitem), n as (select *, t - q as ux, q - d as uy, d - t as uz, d - q as wx, t - d as wy, q - t as wz from t)
      select m as mesh_id, count(*) as triangles, round(sum(sqrt(pow(uy * wz - uz * wy, 2) + pow(uz * wx - ux * wz, 2) + pow(ux * wy - uy * wx, 2)) / 2), 6) as area,
        round(abs(sum((q * (q * q - d * t) + d * (d * d - t * q) + t * (t * t - q * d)) / 6)), 6) as volume, min(least(q, t, d)) as min_x, max(greatest(q, t, d)) as max_x, min(least(q, t, d)) as min_z, max(greatest(q, t, d)) as max_z from n group by 1""",
    "g18_graph_bodies": """with recursive e as (select distinct l_suppkey as s, l_partkey as p from lineitem), l as (select distinct x.s as a, y.s as b from e x join e y using (p)),
      r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), c as (select r.a as s, min(-p - 1) as component from r join e on e.s = r.b group by 1),
      n as (select s as node, component from c union all select distinct -p - 1, component from e join c using (s))
      select component, count(*) as nodes from n group by 1""",
    "g18_mesh_bodies": """with b as (select l_suppkey as mesh_id, l_orderkey % 50 as g, count(*) as triangles, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by all)
      select mesh_id, cast(row_number() over (partition by mesh_id order by triangles desc, first) as int) as body, triangles from b""",
    "a35_summarise_nets": """select l_returnflag as board, count(*) as points, count(distinct l_linenumber) as nets, count(distinct l_suppkey) as components, count(distinct l_suppkey || '/' || l_linestatus) as pins, min(l_suppkey) as min_x, max(l_suppkey) as max_x, min(l_partkey) as min_y, max(l_partkey) as max_y from lineitem group by 1""",
    "f10_rgb": f"""with p as (select *, greatest(r, g, b) / 255e0 as hi, least(r, g, b) / 255e0 as lo from {_PIX}), q as (select *, hi - lo as d, (hi + lo) / 2 as lum from p),
      h as (select *, case when d = 0 then 0 when hi = r / 255e0 then (g / 255e0 - b / 255e0) / d + case when g < b then 6 else 0 end when hi = g / 255e0 then (b / 255e0 - r / 255e0) / d + 2 else (r / 255e0 - g / 255e0) / d + 4 end as hue, case when d = 0 then 0 when lum > 0.5 then d / (2 - hi - lo) else d / (hi + lo) end as sat from q)
      select image_id, x, y, printf('#%02x%02x%02x', r, g, b) as hex, cast(floor(hue * 60 + 0.5) as int) as h, cast(floor(sat * 100 + 0.5) as int) as s, cast(floor(lum * 100 + 0.5) as int) as l from h""",
    "j7_near_duplicates": """with h as (select vec_id as id, list_transform(embedding, lambda x: x > 0) as b from embeddings), m as (select b, min(id) as id from h group by b),
      p as (select x.id as a, y.id as b, len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) as distance from m x join m y on x.id < y.id)
      select a, b, distance from p where distance <= 20 union all select m.id, h.id, 0 from h join m on m.b = h.b where h.id > m.id""",
    "q1_findings": """with f as (select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as c, unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) as n, count(*) as t from customer)
      select 'customer' as source, 'Profile' as section, c as grp, unnest(['filled', 'total', 'fill_percent']) as field, unnest([cast(n as varchar), cast(t as varchar), cast(cast(floor(100.0 * n / t + 0.5) as bigint) as varchar)]) as value from f""",
    "q2_search": """with n as (select doc_id, lower(text) as t from documents), h as (select doc_id, (length(t) - length(replace(t, 'license', ''))) // 7 + (length(t) - length(replace(t, 'licence', ''))) // 7 + (length(t) - length(replace(t, 'copyright', ''))) // 9 + (length(t) - length(replace(t, 'mit', ''))) // 3 as hits from n) select doc_id, hits from h where hits > 0""",
    "q4_number_matches": """with h as (select doc_id, (length(text) - length(replace(lower(text), 'token', ''))) // 5 as hits from documents) select doc_id, hits, row_number() over (order by doc_id) as match from h where hits > 0""",
    "j1_lookup_join": "select n_name as value, count(*) as n, row_number() over (order by count(*) desc, n_name) as rank from customer join nation on c_nationkey = n_nationkey group by 1 order by n desc, value limit 10",
}
