"""Queries over clips of samples, with their SQL twins: each supplier's line items in order are a clip."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators import signal
from corpuslens.session import table

RATE = 100


def _clips(s, d):
    """(clip_id, channel, idx, v, sample_rate): quantities from -1 to 1, in the order of orders."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("l_quantity") / 25 - 1).alias("v"))
    return li.select("clip_id", F.lit(0).alias("channel"), "idx", "v", F.lit(RATE).alias("sample_rate"))


def _tones(s, d):
    """The same clips at 1,000 samples a second as a noise upon a tone, whose period of 10 to 29 samples is its supplier's."""
    period = 10 + F.col("clip_id") % 20
    tone = F.sin(2 * F.pi() * (F.col("idx") % period) / period)
    return _clips(s, d).withColumns({"v": tone + F.col("v") / 10, "sample_rate": F.lit(1000)})


def _loudness(s, d):
    return signal.loudness(_clips(s, d).withColumn("sample_rate", F.lit(8000)), piece=200).withColumn("lufs", F.round("lufs", 6))


def _pitch(s, d):
    return signal.pitch(_tones(s, d), size=256).withColumn("hz", F.round("hz", 4))


def _tempo(s, d):
    return signal.tempo(_clips(s, d), fft=8, hop=4, together=40)


def _spectrum(s, d):
    r = signal.spectrum_stats(signal.spectrogram(_clips(s, d), 8, 2))
    return r.withColumn("dynamic_range", F.round("dynamic_range", 4))


def _centroid(s, d):
    return signal.spectral_centroid(_clips(s, d), fft=8).withColumn("centroid_hz", F.round("centroid_hz", 6))


QUERIES = {
    "g2_loudness": _loudness,
    "g5_spectrum_stats": _spectrum,
    "g6_spectral_centroid": _centroid,
    "g7_pitch": _pitch,
    "g8_tempo": _tempo,
}

_CLIPS = """clips as (
  select l_suppkey as clip_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as idx,
    l_quantity / 25 - 1 as v
  from lineitem),
lengths as (select clip_id, count(*) as n from clips group by 1)"""


def _filter_sql() -> str:
    """One pass over a clip's samples as a list: the state is the two filters' four numbers and the sum of squares."""
    (b, a), (c, d) = signal._biquads(8000.0)
    y = f"({b[0]!r} * x[1] + a[1])"
    z = f"({c[0]!r} * {y} + a[3])"
    return f"""list_reduce(list_prepend([0.0::double, 0, 0, 0, 0], vs), lambda a, x: [
      {b[1]!r} * x[1] - {a[0]!r} * {y} + a[2], {b[2]!r} * x[1] - {a[1]!r} * {y},
      {c[1]!r} * {y} - {d[0]!r} * {z} + a[4], {c[2]!r} * {y} - {d[1]!r} * {z}, a[5] + {z} * {z}])"""


def _transform_sql(hop: int, frames: str, window: str, scale: str = "1") -> str:
    """(clip_id, frame, bin, m): magnitudes of the transform of 8 samples, written out."""
    return f"""starts as (select clip_id, unnest(range(0, {frames})) as frame from lengths where n >= 8),
bins as (select unnest(range(4)) as bin),
windowed as (
  select s.clip_id, frame, idx - {hop} * frame as i, v * ({window}) as v
  from starts s join clips c on s.clip_id = c.clip_id and idx >= {hop} * frame and idx < {hop} * frame + 8),
spectra as (
  select clip_id, frame, bin, sqrt(power(sum(v * cos(2 * pi() * i * bin / 8)), 2) + power(sum(v * sin(2 * pi() * i * bin / 8)), 2)) * {scale} as m
  from windowed cross join bins group by all)"""


_PERIODIC = "0.5 - 0.5 * cos(2 * pi() * (idx - {hop} * frame) / 8)"

ORACLE = {
    "g2_loudness": f"""with {_CLIPS}, l as (select clip_id, list([v] order by idx) as vs, count(*) as n from clips group by 1),
f as (select clip_id, n, {_filter_sql()} as r from l)
select clip_id, round(-0.691 + 10 * log10(r[5] / n + 1e-30), 6) as lufs from f""",
    "g5_spectrum_stats": f"""with {_CLIPS}, {_transform_sql(2, "(n - 8) // 2 + 1", "0.5 - 0.5 * cos(2 * pi() * (idx - 2 * frame) / 7)", "2 / 3.5")},
levels as (select clip_id, bin, frame, 20 * log10(m + 1e-12) as db from spectra),
tops as (select clip_id, bin, max(db) as db from levels group by all),
peaks as (select clip_id, bin as peak, db as loudest from (select *, row_number() over (partition by clip_id order by db desc, frame, bin) as r from levels) where r = 1),
quiet as (select clip_id, list_sort(list(db)) as l from tops where db > -120 group by 1)
select clip_id, any_value(peak) * 50 / 4.0 as peak_hz, min(bin) filter (where bin > 0 and db >= loudest - 60) * 50 / 4.0 as low_hz,
  max(bin) filter (where bin > 0 and db >= loudest - 60) * 50 / 4.0 as high_hz,
  round(any_value(loudest) - coalesce(any_value(l[cast(floor(len(l) * 0.1) as int) + 1]), any_value(loudest)), 4) as dynamic_range
from tops join peaks using (clip_id) left join quiet using (clip_id) group by 1""",
    "g6_spectral_centroid": f"""with {_CLIPS}, {_transform_sql(8, "n // 8", _PERIODIC.format(hop=8))},
centres as (select clip_id, frame, case when sum(m) > 1e-12 then sum(bin * 100 / 8.0 * m) / sum(m) else 0 end as c from spectra group by all),
means as (select clip_id, avg(c) as c from centres group by 1)
select clip_id, round(c, 6) as centroid_hz from lengths left join means using (clip_id)""",
    "g7_pitch": f"""with {_CLIPS},
tones as (select clip_id, idx, sin(2 * pi() * (idx % (10 + clip_id % 20)) / (10 + clip_id % 20)) + v / 10 as v from clips),
middles as (select clip_id, greatest(0, n // 2 - 128) as start, least(n - greatest(0, n // 2 - 128), 256) as size from lengths),
near as (select clip_id, size // 2 as half, list(v order by idx) as x from tones join middles using (clip_id) where size >= 128 and idx >= start and idx < start + size group by all),
d as (
  select clip_id, half, t, list_sum(list_transform(range(1, half + 1), lambda j: power(x[j] - x[j + t], 2))) as d
  from (select *, unnest(range(1, half)) as t from near)),
running as (select *, sum(d) over (partition by clip_id order by t) as seen from d),
c as (select clip_id, half, t, d * t / seen as c from running where seen > 0),
ls as (select clip_id, half, list(c order by t) as l from c group by all),
firsts as (select clip_id, min(t) as t from c where t >= 2 and t < least(half - 1, 50) and c < 0.15 group by 1),
bottoms as (
  select clip_id, half, l, (select min(u) from unnest(range(t, 50)) as r(u) where u + 1 >= least(half - 1, 50) or l[u + 1] >= l[u]) as t
  from firsts join ls using (clip_id)),
bends as (select clip_id, t, (coalesce(l[t - 1], 1) - l[t + 1]) / nullif(2 * (coalesce(l[t - 1], 1) - 2 * l[t] + l[t + 1]), 0) as shift from bottoms),
found as (select clip_id, 1000 / (t + case when abs(shift) < 1 then shift else 0 end) as hz from bends),
named as (select clip_id, hz, 69 + 12 * log2(hz / 440) as m, cast(floor(69 + 12 * log2(hz / 440) + 0.5) as bigint) as k from found where hz between 20 and 5000)
select clip_id, round(hz, 4) as hz, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[k % 12 + 1] || (k // 12 - 1) as note,
  cast(floor(100 * (m - k) + 0.5) as int) as cents
from lengths left join named using (clip_id)""",
    "g8_tempo": f"""with {_CLIPS}, {_transform_sql(4, "(n - 8) // 4", _PERIODIC.format(hop=4))},
gains as (select clip_id, frame, m - lag(m) over (partition by clip_id, bin order by frame) as g from spectra),
flux as (select clip_id, frame, coalesce(sum(g) filter (where g > 0), 0) as f from gains group by all),
means as (select *, avg(f) over (partition by clip_id order by frame rows between 8 preceding and 8 following) as mean, count(*) over (partition by clip_id) as frames from flux),
onsets as (select clip_id, frame, f as o from means where frame >= 8 and frame < frames - 8 and f > 1.5 * mean and f > 1e-9),
lags as (select a.clip_id, b.frame - a.frame as lag, sum(a.o * b.o) as c from onsets a join onsets b on a.clip_id = b.clip_id and b.frame - a.frame between 0 and 26 group by all),
every as (select clip_id, lag, coalesce(c, 0) as c from (select distinct clip_id, unnest(range(27)) as lag from onsets) left join lags using (clip_id, lag)),
best as (
  select e.clip_id, e.lag, e.c, p.c as before, q.c as after, row_number() over (partition by e.clip_id order by e.c desc, e.lag) as r
  from every e join every p on p.clip_id = e.clip_id and p.lag = e.lag - 1 join every q on q.clip_id = e.clip_id and q.lag = e.lag + 1
  where e.lag between 7 and 25),
bends as (select clip_id, lag, case when lag > 7 and lag < 25 and abs(before - 2 * c + after) > 1e-12 then 0.5 * (before - after) / (before - 2 * c + after) end as shift from best where r = 1),
beats as (select clip_id, 1500 / (lag + case when abs(shift) < 1 then shift else 0 end) as b from bends)
select clip_id, cast(case when b between 60 and 200 then floor(b + 0.5) end as bigint) as bpm from lengths left join (select * from beats join lengths using (clip_id) where (n - 8) // 4 > 25) using (clip_id)""",
}
