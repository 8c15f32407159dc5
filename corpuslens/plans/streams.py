"""Queries that run a streaming operator to the end over the event table and read what it wrote.

The stream reads the table's own file (or files), so the work follows the table. Sinks and checkpoints are in the shared
folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators import signal
from corpuslens.session import ensure_on_workers, shared_dir, table
from corpuslens.streaming import usage as stream


def _events(s, d):
    schema = table(s, d, "events").schema
    raw = s.read.parquet(f"{d}/events.parquet").schema
    src = s.readStream.schema(raw).parquet(f"{d}/events.parquet*")
    return src.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _folder(s):
    return f"{shared_dir(s)}/corpuslens-stream-{uuid.uuid4().hex}"


def _run(writer, folder):
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _ext(s, d):
    f = _folder(s)
    _run(stream.stream_ext_stats(_events(s, d).select(F.col("event_type").alias("ext"), (F.col("event_type") != "error").alias("supported")), f"{f}/out"), f)
    return stream.KeyedTable(s, f"{f}/out").read()


def _scores(s, d):
    f = _folder(s)
    _run(stream.stream_scores(_events(s, d).select(F.col("user_id").alias("name"), F.floor(F.col("value") * 100 + 0.5).alias("score"), "ts"), f"{f}/out"), f)
    return stream.KeyedTable(s, f"{f}/out").read().select("name", "score", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


def _visits(s, d):
    f = _folder(s)
    _run(stream.write_visits(_events(s, d).select(F.col("user_id").alias("client"), "ts"), f"{f}/out"), f)
    return stream.KeyedTable(s, f"{f}/out").read()


def _throttle(s, d):
    ensure_on_workers(s)
    f = _folder(s)
    t = stream.stream_throttle(_events(s, d).select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), "ts"), 1, 3600)
    _run(t.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{f}/out/b={i}")), f)
    return s.read.parquet(f"{f}/out/b=*").select(F.col("id").alias("event_id"))


def _daily(s, d):
    f = _folder(s)
    _run(stream.write_daily(_events(s, d), f"{f}/out", late="0 seconds"), f)
    return stream.KeyedTable(s, f"{f}/out").read().select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def _samples(e, by_order):
    return e.select(F.col("user_id").alias("clip_id"), by_order.alias("idx"), (F.col("value") / 1000.0).alias("v"), F.lit(8000).alias("sample_rate"))


def _spectrum(spec):
    return spec.select("clip_id", "frame", F.posexplode("db").alias("bin", "db")).withColumn("db", F.round("db", 4))


def _batch_spectrum(s, d):
    order = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _spectrum(signal.spectrogram(_samples(table(s, d, "events"), order), 8, 2))


def _live_spectrum(s, d):
    ensure_on_workers(s)
    f = _folder(s)
    spec = stream.stream_spectrogram(_samples(_events(s, d), F.col("event_id")), 8, 2)
    _run(spec.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{f}/out/b={i}")), f)
    return _spectrum(s.read.parquet(f"{f}/out/b=*"))


def _arriving(s, d):
    f = _folder(s)
    p = table(s, d, "part")
    head = F.element_at(F.array(F.lit("%PDF-1.4"), F.lit("a,b\n1,2"), F.lit("plain words")), (F.col("p_size") % 3 + 1).cast("int"))
    p.groupBy("p_size", head.alias("value")).agg(F.count("*").alias("n")).select("p_size", "value").write.partitionBy("p_size").text(f"{f}/in")
    _run(stream.classify_batches(stream.stream_corpus(s, f"{f}/in/*/*.txt"), f"{f}/out"), f)
    return s.read.parquet(f"{f}/out/batch=*").select(F.regexp_extract("path", r"p_size=(\d+)", 1).alias("p_size"), "size", "ext", "kind")


QUERIES = {"x1_stream_ext_stats": _ext, "x2_stream_visits": _visits, "x3_stream_daily": _daily, "x4_stream_throttle": _throttle, "x5_stream_scores": _scores, "x6_stream_corpus": _arriving, "x7_stream_spectrogram": _live_spectrum, "g4_spectrogram": _batch_spectrum}

#: The transform written out: Hann window of 8 samples, every 2, magnitudes over the window's sum, doubled.
_DFT = """with s as (select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value / 1000.0 as v from events), n as (select clip_id, count(*) as n from s group by 1),
      f as (select clip_id, unnest(range(0, (n - 8) // 2 + 1)) as frame from n where n >= 8), b as (select unnest(range(4)) as bin),
      x as (select f.clip_id, frame, idx - 2 * frame as i, v * (0.5 - 0.5 * cos(2 * pi() * (idx - 2 * frame) / 7)) as v from f join s on s.clip_id = f.clip_id and idx >= 2 * frame and idx < 2 * frame + 8),
      m as (select clip_id, frame, bin, sqrt(power(sum(v * cos(2 * pi() * i * bin / 8)), 2) + power(sum(v * sin(2 * pi() * i * bin / 8)), 2)) / 3.5 * 2 as m from x cross join b group by all)
      select clip_id, frame, cast(bin as int) as bin, round(20 * log10(m + 1e-12), 4) as db from m"""
ORACLE = {
    "x1_stream_ext_stats": "select event_type as ext, count(*) as count, max(case when event_type <> 'error' then 1 else 0 end) as supported from events group by 1",
    "x2_stream_visits": """with recursive t as (select distinct user_id as client, epoch_us(ts) as t from events),
      v as (select client, min(t) as t, 1 as n from t group by client union all
        select v.client, (select min(t.t) from t where t.client = v.client and t.t >= v.t + 259200000000) as t, v.n + 1 from v where exists (select 1 from t where t.client = v.client and t.t >= v.t + 259200000000))
      select client, cast(max(n) as bigint) as visits from v group by client""",
    "x3_stream_daily": "select strftime(cast(ts as date), '%Y-%m-%d') as day, count(*) as n from events group by 1",
    "x4_stream_throttle": "select event_id from (select event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as r from events) where r <= 1",
    "x5_stream_scores": """with e as (select user_id as name, cast(floor(value * 100 + 0.5) as bigint) as score, ts from events), b as (select *, row_number() over (partition by name order by score desc, ts) as r from e)
      select name, score, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at from b where r = 1""",
    "x6_stream_corpus": "select cast(p_size as varchar) as p_size, cast(case p_size % 3 when 0 then 9 when 1 then 8 else 12 end as bigint) as size, 'txt' as ext, case p_size % 3 when 0 then 'document' when 1 then 'delimited' else 'text' end as kind from part group by p_size",
    "x7_stream_spectrogram": _DFT, "g4_spectrogram": _DFT,
}
