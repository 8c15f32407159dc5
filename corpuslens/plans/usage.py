"""Queries over the usage operators, on the event table, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import scalars
from corpuslens.operators import usage
from corpuslens.session import table


def _events(s, d):
    return table(s, d, "events")


def _ext(s, d):
    return _events(s, d).select(F.col("event_type").alias("ext"), (F.col("event_type") != "error").alias("supported"))


def _scores(s, d):
    return _events(s, d).select(F.col("user_id").alias("name"), F.floor(F.col("value") * 100 + 0.5).alias("score"), "ts", "event_id")


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _daily(s, d):
    return usage.daily_counts(_events(s, d))


QUERIES = {
    "k1_ranked_keys": lambda s, d: usage.ranked_keys(usage.ext_stats(_ext(s, d)), 3),
    "w10_trend": lambda s, d: _day(usage.trend(_daily(s, d), F.lit(1_000_000), "cumulative")),
    "w11_last_days": lambda s, d: _day(usage.last_days(_daily(s, d), 7)),
    "w12_leaderboard": lambda s, d: usage.leaderboard(_scores(s, d), 50, ("name",)).select("name", "score", "event_id", "rank"),
    "w13_recent_history": lambda s, d: usage.recent_history(_events(s, d).select(F.col("event_type").alias("name"), F.col("user_id").alias("size"), F.col("ts").alias("when")), F.lit("2024-01-31").cast("timestamp")).withColumn("when", F.date_format("when", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
    "w14_count_visits": lambda s, d: usage.count_visits(_events(s, d).withColumnRenamed("user_id", "client")),
    "w15_throttle": lambda s, d: usage.throttle(_events(s, d).withColumnRenamed("user_id", "client"), 1, "1 hour", order=("event_id",)).select("event_id"),
    "j4_merge_daily": lambda s, d: _day(usage.merge_daily(_daily(s, d).where("day < '2024-01-20'"), usage.daily_counts(_events(s, d).where("event_type <> 'view'")).where("day > '2024-01-10'"))),
    "j5_disperse_supported": lambda s, d: usage.disperse_supported(usage.ext_stats(_ext(s, d)), _events(s, d).where("value > 0").select(F.lit("error").alias("ext"))),
    "a5_top_counts": lambda s, d: usage.top_counts(table(s, d, "lineitem"), "l_suppkey", 5, ["l_returnflag"]),
    "k5_top_k": lambda s, d: usage.top_k(table(s, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority"),
    "k4_page": lambda s, d: usage.page(table(s, d, "orders"), ["o_custkey", "o_orderkey"], (20, 0), 100).select("o_custkey", "o_orderkey"),
    "p10_clean_ext": lambda s, d: _events(s, d).select(scalars.clean_ext(F.concat_ws("-", "event_type", F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "A long Tail"))).alias("ext")).groupBy("ext").agg(F.count("*").alias("n")),
    "p12_hash_client": lambda s, d: _events(s, d).groupBy(scalars.hash_client(F.col("user_id").cast("string"), "pepper").alias("client")).agg(F.count("*").alias("n")),
    "p16_snap_rate": lambda s, d: _events(s, d).select("event_id", scalars.snap_rate(F.col("value") % 130).alias("rate")),
    "f2_durations": lambda s, d: _events(s, d).select("event_id", scalars.human_duration(F.floor("value") * 37).alias("duration"), scalars.human_step((F.floor("value") * 30_000).cast("long")).alias("step")),
    "f15_notes": lambda s, d: _events(s, d).where("value > 0").select("event_id", scalars.note_of(F.floor("value") + 20).alias("x")).select("event_id", "x.note", "x.cents"),
    "f1_human_bytes": lambda s, d: table(s, d, "documents").select("doc_id", scalars.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size")),
}

_DAILY = "(select cast(ts as date) as day, count(*) as n from events group by 1)"
_RATES = ", ".join(map(str, scalars.FRAME_RATES))
ORACLE = {
    "k1_ranked_keys": """with s as (select event_type as ext, count(*) as c, max(case when event_type <> 'error' then 1 else 0 end) as sup from events group by 1),
      p as (select case when sup = 1 then ext else '(unsupported)' end as ext, cast(sum(c) as bigint) as count from s group by 1)
      select ext, count, round(100.0 * count / (select sum(c) from s), 6) as share_percent, case when 100.0 * count / (select sum(c) from s) < 0.1 then '<0.1%' else printf('%.1f%%', 100.0 * count / (select sum(c) from s)) end as share_text from p order by count desc, ext limit 3""",
    "w10_trend": f"select strftime(day, '%Y-%m-%d') as day, cast(sum(n) over (order by day) + greatest(1000000 - sum(n) over (), 0) as bigint) as value from {_DAILY}",
    "w11_last_days": f"select strftime(day, '%Y-%m-%d') as day, n from {_DAILY} order by day desc limit 7",
    "w12_leaderboard": """with e as (select user_id as name, cast(floor(value * 100 + 0.5) as bigint) as score, ts, event_id from events),
      b as (select *, row_number() over (partition by name order by score desc, ts) as r from e)
      select name, score, event_id, row_number() over (order by score desc, ts, name) as rank from b where r = 1 order by score desc, ts, name limit 50""",
    "w13_recent_history": """with b as (select event_type as name, user_id as size, ts as w, row_number() over (partition by event_type, user_id order by ts desc) as r from events where ts > timestamp '2024-01-31' - interval 7 days)
      select name, size, strftime(w, '%Y-%m-%d %H:%M:%S.%f') as "when" from b where r = 1 order by w desc, name, size limit 20""",
    "w14_count_visits": """with recursive t as (select distinct user_id as client, epoch_us(ts) as t from events),
      v as (select client, min(t) as t, 1 as n from t group by client union all
        select v.client, (select min(t.t) from t where t.client = v.client and t.t >= v.t + 259200000000) as t, v.n + 1 from v where exists (select 1 from t where t.client = v.client and t.t >= v.t + 259200000000))
      select client, cast(max(n) as bigint) as visits from v group by client""",
    "w15_throttle": "select event_id from (select event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as r from events) where r <= 1",
    "j4_merge_daily": f"""with o as (select * from {_DAILY} where day < date '2024-01-20'), n as (select cast(ts as date) as day, count(*) as n from events where event_type <> 'view' and cast(ts as date) > date '2024-01-10' group by 1)
      select strftime(coalesce(n.day, o.day), '%Y-%m-%d') as day, coalesce(n.n, o.n) as n from o full join n on o.day = n.day""",
    "j5_disperse_supported": "select event_type as ext, count(*) as count, 1 as supported from events group by 1",
    "a5_top_counts": """select l_returnflag, l_suppkey as value, n, rank from (select l_returnflag, l_suppkey, count(*) as n, row_number() over (partition by l_returnflag order by count(*) desc, l_suppkey) as rank from lineitem group by 1, 2) where rank <= 5""",
    "k5_top_k": "select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3",
    "k4_page": "select o_custkey, o_orderkey from orders where o_custkey > 20 or (o_custkey = 20 and o_orderkey > 0) order by o_custkey, o_orderkey limit 100",
    "p10_clean_ext": """with k as (select regexp_replace(lower(concat_ws('-', event_type, user_id, case when event_id % 3 = 0 then 'A long Tail' end)), '[^a-z0-9]', '', 'g') as k from events)
      select case when k = '' then '(none)' when length(k) > 16 then '(other)' else k end as ext, count(*) as n from k group by 1""",
    "p12_hash_client": "select sha256('pepper:' || user_id) as client, count(*) as n from events group by 1",
    "p16_snap_rate": f"""with e as (select event_id, value % 130 as x from events), d as (select event_id, x, list_transform([{_RATES}], lambda s: {{'d': abs(x - s), 's': cast(s as double)}}) as c from e),
      m as (select event_id, x, list_min(list_transform(c, lambda k: k.d)) as best, c from d)
      select event_id, case when best < 0.5 then list_filter(c, lambda k: k.d = best)[1].s else floor(x * 100 + 0.5) / 100 end as rate from m""",
    "f2_durations": """with e as (select event_id, cast(floor(value) as bigint) * 37 as s, cast(floor(value) as bigint) * 30000 as m from events)
      select event_id, case when s <= 0 then '-' when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as duration,
        case when m % 86400000 = 0 then case when m // 86400000 = 1 then '1 day' else (m // 86400000) || ' days' end when m % 3600000 = 0 then case when m // 3600000 = 1 then '1 hour' else (m // 3600000) || ' hours' end
          when m % 60000 = 0 then case when m // 60000 = 1 then '1 minute' else (m // 60000) || ' minutes' end else (m // 1000) || ' seconds' end as step from e""",
    "f15_notes": """with e as (select event_id, 69 + 12 * log2((floor(value) + 20) / 440) as m from events where value > 0)
      select event_id, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[cast(floor(m + 0.5) as int) % 12 + 1] || cast(cast(floor(floor(m + 0.5) / 12) - 1 as int) as varchar) as note, cast(floor(100 * (m - floor(m + 0.5)) + 0.5) as int) as cents from e""",
    "f1_human_bytes": """with e as (select doc_id, n_chars * n_chars as n from documents) select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) when n < 1073741824 then printf('%.2f MB', floor(n / 1048576.0 * 100 + 0.5) / 100) else printf('%.2f GB', n / 1073741824.0) end as size from e""",
}
