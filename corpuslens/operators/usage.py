"""Usage statistics: counters, daily series, boards, visits, throttling, merges of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.folds import fold_in_order

VISIT_WINDOW = 3 * 86400  # seconds after a counted visit within which others don't count


def ext_stats(events: DataFrame, ext: str = "ext", supported: str = "supported") -> DataFrame:
    """(ext, count, supported): counters per key; the flag is 1 once any event had it."""
    return events.groupBy(F.col(ext).alias("ext")).agg(F.count("*").alias("count"), F.max(F.col(supported).cast("int")).alias("supported"))


def ranked_keys(stats: DataFrame, n: int = 500) -> DataFrame:
    """(ext, count, share_percent, share_text): the n keys with the highest counts, all unsupported keys pooled in one row.

    Ties by key ascending. Shares are of the whole total, not of the n shown; below 0.1 % the text says so.
    """
    pooled = stats.groupBy(F.when(F.col("supported") == 1, F.col("ext")).otherwise("(unsupported)").alias("ext")).agg(F.sum("count").alias("count"))
    total = stats.agg(F.sum("count").alias("total"))  # one row
    share = F.round(100.0 * F.col("count") / F.col("total"), 6)
    text = F.when(share < 0.1, "<0.1%").otherwise(F.format_string("%.1f%%", share))
    top = pooled.orderBy(F.desc("count"), "ext").limit(n)
    return top.crossJoin(F.broadcast(total)).select("ext", "count", share.alias("share_percent"), text.alias("share_text"))


def daily_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, n) by UTC day."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def trend(daily: DataFrame, total: Column | None = None, mode: str = "daily", value: str = "n") -> DataFrame:
    """(day, value) per day or cumulative. Cumulative starts from total less all known days, not below 0.

    The window without partitions runs over one row per day.
    """
    if mode == "daily":
        return daily.select("day", F.col(value).alias("value"))
    everything = W.partitionBy()
    base = F.greatest((F.lit(0) if total is None else total) - F.sum(value).over(everything), F.lit(0))
    run = F.sum(value).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return daily.select("day", (run + (base if total is not None else F.lit(0))).alias("value"))


def last_days(daily: DataFrame, n: int = 400) -> DataFrame:
    """The last n days, oldest first."""
    return daily.orderBy(F.desc("day")).limit(n).orderBy("day")


def leaderboard(scores: DataFrame, n: int = 100, identity: tuple[str, ...] = ("iphash", "name")) -> DataFrame:
    """Best score of each identity (the earliest of equals), highest first, then earliest; n rows with their rank."""
    best = W.partitionBy(*identity).orderBy(F.desc("score"), "ts")
    top = scores.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").orderBy(F.desc("score"), "ts", *identity).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ts", *identity)))


def recent_history(history: DataFrame, now: Column, days: int = 7, n: int = 20) -> DataFrame:
    """Newest n entries, the latest of each (name, size), none older than `days`."""
    latest = W.partitionBy("name", "size").orderBy(F.desc("when"))
    fresh = history.where(F.col("when") > now - F.expr(f"INTERVAL {days} DAYS"))
    return fresh.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r").orderBy(F.desc("when"), "name", "size").limit(n)


def count_visits(visits: DataFrame, client: str = "client", ts: str = "ts", window: int = VISIT_WINDOW) -> DataFrame:
    """(client, visits): a visit counts if none counted before or the last counted one is `window` seconds old or more.

    It depends on the last *counted* visit, so a gap test is not enough: a fold over each client's times in order, which
    goes from one counted visit to the next.
    """
    w = window * 1_000_000
    times = visits.where(F.col(ts).isNotNull()).select(F.col(client).alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))

    def step(state, t):
        last, n = state
        i = 0 if n == 0 else int(t.searchsorted(last + w))
        while i < len(t):
            last, n = int(t[i]), n + 1
            i = int(t.searchsorted(last + w))
        return last, n

    return fold_in_order(times, "client", "t", "t", (0, 0), step, f"client {dict(times.dtypes)['client']}, last long, visits long").drop("last")


def throttle(events: DataFrame, limit: int = 15, period: str = "1 minute", client: str = "client", ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """events of which each client has at most `limit` per fixed period: the earliest ones."""
    w = W.partitionBy(client, F.window(ts, period)).orderBy(ts, *order)
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def merge_daily(old: DataFrame, new: DataFrame, on: str = "day") -> DataFrame:
    """Two daily series as one; where both have a day, the new values win. Sorted by day."""
    values = [c for c in old.columns if c != on]
    both = old.alias("o").join(new.alias("n"), on, "full_outer")
    return both.select(on, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values)).orderBy(on)


def disperse_supported(stats: DataFrame, recognised: DataFrame) -> DataFrame:
    """stats with supported raised to 1 where the key is recognised; doing it again changes nothing."""
    keys = recognised.select("ext").distinct().withColumn("_hit", F.lit(1))
    return stats.join(keys, "ext", "left").withColumn("supported", F.greatest(F.coalesce("supported", F.lit(0)), F.coalesce("_hit", F.lit(0)))).drop("_hit")


def top_counts(df: DataFrame, key: str, n: int, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n, rank): the n most frequent values, of each group if any; ties by value ascending, nulls left out."""
    by = by or []
    counts = df.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("value")).agg(F.count("*").alias("n"))
    if not by:
        top = counts.orderBy(F.desc("n"), "value").limit(n)
        return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "value")))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)


def page(df: DataFrame, order: list[str], after: tuple | None = None, n: int = 100) -> DataFrame:
    """The next n rows after a key in this order (keyset pagination: no rows are counted off)."""
    if after is not None:
        later = F.lit(False)
        for i, c in enumerate(order):
            same = F.lit(True)
            for k in range(i):
                same = same & (F.col(order[k]) == after[k])
            later = later | (same & (F.col(c) > after[i]))
        df = df.where(later)
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, order: list[Column], k: int, by: list[str] | None = None) -> DataFrame:
    """The first k rows in an order, of the table or of each group."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
