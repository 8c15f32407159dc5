import datetime as dt

from pyspark.sql import functions as F

from corpuslens.operators import usage
from corpuslens.plans import streams

DAY = dt.datetime(2024, 1, 1)


def test_visits_depend_on_the_last_counted_one(spark):
    days = {"a": (0, 2, 4), "b": (0, 3), "c": (0, 2.9), "d": (0, 1, 2, 3, 6)}
    rows = [(c, DAY + dt.timedelta(days=d)) for c, x in days.items() for d in x]
    got = {r.client: r.visits for r in usage.count_visits(spark.createDataFrame(rows, "client string, ts timestamp")).collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "d": 3}


def test_boards_and_ranks(spark):
    s = spark.createDataFrame([("x", 5, 1), ("x", 5, 0), ("y", 7, 3), ("z", 5, 0)], "name string, score int, ts int")
    assert [(r.name, r.ts, r.rank) for r in usage.leaderboard(s, 3, ("name",)).orderBy("rank").collect()] == [("y", 3, 1), ("x", 0, 2), ("z", 0, 3)]
    e = spark.createDataFrame([("jpg", 1, 5000), ("abc", 0, 2), ("def", 0, 1), ("png", 1, 5)], "ext string, supported int, count long")
    assert [(r.ext, r["count"], r.share_text) for r in usage.ranked_keys(e).orderBy(F.desc("count")).collect()] == [("jpg", 5000, "99.8%"), ("png", 5, "<0.1%"), ("(unsupported)", 3, "<0.1%")]


def test_merges_are_idempotent(spark):
    old, new = (spark.createDataFrame(x, "day string, n long") for x in ([("a", 1), ("b", 2)], [("b", 5), ("c", 6)]))
    m = usage.merge_daily(old, new)
    want = [("a", 1), ("b", 5), ("c", 6)]
    assert [tuple(r) for r in m.collect()] == want == [tuple(r) for r in usage.merge_daily(m, new).collect()]
    st = spark.createDataFrame([("a", 0), ("b", 0)], "ext string, supported int")
    seen = spark.createDataFrame([("a",), ("a",)], "ext string")
    once = usage.disperse_supported(st, seen)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 0)] == sorted(map(tuple, usage.disperse_supported(once, seen).collect()))


def test_trend_never_starts_below_nothing(spark):
    d = spark.createDataFrame([("1", 3), ("2", 4)], "day string, n long")
    assert [r.value for r in usage.trend(d, F.lit(10), "cumulative").orderBy("day").collect()] == [6, 10]
    assert [r.value for r in usage.trend(d, F.lit(1), "cumulative").orderBy("day").collect()] == [3, 7]


def test_stream_equals_batch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    got = {r.ext: (r["count"], r.supported) for r in streams.QUERIES["x1_stream_ext_stats"](spark, sf).collect()}
    assert got == {r.ext: (r["count"], r.supported) for r in usage.ext_stats(e.select(F.col("event_type").alias("ext"), (F.col("event_type") != "error").alias("supported"))).collect()}
    got = {r.client: r.visits for r in streams.QUERIES["x2_stream_visits"](spark, sf).collect()}
    assert got == {r.client: r.visits for r in usage.count_visits(e.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "client")).collect()}


def test_folds_carry_their_state_across_batches(spark):
    from corpuslens.operators.folds import fold_in_order

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [(k, i, (i * 7 + (k or 0)) % 11) for k in (None, 1, 2, 3) for i in range(30 + 5 * (k or 0))] + [(4, 0, None)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(6)
    got = {r.k: (r.n, r.s) for r in fold_in_order(df, "k", "o", "v", (0, 0), lambda s, v: (s[0] + len(v), int(s[1] * 31 ** len(v) % 1009 + sum(int(x) for x in v)) % 1009), "k long, n long, s long").collect()}
    assert {k: n for k, (n, _) in got.items()} == {None: 30, 1: 35, 2: 40, 3: 45}
    order = {r.k: r.s for r in fold_in_order(df, "k", "o", "v", (-1, 0), lambda s, v: (int(v[-1]), s[1] + sum(1 for a, b in zip([s[0], *v], v) if b > a)), "k long, last long, s long").collect()}
    for k in (None, 1, 2, 3):
        v = [x for a, _, x in rows if a == k]
        assert order[k] == sum(1 for a, b in zip([-1, *v], v) if b > a)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_daily_table_keeps_the_open_day(spark, sf):
    from corpuslens.plans import streams

    days = streams.QUERIES["x3_stream_daily"](spark, sf).collect()
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert {r.day: r.n for r in days} == {str(r.d): r["count"] for r in e.selectExpr("cast(ts as date) d").groupBy("d").count().collect()}
