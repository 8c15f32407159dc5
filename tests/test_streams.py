"""Streams over several micro-batches against the batch operators; what sinks write, and what state is left."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import usage
from corpuslens.streaming import usage as stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "client long, id long, ts timestamp"


def feed(spark, folder, rows, parts):
    """Rows in time order as files of one micro-batch each, every file shuffled."""
    rng = random.Random(0)
    rows = sorted(rows, key=lambda r: r[2])
    size = -(-len(rows) // parts)
    for i in range(parts):
        some = rows[i * size : (i + 1) * size]
        rng.shuffle(some)
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(writer, folder):
    q = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.fixture(scope="module")
def rows():
    """One client has half of all events; others come rarely; one has no name."""
    rng = random.Random(3)
    hot = [(1, i, START + timedelta(minutes=rng.randrange(20 * 1440))) for i in range(1500)]
    rest = [(rng.choice([2, 3, 4, 5, None]), 10_000 + i, START + timedelta(minutes=rng.randrange(20 * 1440), seconds=rng.randrange(60))) for i in range(1500)]
    return hot + rest


def test_visits_over_micro_batches(spark, tmp_path, rows):
    folder = f"file://{tmp_path}"
    feed(spark, folder, rows, 6)
    q = run(stream.write_visits(source(spark, folder), f"{folder}/out", window=36 * 3600), folder)
    got = {r.client: r.visits for r in stream.KeyedTable(spark, f"{folder}/out").read().collect()}
    want = {r.client: r.visits for r in usage.count_visits(spark.createDataFrame(rows, SCHEMA), window=36 * 3600).collect()}
    assert got == want and len(want) == 6
    batches = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(batches) == 6
    states = [p["stateOperators"][0] for p in q.recentProgress]
    assert max(s["numRowsTotal"] for s in states) <= 4 * 6  # a value and a timer (under two orders) for each client, whatever came


def test_state_of_passed_windows_is_gone(spark, tmp_path):
    folder = f"file://{tmp_path}"
    many = [(c, c, START + timedelta(minutes=c)) for c in range(300)]
    feed(spark, folder, many + [(9999, 9999, START + timedelta(days=9))], 4)
    q = run(stream.write_visits(source(spark, folder), f"{folder}/out", window=3600), folder)
    left = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert left <= 4 and stream.KeyedTable(spark, f"{folder}/out").read().count() == 301


@pytest.mark.parametrize("limit", [1, 3])
def test_throttle_over_micro_batches(spark, tmp_path, rows, limit):
    folder = f"file://{tmp_path}"
    feed(spark, folder, rows, 5)
    t = stream.stream_throttle(source(spark, folder), limit, 7200)
    run(t.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/b={i}")), folder)
    got = sorted(r.id for r in spark.read.parquet(f"{folder}/out/b=*").collect())
    want = usage.throttle(spark.createDataFrame(rows, SCHEMA), limit, "2 hours", order=("id",))
    assert got == sorted(r.id for r in want.collect())


def test_throttle_state_does_not_grow_with_the_clients(spark, tmp_path):
    """Thousands of clients in one period are a few values of the state, which go with the period; the results are the batch twin's."""
    folder = f"file://{tmp_path}"
    many = [(c % 2500 or None, c, START + timedelta(seconds=c % 3000)) for c in range(5000)]
    feed(spark, folder, many + [(9999, 9999, START + timedelta(days=9))], 2)
    t = stream.stream_throttle(source(spark, folder), 1, 3600)
    q = run(t.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/b={i}")), folder)
    got = sorted(r.id for r in spark.read.parquet(f"{folder}/out/b=*").collect())
    assert got == sorted(r.id for r in usage.throttle(spark.createDataFrame(many, SCHEMA), 1, "1 hour", order=("id",)).collect()) + [9999]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(states) <= 4 * 512 and states[-1] <= 4  # a value and a timer (under two orders) for each bucket


def test_throttle_folds_a_bucket_in_parts(monkeypatch):
    """Whatever the chunks a bucket's rows come in, the first of each client and period pass, ties by id and none last."""
    import pandas as pd

    class Held:
        value, timers = None, set()
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)
        getValueState = lambda self, *_: self
        listTimers = lambda self: iter(self.timers)
        deleteTimer = lambda self, t: self.timers.discard(t)
        registerTimer = lambda self, t: self.timers.add(t)
        getCurrentWatermarkInMs = lambda self: 60_000

    monkeypatch.setattr(stream, "THROTTLED_ROWS", 10)
    rng = random.Random(4)
    rows = [(True, rng.choice("abc"), p, 60_000_000 * p + rng.randrange(5), i % 5 == 0, i) for i, p in enumerate(rng.choices((0, 1, 2), k=400))]
    columns = ["known", "name", "period", "t", "no_id", "id"]
    held, got = Held(), []
    one = stream._Throttle(15, 60)
    one.init(held)
    for batch in (rows[:120], rows[120:]):
        for out in one.handleInputRows((0,), (pd.DataFrame(batch[i : i + 7], columns=columns) for i in range(0, len(batch), 7)), held):
            got += [(n, t, None if pd.isna(i) else int(i)) for n, t, i in zip(out["name"], out["t"], out["id"])]
    want = []
    for k in sorted({r[1:3] for r in rows}):
        n = 0
        for batch in (rows[:120], rows[120:]):
            some = sorted((r for r in batch if r[1:3] == k), key=lambda r: r[3:])[: 15 - n]
            n += len(some) if k[1] else 0  # the watermark has passed the first period, whose number isn't kept
            want += [(r[1], r[3], None if r[4] else r[5]) for r in some]
    assert sorted(map(str, got)) == sorted(map(str, want)) and held.timers == {120_000}


def files(spark, path):
    """Names and sizes of the data files of a keyed table, by version and bucket."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs, out = root.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    if not fs.exists(root):
        return out
    every = fs.listFiles(root, True)
    while every.hasNext():
        p = every.next().getPath()
        if p.getName().startswith("part-"):
            out.setdefault((p.getParent().getParent().getName(), p.getParent().getName()), []).append(p.getName())
    return out


def add(spark, sink, batch_id, keys):
    new = spark.createDataFrame([(k, 1) for k in keys], "k string, n long")
    sink.merge(batch_id, new.groupBy("k").agg(F.sum("n").alias("n")), lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))


def test_keyed_table(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    sink = stream.KeyedTable(spark, path, ("k",), 16)
    assert sink.read() is None
    everyone = [f"k{i}" for i in range(200)]
    add(spark, sink, 0, everyone)
    assert len(sink.versions()) == 16
    add(spark, sink, 1, ["k7", "k7", "k8"])
    touched = {b for b, v in sink.versions().items() if v == 1}
    assert len(touched) <= 2
    assert {k for k in files(spark, path) if k[0] == "v=1"} == {("v=1", f"bucket={b}") for b in touched}
    read = lambda: {r.k: r.n for r in sink.read().collect()}
    want = dict.fromkeys(everyone, 1) | {"k7": 3, "k8": 2}
    assert read() == want
    add(spark, sink, 1, ["k7", "k7", "k8"])  # done before
    assert read() == want and sink.commits() == [0, 1]
    before = sink.read()
    add(spark, sink, 2, ["k7", None])
    assert {r.k: r.n for r in before.collect()} == want  # the version before is still there
    add(spark, sink, 3, everyone)
    add(spark, sink, 4, everyone)
    assert sink.commits() == [3, 4] and {v for v, _ in files(spark, path)} <= {"v=2", "v=3", "v=4"}
    named = {(f"v={v}", f"bucket={b}") for c in sink.commits() for b, v in sink.versions(c).items()}
    assert set(files(spark, path)) == named
    assert read() == {k: n + 2 + (k == "k7") for k, n in want.items()} | {None: 1}


def test_attempt_without_a_commit_is_overwritten(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    sink = stream.KeyedTable(spark, path, ("k",), 4)
    add(spark, sink, 0, ["a", "b"])
    with monkeypatch.context() as m:
        m.setattr(sink, "_commit", lambda *_: None)
        add(spark, sink, 1, ["a", "c"])
    assert {r.k: r.n for r in sink.read().collect()} == {"a": 1, "b": 1}
    add(spark, sink, 1, ["a"])
    assert {r.k: r.n for r in sink.read().collect()} == {"a": 2, "b": 1}
