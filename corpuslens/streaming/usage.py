"""Streaming forms of the usage operators: event time, watermarks, keyed state, and small keyed tables as sinks.

Each equals its batch twin when micro-batches arrive in time order (rows below the watermark are dropped); within a
micro-batch rows may stand in any order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpuslens.operators.classify import resolve_content
from corpuslens.operators.inventory import extension
from corpuslens.operators.usage import VISIT_WINDOW
from corpuslens.session import ensure_on_workers

#: Rows of a bucket that are gathered before all but each client's first ones go (about).
THROTTLED_ROWS = 100_000
STORE, STORE_CLASS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedTable:
    """A table by key under a folder, of which a micro-batch rewrites only the buckets that its keys fall into.

    data/v=<batch>/bucket=<n> holds the rows of a bucket as a batch left them, commits/<batch> which version of each bucket
    is the table's. A batch is done once its commit is there: doing it again changes nothing, and what an attempt without a
    commit has written is overwritten by the next. A version that neither the last commit nor the one before it (which may
    still be read) names is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        if not self._fs.exists(self._at("commits")):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._at("commits")) if f.getPath().getName().isdigit())

    def versions(self, commit: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows, as of a commit (the last)."""
        done = self.commits()
        if not done:
            return {}
        stream = self._fs.open(self._at("commits", str(done[-1] if commit is None else commit)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _read(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        return self._read(self.versions())

    def merge(self, batch_id: int, new: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> None:
        """fold(old and new rows of the touched buckets) gives their rows. new must have the table's columns."""
        done = self.commits()
        if done and done[-1] >= batch_id:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = new.persist()
        try:
            touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # as many numbers as buckets at most
            now = self.versions()
            old = self._read({b: now[b] for b in touched if b in now})
            rows = fold(new if old is None else old.unionByName(new)).withColumn("bucket", bucket)
            rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("data", f"v={batch_id}").toString())
        finally:
            new.unpersist()
        self._commit(batch_id, now | dict.fromkeys(touched, batch_id))

    def _commit(self, batch_id: int, versions: dict[int, int]) -> None:
        fs, before = self._fs, self.commits()
        draft = self._at("commits", f"_{batch_id}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        if not fs.rename(draft, self._at("commits", str(batch_id))):
            raise OSError(f"batch {batch_id} couldn't be committed in {self.path}")
        kept = set(versions.items()) | (set(self.versions(before[-1]).items()) if before else set())
        for old in before[:-1]:
            for b, v in set(self.versions(old).items()) - kept:
                fs.delete(self._at("data", f"v={v}", f"bucket={b}"), True)
            fs.delete(self._at("commits", str(old)), False)


def stream_ext_stats(events: DataFrame, path: str):
    """Writer of running counters (ext, count, supported) of events(ext, supported); start() it with a checkpoint."""
    sink = KeyedTable(events.sparkSession, path, ("ext",))
    fold = lambda df: df.groupBy("ext").agg(F.sum("count").alias("count"), F.max("supported").alias("supported"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        sink.merge(batch_id, batch.groupBy("ext").agg(F.count("*").alias("count"), F.max(F.col("supported").cast("int")).alias("supported")), fold)

    return events.writeStream.foreachBatch(upsert)


def stream_scores(scores: DataFrame, path: str, identity: tuple[str, ...] = ("name",)):
    """Writer of each identity's best score, the earliest of equals."""
    sink = KeyedTable(scores.sparkSession, path, identity)
    first = F.max_by(F.struct("score", "ts"), F.struct(F.col("score"), -F.unix_micros("ts")))
    best = lambda df: df.groupBy(*identity).agg(first.alias("b")).select(*identity, "b.score", "b.ts")
    return scores.writeStream.foreachBatch(lambda batch, batch_id: sink.merge(batch_id, best(batch.select(*identity, "score", "ts")), best))


def stream_daily(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, n): tumbling UTC days, given out once the watermark has passed them (append mode)."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n"))
    return w.select(F.to_date("window.start").alias("day"), "n")


def write_daily(events: DataFrame, path: str, ts: str = "ts", late: str = "1 day"):
    """Writer of a keyed table (day, n) of all days, the open one included: each micro-batch puts a day's new count in place of its old one."""
    sink = KeyedTable(events.sparkSession, path, ("day",))
    latest = lambda df: df.groupBy("day").agg(F.max("n").alias("n"))  # noqa: E731  a day's count only grows
    return stream_daily(events, ts, late).writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: sink.merge(batch_id, batch, latest))


def _stateful(df: DataFrame) -> None:
    """Timed keyed state needs a store that can hold it; a session that names none gets it."""
    ensure_on_workers(df.sparkSession)
    conf = df.sparkSession.conf
    if "HDFSBacked" in conf.get(STORE):
        conf.set(STORE, STORE_CLASS)


def _named(client: str) -> list:
    """A client as two keys that are never null: whether it has a name, and the name as text."""
    c = F.col(client)
    return [c.isNotNull().alias("known"), F.coalesce(c.cast("string"), F.lit("")).alias("name")]


def _client(kind: str):
    return F.when(F.col("known"), F.col("name").cast(kind)).alias("client")


class _Visits(StatefulProcessor):
    """Counted visits of a client. State: the last one, until the watermark is a window past it."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        w = self.window
        before = self.last.get()[0] if self.last.exists() else None
        kept = np.zeros(0, np.int64)
        for pdf in rows:  # what can't count any more goes at once
            kept = np.union1d(kept, pdf["t"].to_numpy(np.int64))
            if before is not None:
                kept = kept[np.searchsorted(kept, before + w) :]
                if len(kept):  # within one window after that, only the first can count
                    kept = np.r_[kept[:1], kept[max(1, np.searchsorted(kept, before + 2 * w)) :]]
        counted, last = [], before
        at = 0
        while at < len(kept):
            last = int(kept[at])
            counted.append(last)
            at = int(np.searchsorted(kept, last + w))
        if counted:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((last,))
            self.handle.registerTimer(max((last + w) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame({"known": [key[0]] * len(counted), "name": [key[1]] * len(counted), "t": counted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_visits(visits: DataFrame, client: str = "client", ts: str = "ts", late: str = "1 hour", window: int = VISIT_WINDOW) -> DataFrame:
    """(client, at): the visits that count, each once (append mode); their number is the client's (write_visits()).

    State is a client's last counted visit. An event-time timer drops it when its window has passed, after which any visit
    counts. A client's rows of a micro-batch are folded chunk by chunk: of those within a window after the last counted one
    none is kept, of those within the next only the first, of others their different times, 8 bytes each.
    """
    _stateful(visits)
    v = visits.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(*_named(client), F.unix_micros(ts).alias("t"), ts)
    counted = v.groupBy("known", "name").transformWithStateInPandas(_Visits(window * 1_000_000), "known boolean, name string, t long", "Append", "eventTime")
    return counted.select(_client(dict(visits.dtypes)[client]), F.timestamp_micros("t").alias("at"))


def write_visits(visits: DataFrame, path: str, **options):
    """Writer of a keyed table (client, visits): the running number of counted visits of each client."""
    sink = KeyedTable(visits.sparkSession, path, ("client",))
    fold = lambda df: df.groupBy("client").agg(F.sum("visits").alias("visits"))
    counted = stream_visits(visits, **options)
    return counted.writeStream.outputMode("append").foreachBatch(lambda batch, batch_id: sink.merge(batch_id, batch.groupBy("client").agg(F.count("*").alias("visits")), fold))


class _Throttle(StatefulProcessor):
    """Which events of a bucket of clients' periods are let through. State: how many were, for each client and period, packed as one value until the watermark has passed the periods."""

    KEY = ("known", "name", "period")

    def __init__(self, limit: int, period_s: int):
        self.limit, self.period_s = limit, period_s

    def init(self, handle) -> None:
        self.handle, self.passed = handle, handle.getValueState("passed", "rows binary")

    def _read(self):
        import pandas as pd
        import pyarrow as pa

        if self.passed.exists():
            return pa.ipc.open_stream(self.passed.get()[0]).read_pandas()
        return pd.DataFrame({"known": pd.Series([], dtype=bool), "name": pd.Series([], dtype=object), "period": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def _keep(self, held, watermark: int) -> None:
        """Write what the watermark hasn't passed; the next timer is its earliest end."""
        import pyarrow as pa

        ends = (held["period"] + 1) * self.period_s * 1000
        held, ends = held[ends > watermark], ends[ends > watermark]
        if not len(held):
            self.passed.clear()
            return
        rows, out = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema) as w:
            w.write_table(rows)
        self.passed.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(ends.min()))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        by = list(self.KEY)
        place = lambda df: df.groupby(by, sort=False).cumcount().to_numpy()

        def first(parts):
            x = pd.concat(parts, ignore_index=True).sort_values(["t", "no_id", "id"])
            return x[place(x) < self.limit]

        parts, size, least = [], 0, 0
        for pdf in rows:  # of each client and period never more than the limit are held for long
            parts.append(pdf[[*by, "t", "no_id", "id"]])
            size += len(pdf)
            if size >= max(THROTTLED_ROWS, 2 * least):
                parts = [first(parts)]
                size = least = len(parts[0])
        new, held = first(parts), self._read()
        before = new[by].merge(held, "left", by)["n"].fillna(0).to_numpy()
        new = new[place(new) + before < self.limit]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(pd.concat([held, new[by].assign(n=1)]).groupby(by, sort=False, as_index=False)["n"].sum(), timerValues.getCurrentWatermarkInMs())
        if len(new):
            yield pd.DataFrame({"known": new["known"], "name": new["name"], "id": new["id"].astype("Int64").mask(new["no_id"]), "t": new["t"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self._keep(self._read(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, limit: int = 15, period_s: int = 60, client: str = "client", ts: str = "ts", late: str = "10 minutes", buckets: int = 512) -> DataFrame:
    """(client, id, t): events that a client may have recorded, `limit` per fixed period, the earliest first (ties by id, none last; append mode).

    State is a number for each client and period; an event-time timer drops it when the period has passed. Clients' periods
    are dealt over a number of buckets by hash, whose rows are folded together and whose numbers are one value of the
    state, so the cost follows rows and not groups. A stream with many millions of live periods should take more buckets;
    they are fixed by a stream's checkpoint.
    """
    _stateful(events)
    p = period_s * 1_000_000
    t = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).withColumn("t", F.unix_micros(ts))
    e = t.select(*_named(client), ((F.col("t") - F.pmod("t", F.lit(p))) / p).cast("long").alias("period"), "t", F.col("id").isNull().alias("no_id"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), ts)
    dealt = e.withColumn("bucket", F.pmod(F.xxhash64(*_Throttle.KEY), F.lit(buckets)).cast("int"))
    passed = dealt.groupBy("bucket").transformWithStateInPandas(_Throttle(limit, period_s), "known boolean, name string, id long, t long", "Append", "eventTime")
    return passed.select(_client(dict(events.dtypes)[client]), "id", "t")


def stream_corpus(spark: SparkSession, folder: str, head: int = 264) -> DataFrame:
    """(path, size, ext, kind) of files as they land in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return f.select("path", F.col("length").alias("size"), extension(F.col("path")).alias("ext"), F.substring("content", 1, head).alias("head"))


def classify_batches(files: DataFrame, path: str):
    """Writer that adds kind by content to the files of each micro-batch and appends them under a path."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kinds = resolve_content(batch.select("path", "head"))
        batch.join(kinds, "path").drop("head").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return files.writeStream.foreachBatch(run)


def stream_spectrogram(samples: DataFrame, fft: int = 1024, hop: int | None = None) -> DataFrame:
    """(clip_id, frame, db) of arriving samples(clip_id, idx, v): the overlap of the last frame is the only state."""
    hop = hop or fft // 4
    kind = dict(samples.dtypes)["clip_id"]

    def run(key, batches: Iterator, state):
        import numpy as np
        import pandas as pd

        from corpuslens.operators.signal import _window

        start, kept = state.get if state.exists else (0, [])
        pdf = pd.concat(list(batches)).sort_values("idx")
        x = np.concatenate([np.array(kept, float), pdf["v"].to_numpy(float)])
        w, out = _window("hann", fft), []
        a = 0
        while a + fft <= len(x):
            m = np.abs(np.fft.rfft(x[a : a + fft] * w))[: fft // 2] / w.sum() * 2
            out.append(((start + a) // hop, (20 * np.log10(m + 1e-12)).tolist()))
            a += hop
        state.update((start + a, x[a:].tolist()))
        yield pd.DataFrame({"clip_id": [key[0]] * len(out), "frame": [f for f, _ in out], "db": [d for _, d in out]})

    return samples.groupBy("clip_id").applyInPandasWithState(run, f"clip_id {kind}, frame long, db array<double>", "start long, kept array<double>", "append", "NoTimeout")
