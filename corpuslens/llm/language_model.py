"""Bigram language model in a log-frequency Bloom filter, and the scoring of texts with it.

Counts are quantised to levels q = 1 + floor(log_BASE(count)) and an n-gram is inserted once for each level up to its
own; a count comes back by probing level after level until one is missing (Talbot and Osborne 2007). The filter is built
in segments by the tasks that count, and its size follows the number of different n-grams. It is broadcast where it
stays under a stated size, as is the table of exact word counts; beyond that size the n-grams to look up are sent to
their bucket and probed in its segment there. Both give the same scores.
"""

from __future__ import annotations

import gc
import math
import time
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.shingle_join import WordHashes, mix
from corpuslens.session import discard, materialize

BASE, BITS, HASHES = 1.5, 12, 8
#: Weight of the word distribution in P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU).
MU = 200.0
MODULUS, HELD_OUT = 7, 2
MAX_BROADCAST = 256 << 20
#: Bytes of text that are scored or counted at once (about).
MOST_BYTES = 4 << 20
#: Tokens that a map task counts before it hands them on; characters of text for each bucket of n-grams (about).
CHUNK_TOKENS, BUCKET_CHARS = 1_500_000, 4_000_000
#: Beyond the broadcast size: tokens that are scored at once (about), and buckets that are probed together.
SCORED_TOKENS, GROUP = 750_000, 8
#: Parquet's writer looks at its memory after each row, not after a hundred: rows are megabytes.
_LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text; no word's hash is looked up in its place


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % MODULUS == HELD_OUT


def tokens(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, texts end to end, each closed by END; and where each text starts."""
    parts, n = [], []
    end = np.array([END])
    for t in texts:
        w = t.lower().split() if t else ()
        parts += [hashes.of(w), end]
        n.append(len(w) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.r_[0, np.cumsum(n, dtype=np.int64)[:-1]].astype(np.int64)


def pairs(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context (END before the first of a text) and the hash of the two together."""
    before = np.r_[END, h[:-1]] if len(h) else h
    before[start] = END
    return before, mix(mix(before + _C) + h)


def _level_hash(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    g = mix(h + np.uint64(int(_D) * level % 2**64))
    return g, mix(g) | np.uint64(1)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


@lru_cache(maxsize=None)
def level_counts() -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    low = np.ceil(BASE ** np.arange(121.0) - 1e-9)
    return np.r_[0.0, (low[:-1] + low[1:] - 1) / 2]


def build_segment(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of one bucket's n-grams, every level of each."""
    q = levels(counts) if len(h) else np.zeros(0, np.int64)
    bits = np.zeros(max(64, -(-int(q.sum()) * BITS // 64) * 64), bool)
    for level in range(1, int(q.max()) + 1 if len(q) else 1):
        g, step = _level_hash(h[q >= level], level)
        for i in range(HASHES):
            bits[((g + np.uint64(i) * step) % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """The segments of one kind of n-gram end to end; of all its buckets, or of some that begin at `first`."""

    def __init__(self, segments: list[bytes], first: int = 0, buckets: int | None = None):
        self.first, self.buckets = first, buckets or len(segments)
        self.bits = np.frombuffer(b"".join(segments), np.uint8)
        self.size = np.array([8 * len(s) for s in segments], np.uint64)
        self.at = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.uint64)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Quantised count of each n-gram."""
        return level_counts()[self.levels(h)]

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram, by repeated membership probes."""
        level, alive = np.zeros(len(h), np.int64), np.arange(len(h))
        n = 0
        while len(alive):
            n += 1
            x = h[alive]
            b = bucket_of(x, self.buckets) - self.first
            g, step = _level_hash(x, n)
            m, at = self.size[b], self.at[b]
            for i in range(HASHES):
                bit = g % m + at
                hit = (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, step, m, at = alive[hit], step[hit], m[hit], at[hit]
                g = g[hit] + step
                if not len(alive):
                    break
            level[alive] = n
        return level


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ _D) % np.uint64(n)).astype(np.int64)


def smoothed(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int, mu: float = MU) -> np.ndarray:
    """log10 P(word | context) from counts of the pair, the context and the word."""
    p1 = (word + 1) / (n + v + 1)
    return np.log10(np.minimum((np.minimum(pair, context) + mu * p1) / (context + mu), 1.0))


def _batches(batches, most: int):
    """(doc_ids, texts) of up to `most` rows from batches of (doc_id, text as bytes), and of few megabytes but for a longer text."""
    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b.column(0), b.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or b"")
            if len(ids) >= most or size >= MOST_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def count_ngrams(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, total, types, hashes, counts, segment) over the training texts of docs(doc_id, text as bytes).

    kind 1: words; kind 2: pairs, of which only the segments are given; all of both are in the segments, those seen once too. Map tasks sum within chunks and hand on packed
    arrays, one a bucket; no text or n-gram travels as a row of its own, and a frequent n-gram counts once a chunk.
    """

    def count(batches):
        import pyarrow as pa

        hashes = WordHashes()

        def flush(held):
            for kind in (1, 2):
                h, c = np.unique(np.concatenate([x[kind - 1] for x in held]), return_counts=True)
                b = bucket_of(h, buckets)
                order = np.argsort(b, kind="stable")
                h, c, b = h[order], c[order].astype(np.uint32), b[order]
                cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                ends = np.r_[cut[1:], len(b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind * buckets + int(b[i]) for i in cut], pa.int64()), pa.array([h[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()), pa.array([c[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())],
                    names=["key", "hashes", "counts"],
                )

        held, n = [], 0
        for ids, texts in _batches(batches, 1024):
            h, start = tokens([t for i, t in zip(ids, texts) if not held_out(i)], hashes)
            if len(h):
                held.append((h, pairs(h, start)[1]))
                n += len(h)
            if n >= CHUNK_TOKENS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def merge(batches):
        import pyarrow as pa

        def row(key, parts):
            h = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in parts])
            c = np.concatenate([np.frombuffer(x, np.uint32) for _, x in parts])
            h, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, weights=c, minlength=len(h)).astype(np.int64)
            kind, bucket = divmod(key, buckets)
            total, types = int(c.sum()), len(h)
            return pa.RecordBatch.from_pylist([dict(kind=kind, bucket=bucket, total=total, types=types, hashes=h.tobytes() if kind == 1 else b"", counts=c.tobytes() if kind == 1 else b"", segment=build_segment(h, c))], schema=schema)

        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("total", pa.int64()), ("types", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("segment", pa.binary())])
        key, parts = None, []
        for b in batches:
            for k, h, c in zip(*(b.column(i) for i in range(3))):
                if k.as_py() != key:
                    if parts:
                        yield row(key, parts)
                    key, parts = k.as_py(), []
                parts.append((h.as_py(), c.as_py()))
        if parts:
            yield row(key, parts)

    dealt = docs.mapInArrow(count, "key long, hashes binary, counts binary").repartition(2 * buckets, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(merge, "kind int, bucket int, total long, types long, hashes binary, counts binary, segment binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(ids: list, h: np.ndarray, start: np.ndarray, c: np.ndarray, about: np.ndarray, pair: np.ndarray, end: float, n: int, v: int):
    """Score rows of texts from each token's exact count, its quantised count and that of its pair; end: that of END."""
    import pyarrow as pa

    context = np.r_[0.0, about[:-1]]
    context[start] = end
    p = smoothed(pair, context, about, n, v)
    base = np.log10((c + 1) / (n + v + 1))
    sums = lambda x: np.add.reduceat(x, start)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(np.diff(np.r_[start, len(h)])), pa.array(sums((c > 0).astype(np.int64))), pa.array([n] * len(ids), pa.int64()), pa.array(sums(base)), pa.array(sums(p))],
        names=[x.split()[0] for x in SCORES.split(", ")],
    )


def _by_broadcast(docs: DataFrame, model: DataFrame, buckets: int, n: int, v: int) -> DataFrame:
    """Scores with the filter and the word counts on every worker; both are under the checked size."""
    sc = docs.sparkSession.sparkContext
    empty = build_segment(np.zeros(0, np.uint64), np.zeros(0))
    segments = {kind: [empty] * buckets for kind in (1, 2)}
    for kind, bucket, segment in model.select("kind", "bucket", "segment").toLocalIterator():
        segments[kind][bucket] = bytes(segment)
    filters = sc.broadcast((Filter(segments.pop(1)), Filter(segments.pop(2))))
    words = [(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.int64)) for r in model.where("kind = 1").select("hashes", "counts").toLocalIterator()]
    h = np.concatenate([np.zeros(0, np.uint64), *(w[0] for w in words)])
    order = np.argsort(h)
    table = sc.broadcast((h[order], np.concatenate([np.zeros(0, np.int64), *(w[1] for w in words)])[order]))

    def score(batches):
        hashes, (one, two), (known, times) = WordHashes(), filters.value, table.value
        for ids, texts in _batches(batches, 512):
            h, start = tokens(texts, hashes)
            kinds, at = np.unique(h, return_inverse=True)
            place = np.searchsorted(known, kinds)
            place[place == len(known)] = 0
            c = np.where(known[place] == kinds, times[place], 0)[at] if len(known) else np.zeros(len(h), np.int64)
            about = one.probe(kinds)[at]
            pair, of = np.unique(pairs(h, start)[1], return_inverse=True)
            yield _scores(ids, h, start, c, about, two.probe(pair)[of], one.probe(np.array([END]))[0], n, v)

    scores = materialize(docs.mapInArrow(score, SCORES), "scores")
    for sent in (filters, table):
        sent.destroy()  # else driver and executors hold them as long as anyone holds the result
    return scores


def _let_shuffles_go(spark: SparkSession) -> None:
    """Files of shuffles whose results are written stay until the driver collects what refers to them; have it do so (the last one takes two rounds)."""
    for pause in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of an array, all first ones before all second ones: those that are alike (of sorted hashes, of small numbers) shrink when written."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unpack(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _by_buckets(docs: DataFrame, model: DataFrame, buckets: int, n: int, v: int) -> DataFrame:
    """Scores for models over the broadcast size: the same probes, made where the segments are.

    Chunks of texts are kept as their different words' hashes and each token's place among them. A chunk sends each of its
    different n-grams once to the group of buckets that holds it, packed as one array a group; the group's task probes its
    segments and sends levels (and words' exact counts) back to the chunk. A task holds the segments of one group with one
    array, or one chunk with its answers.
    """
    import pyarrow as pa

    groups = -(-buckets // GROUP)
    kept = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.binary()), ("at", pa.binary()), ("start", pa.binary())])
    asked = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("segment", pa.binary())])
    told = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.binary()), ("at", pa.binary()), ("start", pa.binary()), ("exact", pa.binary()), ("level", pa.binary())])

    def ddl(schema) -> str:
        kinds = {pa.int64(): "long", pa.binary(): "binary"}
        return ", ".join(f"{f.name} {kinds.get(f.type, 'array<long>')}" for f in schema)

    def chunks(batches):
        from pyspark import TaskContext

        hashes, part, row = WordHashes(), TaskContext.get().partitionId(), 0

        def flush(held):
            start = np.concatenate([s + a for s, a in zip((x[2] for x in held), np.cumsum([0, *(len(x[1]) for x in held)]))])
            words, at = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            return pa.RecordBatch.from_pylist([dict(chunk=part << 32 | row, ids=[i for x in held for i in x[0]], words=_pack(words), at=_pack(at.astype(np.uint32)), start=_pack(start))], schema=kept)

        held, size = [], 0
        for ids, texts in _batches(batches, 512):
            h, start = tokens(texts, hashes)
            if len(h):
                held.append((ids, h, start))
                size += len(h)
            if size >= min(CHUNK_TOKENS, SCORED_TOKENS):
                yield flush(held)
                held, size, row = [], 0, row + 1
        if held:
            yield flush(held)

    def dealt(words, at, start):
        """By kind: the different n-grams in the order of their groups, where each group starts, and each token's place."""
        for kind in (1, 2):
            x, of = (words, at) if kind == 1 else np.unique(pairs(words[at], start)[1], return_inverse=True)
            g = bucket_of(x, buckets) // GROUP
            order = np.argsort(g, kind="stable")
            place = np.empty(len(x), np.uint32)
            place[order] = np.arange(len(x), dtype=np.uint32)
            yield kind, x[order], np.searchsorted(g[order], np.arange(groups + 1)), place[of]

    def read(words, at, start):
        return _unpack(words, np.uint64), _unpack(at, np.uint32), _unpack(start, np.int64)

    def ask(batches):
        for batch in batches:
            for chunk, *packed in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                for kind, x, cut, _ in dealt(*read(*(p.as_py() for p in packed))):
                    some = np.flatnonzero(cut[1:] > cut[:-1])
                    k = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(kind * groups + some), pa.array([chunk.as_py()] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([_pack(x[cut[i] : cut[i + 1]]) for i in some], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=asked)

    def answer(batches):
        held, segments, words, part = None, {}, [], None
        empty = build_segment(np.zeros(0, np.uint64), np.zeros(0))
        for batch in batches:
            out = []
            for key, chunk, bucket, x, c, segment in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != held:
                    held, segments, words, part = key, {}, [], None
                kind, group = divmod(key, groups)
                if chunk is None:  # the group's segments come before its questions
                    segments[bucket] = segment
                    words.append((np.frombuffer(x, np.uint64), np.frombuffer(c, np.int64)))
                    continue
                if part is None:
                    first = group * GROUP
                    part = Filter([segments.get(b, empty) for b in range(first, min(first + GROUP, buckets))], first, buckets)
                    known, times = (np.concatenate([np.zeros(0, y), *(w[i] for w in words)]) for i, y in enumerate((np.uint64, np.int64)))
                    order = np.argsort(known)
                    known, times, segments, words = known[order], times[order], {}, []
                x, exact = _unpack(x, np.uint64), None
                if kind == 1:
                    at = np.searchsorted(known, x)
                    at[at == len(known)] = 0
                    exact = _pack(np.where(known[at] == x, times[at], 0) if len(known) else np.zeros(len(x), np.int64))
                out.append(dict(chunk=chunk, key=key, exact=exact, level=part.levels(x).astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=told)

    def score(batches):
        ids = start = one = two = None
        left = 0
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, key, i, words, at, s, exact, level = (batch.column(c)[r].as_py() for c in range(8))
                if i is not None:  # the chunk comes before its answers
                    ids, (words, at, start) = i, read(words, at, s)
                    one, two = dealt(words, at, start)
                    h, place = words[at], two[3]
                    c, a, p = np.zeros(len(one[1]), np.int64), np.zeros(len(one[1]), np.uint8), np.zeros(len(two[1]), np.uint8)
                    left = len(c) + len(p)
                    one, two = one[2:], two[2]
                    continue
                kind, group = divmod(key, groups)
                cut = one[0] if kind == 1 else two
                (a if kind == 1 else p)[cut[group] : cut[group + 1]] = np.frombuffer(level, np.uint8)
                if kind == 1:
                    c[cut[group] : cut[group + 1]] = _unpack(exact, np.int64)
                left -= int(cut[group + 1] - cut[group])
                if not left:
                    a_token = level_counts()[a[one[1]]]
                    yield _scores(ids, h, start, c[one[1]], a_token, level_counts()[p[place]], a_token[start[1] - 1 if len(start) > 1 else -1], n, v)

    held = materialize(docs.mapInArrow(chunks, ddl(kept)), "chunks", **_LARGE_ROWS)
    null = lambda t: F.lit(None).cast(t)
    segments = model.select((F.col("kind").cast("long") * groups + F.floor(F.col("bucket") / GROUP)).alias("key"), null("long").alias("chunk"), F.col("bucket").cast("long").alias("bucket"), "hashes", "counts", "segment")
    asks = segments.unionByName(held.mapInArrow(ask, ddl(asked))).repartition(4 * groups, "key").sortWithinPartitions("key", F.col("chunk").asc_nulls_first())
    answers = materialize(asks.mapInArrow(answer, ddl(told)), "answers", **_LARGE_ROWS)
    discard(model)
    del segments, asks
    _let_shuffles_go(docs.sparkSession)
    questions = held.select("chunk", null("long").alias("key"), "ids", "words", "at", "start", null("binary").alias("exact"), null("binary").alias("level"))
    return questions.unionByName(answers).repartition(buckets, "chunk").sortWithinPartitions("chunk", F.col("key").asc_nulls_first()).mapInArrow(score, SCORES)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model learns from the rows whose crc32(doc_id) mod 7 isn't 2 (a null doc_id trains). A null text is empty: one
    token, the end. base_score is the add-one word model with exact counts; score is P(w | v) smoothed towards words,
    with counts probed from the filter. Words are compared by 64-bit hash. Other columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // BUCKET_CHARS))
    model = materialize(count_ngrams(docs, buckets), "ngram-counts")
    n, v, size = model.agg(F.sum(F.when(F.col("kind") == 1, F.col("total"))), F.sum(F.when(F.col("kind") == 1, F.col("types"))), F.sum(F.length("segment") + F.when(F.col("kind") == 1, F.col("types") * 16).otherwise(0))).first()
    n, v = n or 0, v or 0
    if (size or 0) <= max_broadcast:
        return _by_broadcast(docs, model, buckets, n, v)
    _let_shuffles_go(docs.sparkSession)
    return _by_buckets(docs, model, buckets, n, v)


def op7(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
