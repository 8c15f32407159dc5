"""Exact repeated passages: every byte covered by a LENGTH-byte string that also starts earlier.

Strings are brought together by anchors. A string's anchor is the smallest hash among its K-byte pieces (the leftmost of
equals), so equal strings have the same anchor at the same place, and consecutive strings mostly share one: a run. Only
(anchor, run) fingerprints are dealt over the cluster. A run seen before repeats as a whole. Runs that share an anchor
but differ (the edges of repeats) are fetched as text, and each bucket of them gets a run-length index: a run-compressed
Burrows-Wheeler transform with the suffix array sampled at run ends. The longest common prefixes are compared at run
heads only and streamed in text order to all other positions. Suffixes that share LENGTH bytes with the one sorted before
them, which is known from run heads and tails alone, are chained to the first of their stretch, and all but the earliest of
a stretch are marked. The index keeps run heads, tails and lengths; the sort that builds it holds a bucket's suffixes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.shingle_join import mix
from corpuslens.session import materialize

LENGTH, K = 100, 32
#: Bytes of text whose fingerprints share a bucket (about); bytes that are hashed in one go (positions take 24 bits);
#: runs that a map task gathers before it hands them on; different runs of one anchor above which strings are dealt by
#: their own hash instead of as a group.
BUCKET_BYTES, CHUNK_BYTES, CHUNK_RUNS, HOT_RUNS = 8_000_000, 1 << 20, 400_000, 20_000
_P, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = -(2**63)
_POS = np.uint64(24)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 2**64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _C)


def rolling(b: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes at each position (of those with n bytes left), by doubling."""
    parts, have, h = [], 1, _BYTE[b]
    left = n
    while left:
        if left & have:
            parts.append((have, h))
            left -= have
        if left:
            h = h[:-have] * _power(have) + h[have:] if len(h) > have else h[:0]
            have *= 2
    m, at, out = max(0, len(b) - n + 1), 0, None
    for k, h in reversed(parts):
        x = h[at : at + m]
        out = x if out is None else out * _power(k) + x
        at += k
    return mix(out) if out is not None else np.zeros(0, np.uint64)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, more, anchor, content): runs of string starts start..start+more under one anchor, with two hashes."""
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    pieces = rolling(b, K)
    v = (pieces >> _POS << _POS) | np.arange(len(pieces), dtype=np.uint64)
    width, want = 1, LENGTH - K + 1
    while 2 * width <= want:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < want:
        v = np.minimum(v[: len(v) - (want - width)], v[want - width :])
    anchor = (v & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), n)[: len(anchor)]
    ok = np.arange(len(anchor)) + LENGTH <= ends[text]
    p = np.flatnonzero(ok)
    if not len(p):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.r_[True, (anchor[p][1:] != anchor[p][:-1]) | (np.diff(p) != 1)]
    s, e = p[new], p[np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]]
    whole = rolling(b, LENGTH)
    more = e - s
    content = mix(whole[s] + mix(whole[e] ^ _C) * _P + more.astype(np.uint64))
    return text[s], s - (ends - n)[text[s]], more, pieces[anchor[s]], content


_FIELDS = (("h", np.uint64), ("r", np.uint64), ("doc", np.int64), ("seq", np.int32), ("s", np.uint32), ("more", np.uint16))


def _pack(a: dict[str, np.ndarray]) -> bytes:
    return b"".join(a[k].astype(t).tobytes() for k, t in _FIELDS)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    row = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    out: dict[str, list] = {k: [] for k, _ in _FIELDS}
    for x in blobs:
        n, at = len(x) // row, 0
        for k, t in _FIELDS:
            out[k].append(np.frombuffer(x, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in out.items()}


def _firsts(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The earliest of each (anchor, content), sorted so; and all others."""
    order = np.lexsort((a["s"], a["seq"], a["doc"], a["r"], a["h"]))
    a = {k: v[order] for k, v in a.items()}
    first = np.r_[True, (a["h"][1:] != a["h"][:-1]) | (a["r"][1:] != a["r"][:-1])] if len(order) else np.zeros(0, bool)
    return {k: v[first] for k, v in a.items()}, {k: v[~first] for k, v in a.items()}


#: kind 0: a packed array of runs for bucket `key`; 1: bytes a..b of a document repeat; 2: text a..b is wanted by bucket `key`, 3: the same for an anchor of very many runs.
ROWS = "key long, kind int, doc_id long, seq int, a long, b long, data binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _rows(key, kind: int, doc, seq, a, b, data=None):
    import pyarrow as pa

    n = len(doc)
    lift = lambda x, t: pa.array(np.asarray(x), t) if np.ndim(x) else pa.array(np.full(n, x), t)
    return pa.RecordBatch.from_arrays([lift(key, pa.int64()), lift(kind, pa.int32()), lift(doc, pa.int64()), lift(seq, pa.int32()), lift(a, pa.int64()), lift(b, pa.int64()), pa.array(data or [None] * n, pa.binary())], names=_NAMES)


def _joined(a: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(doc, seq, from, to) of runs as byte stretches, those that touch in one."""
    order = np.lexsort((a["s"], a["seq"], a["doc"]))
    doc, seq, s = a["doc"][order], a["seq"][order], a["s"][order].astype(np.int64)
    e = s + a["more"][order] + LENGTH
    new = np.r_[True, (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (s[1:] > e[:-1])] if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], seq[at], s[at], (np.maximum.reduceat(e, at) if len(at) else e)


def fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """ROWS of kinds 0 and 1 from docs(doc_id, seq, text as bytes); copies within a task are settled there."""

    def run(batches):
        held, n = [], 0

        def flush():
            a = {k: np.concatenate([x[k] for x in held]) for k, _ in _FIELDS}
            first, rest = _firsts(a)
            if len(rest["h"]):
                doc, seq, s, e = _joined(rest)
                yield _rows(doc % buckets, 1, doc, seq, s, e)
            key = (mix(first["h"] ^ _C) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            ends = np.r_[cut[1:], len(order)]
            blobs = [_pack({k: v[order[i:j]] for k, v in first.items()}) for i, j in zip(cut, ends)]
            zero = np.zeros(len(cut), np.int64)
            yield _rows(key[order][cut], 0, zero, zero, zero, zero, blobs)

        def pieces():
            """Lists of (doc, seq, start, bytes) of few megabytes; a very long text comes in overlapping pieces."""
            out, size = [], 0
            for b in batches:
                for d, q, t in zip(b.column(0), b.column(1), b.column(2)):
                    d, t = d.as_py(), t.as_py() or b""
                    for a in range(0, max(1, len(t) - LENGTH + 1), CHUNK_BYTES):
                        out.append((_LOW if d is None else d, q.as_py(), a, t[a : a + CHUNK_BYTES + LENGTH - 1]))
                        size += len(out[-1][3])
                        if size >= CHUNK_BYTES:
                            yield out
                            out, size = [], 0
            if out:
                yield out

        for part in pieces():
            text, s, more, h, r = runs_of([x[3] for x in part])
            if not len(s):
                continue
            doc, seq, at = (np.array([x[i] for x in part], np.int64) for i in range(3))
            held.append({"h": h, "r": r, "doc": doc[text], "seq": seq[text].astype(np.int32), "s": (s + at[text]).astype(np.uint32), "more": more.astype(np.uint16)})
            n += len(s)
            if n >= CHUNK_RUNS:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def _by_key(batches, columns: list[int]):
    """(key, rows) of consecutive equal keys in column 0."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(b.column(i) for i in columns)):
            r = tuple(x.as_py() for x in r)
            if r[0] != key:
                if rows:
                    yield key, rows
                key, rows = r[0], []
            rows.append(r)
    if rows:
        yield key, rows


def settle_runs(rows: DataFrame) -> DataFrame:
    """ROWS of kinds 1 to 3: a bucket's runs seen before repeat; the rest that share an anchor are asked for."""

    def run(batches):
        for key, group in _by_key(batches, list(range(7))):
            marks = [r for r in group if r[1] == 1]
            if marks:
                yield _rows(key, 1, *(np.array(x) for x in list(zip(*marks))[2:6]))
            blobs = [r[6] for r in group if r[1] == 0]
            if not blobs:
                continue
            first, rest = _firsts(_unpack(blobs))
            if len(rest["h"]):
                yield _rows(key, 1, *_joined(rest))
            _, at, n = np.unique(first["h"], return_inverse=True, return_counts=True)
            n = n[at]
            for kind, pick in ((2, (n > 1) & (n <= HOT_RUNS)), (3, n > HOT_RUNS)):
                if pick.any():
                    x = {k: v[pick] for k, v in first.items()}
                    yield _rows(key, kind, x["doc"], x["seq"], x["s"].astype(np.int64), x["s"].astype(np.int64) + x["more"] + LENGTH)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, ROWS)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, with the suffix array sampled at run ends.

    A text ends before any byte; equal suffixes are ordered by text. heads/tails: suffix array at the ends of each run,
    symbols: its byte, lengths: its length.
    """

    def __init__(self, texts: list[bytes]):
        n = np.array([len(t) for t in texts], np.int64)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        m = len(self.text)
        self.left = np.repeat(np.cumsum(n), n) - np.arange(m)  # bytes to the end of the text
        padded = np.r_[self.text, np.zeros(8, np.uint8)].astype(np.uint64)
        key = np.zeros(m, np.uint64)
        for i in range(7):
            key = key << np.uint64(8) | np.where(self.left > i, padded[i : m + i], np.uint64(0))
        key = key << np.uint64(8) | np.minimum(self.left, 7).astype(np.uint64)
        width, longest = 7, int(n.max()) if len(n) else 0
        while True:
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]]) if m else 0
            if width >= longest:
                break
            after = np.where(self.left > width, np.r_[rank[width:], np.zeros(min(width, m), np.int64)], 0)
            key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
            width *= 2
        first = self.left == np.repeat(n, n)
        bwt = np.where(first[order], -1, self.text[order - 1].astype(np.int64)) if m else order
        # a text's first byte follows no byte: such places are runs of their own
        head = np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)] if m else np.zeros(0, bool)
        self.at = np.flatnonzero(head)
        self.symbols, self.lengths = bwt[self.at], np.diff(np.r_[self.at, m])
        self.heads, self.tails = order[self.at], order[self.at + self.lengths - 1]

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the texts at p and q share."""
        most = np.minimum(self.left[p], self.left[q])
        n, live = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(live):
            live = live[n[live] < most[live]]
            live = live[self.text[p[live] + n[live]] == self.text[q[live] + n[live]]]
            n[live] += 1
        return n

    def matching_lengths(self) -> np.ndarray:
        """By text position, the bytes shared with the suffix sorted before it: compared at run heads, streamed elsewhere."""
        m = len(self.text)
        if not m:
            return np.zeros(0, np.int64)
        reach = np.zeros(m, np.int64)  # position + length, known at run heads; it never falls along the text
        inner = self.at > 0
        p, q = self.heads[inner], self.tails[:-1]
        reach[p] = p + self._common(p, q)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(m), 0)

    def before(self, p: np.ndarray) -> np.ndarray:
        """The suffix sorted right before each of p. That of a run's head is the tail of the run before; between heads both move on together."""
        inner = self.at > 0
        heads, tails = self.heads[inner], self.tails[:-1]
        order = np.argsort(heads)
        k = order[np.searchsorted(heads[order], p, "right") - 1]
        return tails[k] + p - heads[k]

    def repeated(self, length: int) -> np.ndarray:
        """Positions whose next `length` bytes also start at an earlier position.

        Suffixes that share these bytes are a stretch of the sorted order: a chain from each to the one before it. Chains are
        followed by doubling to the first of the stretch, and the earliest of each stretch is let off.
        """
        p = np.flatnonzero(self.matching_lengths() >= length)
        if not len(p):
            return p
        up = self.before(p)
        members = np.union1d(p, up)
        to = np.arange(len(members))
        to[np.searchsorted(members, p)] = np.searchsorted(members, up)
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        earliest = np.full(len(members), members[-1])
        np.minimum.at(earliest, to, members)
        return members[members != earliest[to]]


def settle_strings(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """ROWS of kind 1 for the strings of the runs that were asked for."""
    asked = wanted.groupBy("doc_id", "seq").agg(F.collect_list(F.struct("key", "kind", "a", "b")).alias("asked"))
    with_text = docs.select(F.coalesce("doc_id", F.lit(_LOW)).alias("doc_id"), "seq", "text").join(asked, ["doc_id", "seq"])

    def cut(batches):
        for b in batches:
            for r in range(0, b.num_rows, 64):
                out, hot = [], []
                for row in b.slice(r, 64).to_pylist():
                    for x in row["asked"]:
                        t = row["text"][x["a"] : x["b"]]
                        (out if x["kind"] == 2 else hot).append((x["key"], row["doc_id"], row["seq"], x["a"], t))
                if out:
                    k, d, q, a, t = zip(*out)
                    yield _rows(np.array(k), 2, np.array(d), np.array(q), np.array(a), np.array(a), list(t))
                for _, d, q, a, t in hot:
                    h = rolling(np.frombuffer(t, np.uint8), LENGTH)
                    order = np.argsort(h % np.uint64(buckets), kind="stable")
                    key = (h % np.uint64(buckets)).astype(np.int64)[order]
                    yield _rows(buckets + key, 3, np.full(len(h), d), np.full(len(h), q), a + order, np.zeros(len(h), np.int64), [t[i : i + LENGTH] for i in order])

    def run(batches):
        for key, group in _by_key(batches, list(range(7))):
            group.sort(key=lambda r: r[2:5])
            texts = [r[6] for r in group]
            if key >= buckets:  # whole strings of one hash bucket: equal ones are side by side after sorting
                seen: set[bytes] = set()
                hit = [i for i, t in enumerate(texts) if t in seen or seen.add(t)]
                of, p = np.array(hit, np.int64), np.zeros(len(hit), np.int64)
            else:
                at = RunLengthIndex(texts).repeated(LENGTH)
                ends = np.cumsum([len(t) for t in texts])
                of = np.searchsorted(ends, at, side="right")
                p = at - np.r_[0, ends[:-1]][of]
            if not len(of):
                continue
            doc, seq, s = (np.array([r[i] for r in group], np.int64)[of] for i in (2, 3, 4))
            yield _rows(key, 1, *_joined({"doc": doc, "seq": seq, "s": s + p, "more": np.zeros(len(of), np.int64)}))

    return with_text.mapInArrow(cut, ROWS).repartition("key").sortWithinPartitions("key").mapInArrow(run, ROWS)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): docs as (doc_id, seq, text in UTF-8), and (doc_id, seq, a, b) byte stretches that repeat earlier ones.

    Stretches may touch or overlap; null ids appear as the least long, before all others. Rows that share a doc_id are
    documents of their own, ordered by text (seq). One pass makes about a fingerprint for every 35 bytes; the texts move
    twice, to be cut where asked and by the caller to be joined with the spans. One anchor's different runs meet in one
    task as 34 bytes each.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    n, ids, size = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.sum(F.octet_length("text"))).first()
    seq = F.lit(0) if ids == n else F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    docs = docs.withColumn("seq", seq.cast("int")).select("doc_id", "seq", "text")
    buckets = max(8, -(-(size or 0) // BUCKET_BYTES))
    settled = materialize(settle_runs(fingerprints(docs, buckets)), "runs")
    strings = materialize(settle_strings(docs, settled.where("kind > 1"), buckets), "strings")
    return docs, settled.where("kind = 1").unionByName(strings).select("doc_id", "seq", "a", "b")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row: the text's bytes without those that repeat earlier ones.

    kept is binary: a cut may fall inside a character. Null texts count as empty; texts under LENGTH bytes are kept.
    """
    docs, spans = repeated_spans(docs, key, text)
    spans = spans.groupBy("doc_id", "seq").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    both = docs.withColumn("k", F.coalesce("doc_id", F.lit(_LOW))).join(spans.withColumnRenamed("doc_id", "k"), ["k", "seq"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(0, b.num_rows, 256):
                out = []
                for row in b.slice(r, 256).to_pylist():
                    t, kept, at, removed, n = row["text"] or b"", [], 0, 0, 0
                    stretch: list[list[int]] = []
                    for x in sorted((x["a"], x["b"]) for x in row["spans"] or ()):
                        if stretch and x[0] <= stretch[-1][1]:
                            stretch[-1][1] = max(stretch[-1][1], x[1])
                        else:
                            stretch.append(list(x))
                    for a, z in stretch:
                        kept.append(t[at:a])
                        at, removed, n = z, removed + z - a, n + 1
                    kept.append(t[at:])
                    out.append((row["doc_id"], len(t), removed, n, b"".join(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
