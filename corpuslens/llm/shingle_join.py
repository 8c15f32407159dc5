"""N-gram Jaccard join: which documents share most of their word shingles.

Equal shingle sets become one class first. Then a T-occurrence search (DivideSkip) in two steps. A partner of a set with s
shingles has T = ceil(t s) of them or more. With the T - l longest inverted lists set apart, every partner is on l of the
s - T + l short ones at least. Those short lists alone are built over the cluster, twice: first to count for each set how
many of its short lists hold another one (with fewer than l it has no partner), then among the sets that are left, to bring
together those that meet on a list. They make candidate components. In each component (in pairs of blocks of it, if large)
the search proper merges the short lists and probes the long ones for the overlap. Links are counted, joined to components
and never listed pair by pair.

Which lists are long is told by a sketch of fixed size, which counts shingles that several sets of a task share: passages
that many documents have in common go to the end of the order and bring nothing together. Any order loses no pair, as long
as it is the same for all sets; the sketch decides how few candidates there are.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.tokens import forget
from corpuslens.operators.graph import connected_components
from corpuslens.session import discard, materialize

#: Shingles of the sets that meet in one block, about: a larger candidate component is split into pairs of blocks.
BLOCK_SHINGLES = 1 << 20
#: Cells of the sketch and of a stretch of it; levels between the sizes of sets that can link (8, and 1 for rounding);
#: shingles that a task gathers before it counts or hands them on; members of short lists in a bucket (about).
CELLS, STRETCH, NEAR, CHUNK, BUCKET = 1 << 22, 1 << 16, 9, 400_000, 500_000
#: Parts in which a task settles what it has gathered, one after the other: all members of a list are in one part.
PARTS = 4
_CELL = np.uint64(64 - 22)
#: Bits of the filter that picks the texts to be read again, as a power of two.
FILTER_BITS = 26
_KEEP = 200_000
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _KEEP:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text in UTF-8.

    A-Z are lower-cased; words are what ASCII white space separates. With fewer words the whole sequence is the one
    shingle; without words there is none.
    """
    words = text.lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    m = max(len(h) - n + 1, 1)
    x = np.zeros(m, np.uint64)
    for i in range(min(n, len(h))):
        x = mix(x + h[i : i + m] + _C)
    return np.unique(x + np.uint64(min(n, len(h))))


def meetings(s: int) -> int:
    """l: on how many of its short lists a set of s shingles meets each partner that is no smaller."""
    return max(1, s // 10)


def short_lists(s: np.ndarray, cells: np.ndarray, num: int, den: int) -> np.ndarray:
    """The |s| - T + l shingles of a sorted set whose lists are taken to be shortest: by the sketch's count, ties by hash."""
    k = len(s) - -(-num * len(s) // den) + meetings(len(s))
    if len(s) <= k:
        return s
    n = cells[s >> _CELL]
    cold = s[n == 0]
    return cold[:k].copy() if len(cold) >= k else s[np.argsort(n, kind="stable")[:k]]


def size_level(n: int, num: int, den: int) -> int:
    """Sizes on a logarithmic scale: two sets that can link are at most NEAR levels apart."""
    return min(int(math.log(n) / math.log(den / num) * 8), 65535) if num < den else 0


def stars(token: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Members of short lists, each standing for sets of size levels lo..hi: who may be linked through whom.

    Returns (token, node, lo, hi, met, a, b, who, times). Of each list, members are taken by level and parted where the gap
    to all before is too wide for a link; each part is joined by edges (a, b) to its first member, which stands for it in
    what is returned. `met` is 1 where it isn't alone. Members that now meet another for the first time on a list (`alone`
    so far) are counted: `times` by `who`.
    """
    met = np.zeros(len(token), bool) if met is None else met.astype(bool)
    order = np.lexsort((node, lo, token))
    token, node, met, lo, hi = token[order], node[order], met[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(token):
        return token, node, lo, hi, met, node, node, node, node
    fresh = np.r_[True, token[1:] != token[:-1]]
    lift = np.cumsum(fresh) << 20
    top = np.maximum.accumulate(hi + lift)
    new = fresh | (lo + lift > np.r_[0, top[:-1]] + NEAR)
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(token)])
    first = np.repeat(node[at], size)
    other = first != node
    edges = np.unique(np.stack([node[other], first[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    several = np.maximum.reduceat(other, at)
    who, times = np.unique(node[np.repeat(several, size) & ~met], return_counts=True)
    return token[at], node[at], lo[at], np.maximum.reduceat(hi, at), several | met[at], edges[0], edges[1], who, times


class Lists:
    """Inverted lists of a block of sets, sizes ascending. search() is a T-occurrence search by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.count = num, den, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(values, kind="stable")
        self.owner, ordered = owner[order], values[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self.tokens, self.start = ordered[first], first
        self.length = np.diff(np.r_[first, len(ordered)])
        self.keys = np.repeat(np.arange(len(first), dtype=np.int64), self.length) * max(1, self.count) + self.owner

    def _entries(self, lists: np.ndarray) -> np.ndarray:
        n = self.length[lists]
        total = int(n.sum())
        return self.owner[np.repeat(self.start[lists] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(total)] if total else np.zeros(0, np.int64)

    def _merge(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets on these lists and on how many: a heap merge for few entries, a merge of sorted runs for many."""
        if int(self.length[lists].sum()) <= 48:
            runs = heapq.merge(*(self.owner[self.start[x] : self.start[x] + self.length[x]].tolist() for x in lists))
            got = [(k, sum(1 for _ in g)) for k, g in groupby(runs)]
            return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)
        return np.unique(self._entries(lists), return_counts=True)

    def search(self, s: np.ndarray, below: int | None = None, shared_least: int = 1) -> np.ndarray:
        """Sets (of position under `below`, if given) whose Jaccard similarity with s reaches num/den.

        A partner has T = ceil(t |s|) elements of s or more. Lists of elements that nothing else holds are dropped
        (shared_least). The L = T - 1 longest lists are set apart; every partner is on one of the short ones, which are
        merged; partners found there are looked up in the long lists by binary search, or counted by a scan where that
        reads less.
        """
        none = np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        lists = at[self.tokens[at] == s] if len(self.tokens) else none
        lists = lists[self.length[lists] > shared_least - 1]
        need = -(-self.num * len(s) // self.den)
        if len(lists) < need or not need:
            return none
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        cut = len(lists) - (need - 1)
        short, long = lists[:cut], lists[cut:]
        found, hits = self._merge(short)
        ok = (self.sizes[found] * self.den >= self.num * len(s)) & (len(s) * self.den >= self.num * self.sizes[found])
        if below is not None:
            ok &= found < below
        found, hits = found[ok], hits[ok]
        if not len(found):
            return none
        scan = int(self.length[long].sum())
        if len(found) * len(long) * max(1, math.log2(len(self.keys))) > 4 * scan:
            hits = hits + np.bincount(self._entries(long), minlength=self.count)[found]
        else:
            probes = (long[:, None] * self.count + found[None, :]).ravel()
            place = np.searchsorted(self.keys, probes)
            place[place == len(self.keys)] = 0
            hits = hits + (self.keys[place] == probes).reshape(len(long), len(found)).sum(axis=0)
        union = len(s) + self.sizes[found] - hits
        return found[hits * self.den >= union * self.num]


def _links(left: list[tuple], right: list[tuple] | None, num: int, den: int):
    """(node, root, links) of a block pair. left, right: (node, copies, set); right is None for a block with itself."""
    both = left + (right or [])
    parent = {x[0]: x[0] for x in both}
    links = dict.fromkeys(parent, 0)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x, found):
        for y in found:
            if x[0] != y[0]:
                links[x[0]] += y[1]
                links[y[0]] += x[1]
                a, b = root(x[0]), root(y[0])
                parent[max(a, b)] = min(a, b)

    key = lambda x: (len(x[2]), x[0])
    if right is None:
        left = sorted(left, key=key)
        index = Lists([x[2] for x in left], num, den)
        for i, x in enumerate(left):
            join(x, [left[j] for j in index.search(x[2], below=i, shared_least=2)])
    else:
        right = sorted(right, key=key)
        index = Lists([x[2] for x in right], num, den)
        for x in left:
            join(x, [right[j] for j in index.search(x[2])])
    return [(x, root(x), links[x]) for x in parent]


def _class_id(s: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a shingle set as two signed numbers; the first names its class."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _texts(batches):
    for b in batches:
        for a in range(0, b.num_rows, 512):
            yield b.slice(a, 512)


SETS = "row_key long, doc_id long, n_shingles long, node long, check long, cell long, counts binary"


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows from docs(row_key, text as bytes, doc_id). Each document's set: size and the two halves of its digest.

    And per task, by stretch of cells (`cell`, from 0), how many of its sets hold a shingle of the cell that another set
    of the task holds as well.
    """

    def run(batches):
        import pyarrow as pa

        forget()
        hashes, seen, held, size = WordHashes(), set(), [], 0
        cells = np.zeros(CELLS, np.uint32)

        def count():
            s, times = np.unique(np.concatenate(held), return_counts=True)
            np.add.at(cells, (s[times > 1] >> _CELL).astype(np.int64), times[times > 1].astype(np.uint32))

        for part in _texts(batches):
            sets = [shingles(t.as_py(), n, hashes) for t in part.column(1)]
            ids = [_class_id(s) for s in sets]
            rows = [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [x[0] for x in ids], [x[1] for x in ids])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *rows, pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=names)
            for s, x in zip(sets, ids):
                if x not in seen:
                    seen.add(x)
                    held.append(s)
                    size += len(s)
            if size > CHUNK:
                count()
                held, size = [], 0
        if held:
            count()
        parts = [(i, c.tobytes()) for i, c in enumerate(cells.reshape(-1, STRETCH)) if c.any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array([x[0] for x in parts], pa.int64()), pa.array([x[1] for x in parts], pa.binary())], names=names)

    names = [x.split()[0] for x in SETS.split(", ")]
    return docs.mapInArrow(run, SETS)


def _merged(parts: DataFrame, kind: str, add) -> dict[int, np.ndarray]:
    """(cell, counts) rows of arrays, those of a cell merged by `add`; in two steps, one row at a time."""

    def run(batches):
        import pyarrow as pa

        key, total = None, None
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                if k != key:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], names=["cell", "counts"])
                    key, total = k, np.frombuffer(c.as_py(), kind).copy()
                else:
                    add(total, np.frombuffer(c.as_py(), kind), out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], names=["cell", "counts"])

    some = parts.select("cell", "counts", F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("salt"))
    some = some.repartition("cell", "salt").sortWithinPartitions("cell").select("cell", "counts").mapInArrow(run, "cell long, counts binary")
    some = some.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, counts binary")
    return {cell: np.frombuffer(counts, kind) for cell, counts in some.toLocalIterator()}


def shared_cells(sets: DataFrame) -> np.ndarray:
    """The sketch: the tasks' counts summed, CELLS numbers whatever the input."""
    cells = np.zeros((CELLS // STRETCH, STRETCH), np.uint32)
    for cell, counts in _merged(sets.where("cell is not null"), "u4", np.add).items():
        cells[cell] = counts
    return cells.reshape(-1)


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ _C) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (2**FILTER_BITS bits) over the one column of ids, so that texts that aren't wanted needn't move to a join.

    With far more ids than bits it lets more rows pass, never fewer.
    """

    def run(batches):
        import pyarrow as pa

        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b in batches:
            x = _bit(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, x >> 3, np.left_shift(1, 7 - (x & 7)).astype(np.uint8))
        parts = [(i, x.tobytes()) for i, x in enumerate(bits.reshape(-1, 1 << 16)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int64()), pa.array([x[1] for x in parts], pa.binary())], names=["cell", "counts"])

    filled = np.zeros((1 << (FILTER_BITS - 19), 1 << 16), np.uint8)
    for cell, part in _merged(ids.mapInArrow(run, "cell long, counts binary"), "u1", np.bitwise_or).items():
        filled[cell] = part
    return filled.reshape(-1)


def _passes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    x = _bit(ids)
    return (bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1


def only(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows of docs whose row_key passes the filter; of those without a doc_id one for each row_key."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def wanted(row_key):
        import pandas as pd

        return pd.Series(_passes(row_key.to_numpy(), sent.value))

    found = docs.where(wanted("row_key"))
    unnamed = found.where(F.col("doc_id").isNull()).groupBy("row_key").agg(F.first("text").alias("text"))
    return found.where(F.col("doc_id").isNotNull()).select("row_key", "text").unionByName(unnamed)


MEETS = "bucket long, a long, b long, lists binary"
_MEMBER = np.dtype([("node", "<i8"), ("lo", "<u2"), ("hi", "<u2"), ("n", "<u4"), ("met", "?")])


def _meets(bucket, a, b, lists):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((bucket, a, b, lists), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "a", "b", "lists"])


def _packed(token: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, met: np.ndarray) -> bytes:
    """Members of lists by node: (node, lo, hi, n, met) heads, then the n tokens of each."""
    order = np.lexsort((token, met, hi, lo, node))
    token, node, lo, hi, met = token[order], node[order], lo[order], hi[order], met[order]
    at = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (met[1:] != met[:-1])])
    heads = np.zeros(len(at), _MEMBER)
    heads["node"], heads["lo"], heads["hi"], heads["met"], heads["n"] = node[at], lo[at], hi[at], met[at], np.diff(np.r_[at, len(node)])
    return len(at).to_bytes(8, "little") + heads.tobytes() + token.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    k = int.from_bytes(blob[:8], "little")
    heads = np.frombuffer(blob, _MEMBER, k, 8)
    return np.frombuffer(blob, np.uint64, -1, 8 + k * _MEMBER.itemsize), *(np.repeat(heads[c], heads["n"]) for c in ("node", "lo", "hi", "met"))


def _counts_packed(who: np.ndarray, times: np.ndarray, keys: int):
    """MEETS rows (bucket -2) of how often classes meet others, packed by a hash of the class."""
    key = (mix(who.view(np.uint64) ^ _A) % np.uint64(keys)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    who, times, key = who[order], times[order], key[order]
    cut = np.flatnonzero(np.r_[True, np.diff(key) != 0])
    blobs = [who[i:j].tobytes() + times[i:j].astype("<u4").tobytes() for i, j in zip(cut, np.r_[cut[1:], len(key)])]
    return _meets(np.full(len(cut), -2), key[cut], np.zeros(len(cut), np.int64), blobs)


def _counts_summed(batches):
    """(node, times) of packed counts, rows of a key side by side."""
    import pyarrow as pa

    def summed(blobs):
        n = [len(x) // 12 for x in blobs]
        who, at = np.unique(np.concatenate([np.frombuffer(x, np.int64, k) for x, k in zip(blobs, n)]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([np.frombuffer(x, "<u4", k, 8 * k) for x, k in zip(blobs, n)])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(times)], names=["node", "times"])

    key, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key and blobs:
                yield summed(blobs)
                blobs = []
            key = k
            blobs.append(blob.as_py())
    if blobs:
        yield summed(blobs)


def short_list_meetings(docs: DataFrame, n: int, num: int, den: int, sketch, buckets: int, edges: bool, among=None) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): edges (a, b) between classes that meet on a short list and whose sizes allow a link, or stand between such (none unless asked for); and (node, times), on how many of its short lists a class meets others.

    A task settles what meets within it and hands on one member for each part of a list, packed by bucket of tokens; so a
    list that very many sets are on has a few entries a task in its bucket. among: a broadcast id_filter() of the documents
    to take.
    """

    keys = 1 + buckets // 8

    def linked(a, b):
        if edges and len(a):
            yield _meets(np.full(len(a), -1), a, b, [None] * len(a))

    def summed(counts):
        if any(len(who) for who, _ in counts):
            who, at = np.unique(np.concatenate([x[0] for x in counts]), return_inverse=True)
            yield _counts_packed(who, np.bincount(at, weights=np.concatenate([x[1] for x in counts])), keys)

    def post(batches):
        import pyarrow as pa

        forget()
        hashes, seen, held, size = WordHashes(), set(), [], 0

        def flush():
            tokens = np.concatenate([x[0] for x in held])
            n = [len(x[0]) for x in held]
            nodes, levels = (np.repeat(np.array([x[i] for x in held], np.int64), n) for i in (1, 2))
            held.clear()
            part, counts = (mix(tokens ^ _B) % np.uint64(buckets) % np.uint64(PARTS)).astype(np.int8), []
            for k in range(PARTS):
                at = np.flatnonzero(part == k)
                if not len(at):
                    continue
                token, node, lo, hi, met, a, b, *told = stars(tokens[at], nodes[at], levels[at], levels[at])
                yield from linked(a, b)
                counts.append(told)
                key = (mix(token ^ _B) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                parts = [order[i:j] for i, j in zip(cut, np.r_[cut[1:], len(order)])]
                zero = np.zeros(len(cut), np.int64)
                yield _meets(key[order][cut], zero, zero, [_packed(token[i], node[i], lo[i], hi[i], met[i]) for i in parts])
            yield from summed(counts)

        for part in _texts(batches):
            texts = part.column(1)
            if among is not None:
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                texts = texts.filter(pa.array(_passes(ids, among.value)))
            for t in texts:
                s = shingles(t.as_py(), n, hashes)
                if len(s):
                    node = _class_id(s)[0]
                    if node not in seen:
                        seen.add(node)
                        held.append((short_lists(s, sketch.value, num, den), node, size_level(len(s), num, den)))
                        size += len(held[-1][0])
            if size > CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(batches):
        counts, size = [], 0

        def told(blobs):
            nonlocal counts, size
            *_, a, b, who, times = stars(*(np.concatenate(x) for x in zip(*map(_unpacked, blobs))))
            yield from linked(a, b)
            counts.append((who, times))
            size += len(who)
            if size > CHUNK:
                yield from packed()

        def packed():
            nonlocal counts, size
            yield from summed(counts)
            counts, size = [], 0

        key, blobs = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != key and blobs:
                    yield from told(blobs)
                    blobs = []
                key = k
                blobs.append(blob.as_py())
        if blobs:
            yield from told(blobs)
        yield from packed()

    posted = materialize(docs.mapInArrow(post, MEETS), "short-lists")
    lists = posted.where("bucket >= 0").select("bucket", "lists").repartition("bucket").sortWithinPartitions("bucket")
    met = materialize(posted.where("bucket < 0").unionByName(lists.mapInArrow(meet, MEETS)), "meetings")
    counts = met.where("bucket = -2").select("a", "lists").repartition("a").sortWithinPartitions("a").mapInArrow(_counts_summed, "node long, times long")
    out = materialize(met.where("bucket = -1").select("a", "b").distinct(), "candidate-edges"), materialize(counts, "meeting-counts")
    discard(posted, met)
    return out


def candidates(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int, cells: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(edges, live): edges (a, b) between classes that meet on short lists, and the classes among them that meet others often enough."""
    sketch = docs.sparkSession.sparkContext.broadcast(cells)
    need = F.greatest(F.lit(1), F.expr(f"(({num} * n + {den} - 1) div {den}) div 10"))  # meetings() of the smallest partner

    def often(times: DataFrame) -> DataFrame:
        return materialize(classes.join(times, "node").where(F.col("times") >= need).drop("times"), "live")

    def buckets(of: DataFrame) -> int:
        posts = of.agg(F.sum(F.col("n") * ((den - num) / den + 0.1) + 1)).first()[0] or 0
        return max(8, int(posts) // BUCKET)

    none, first = short_list_meetings(docs, n, num, den, sketch, buckets(classes), False)
    live = often(first)
    among = docs.sparkSession.sparkContext.broadcast(id_filter(live.select("rep")))
    edges, second = short_list_meetings(docs, n, num, den, sketch, buckets(live), True, among)
    still = often(second)
    discard(none, first, second, live)
    return edges, still


def _search_blocks(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, root, links) of rows(comp, bi, bj, side, node, copies, text); one block pair is in a task's memory at a time."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()

        def each():
            for b in batches:
                cols = [b.column(i) for i in range(b.num_columns)]
                for i in range(b.num_rows):
                    yield tuple(c[i].as_py() for c in cols)

        out = []
        for (_, bi, bj), group in groupby(each(), key=lambda r: r[:3]):
            sides = ({}, {})
            for r in group:
                s = shingles(r[6], n, hashes)
                if len(s) and _class_id(s)[0] == r[4]:  # a key may be that of several texts
                    sides[r[3]][r[4]] = (r[4], r[5], s)
            out += _links(list(sides[0].values()), None if bi == bj else list(sides[1].values()), num, den)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "root", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "root", "links"])

    dealt = rows.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return dealt.select("comp", "bi", "bj", "side", "node", "copies", "text").mapInArrow(run, "node long, root long, links long")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of docs: the Jaccard self join at num/den, as classes.

    Two rows link when den * |A & B| >= num * |A | B| for their sets of n-word shingles. component_id is the smallest
    doc_id reachable by links; n_links counts the rows linked directly, equal ones included. Rows without words have no
    shingles, keep their own id and link with nothing. A row with a null doc_id is searched by its text like others but names
    no component: it gets the least doc_id that its component has, null if none. Rows that share a doc_id are rows of their
    own, each by its text. Classes go by 64 bits of their digest. Very long texts are sets like others, each in one task's
    memory; an empty table gives an empty one. Other columns are ignored.

    Scale: two passes over the texts, one for the digests and one for the short lists (three in ten shingles at 80 %), packed
    and once for equal sets of a task. Only what is left by the counts has its texts read again. A candidate
    component of more than `block` shingles is split into pairs of blocks over many tasks, whose number grows with the
    square of its different texts (the links to count do, too).
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("row_key"), "text", "doc_id")
    sets = materialize(shingle_sets(docs, n), "shingles")
    rows = sets.where("cell is null").select("row_key", "doc_id", "n_shingles", "node", "check")
    classes = rows.where("n_shingles > 0").groupBy("node", "check").agg(F.coalesce(F.min("doc_id"), F.min("row_key")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    near, live = candidates(docs.select("row_key", "text"), classes, n, num, den, shared_cells(sets))
    comps = materialize(connected_components(near, "a", "b"), "candidates")
    members = materialize(comps.join(live, "node"), "candidate-classes")
    alone = members.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    members = members.join(alone, "component")
    # a component over the block size is dealt to blocks by a hash of the node; each pair of blocks is a group
    sizes = materialize(members.groupBy("component").agg(F.ceil(F.sum("n") / block).alias("nb")), "candidate-sizes")
    members = members.join(sizes, "component").withColumn("me", F.pmod(F.xxhash64("node"), "nb"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda o: F.struct(F.least("me", o).alias("bi"), F.greatest("me", o).alias("bj"), F.when(F.col("me") <= o, 0).otherwise(1).alias("side")))
    members = members.select(F.col("component").alias("comp"), "node", "rep", "copies", F.explode(pairs).alias("p")).select("comp", "node", "rep", "copies", "p.bi", "p.bj", "p.side")
    members = materialize(members, "candidate-blocks")
    wanted = only(docs, id_filter(members.select("rep").distinct()))
    found = materialize(_search_blocks(wanted.join(members, wanted["row_key"] == members["rep"]), n, num, den), "links")
    joined = materialize(connected_components(found.where("node <> root"), "node", "root"), "joined")
    links = materialize(found.groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    named = classes.join(joined, "node", "left").join(links, "node", "left")
    named = materialize(named.select("node", "check", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    lowest = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    named_id = materialize(named.join(lowest, "component").select("node", "check", "component_id", "links"), "classes-named")
    discard(near, live, comps, sizes, members, found, joined, links, named, lowest, classes)
    out = rows.join(named_id, ["node", "check"], "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))


def near_duplicates_removed(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest doc_id (one row of it).

    Rows go by doc_id and text together, so a null doc_id (last in order) and texts that share a doc_id are searched and
    kept like others. Rows with the same doc_id and text are one document.
    """
    keyed = docs.withColumn("_k", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    comps = jaccard_components(keyed, n, num, den, key="_k").select(F.col("doc_id").alias("_k"), "component_id")
    ids = keyed.select("_k", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k").alias("o"))
    keep = ids.join(comps.distinct(), "_k").groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o._k").alias("_k"))
    order = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    kept = keyed.join(keep, "_k", "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(*order))).where("_n = 1")
    return kept.select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, n=3, num=90, den=100)
