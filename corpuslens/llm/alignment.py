"""Alignment of two tokenizers' tokens over the same text: groups between shared ends, and what is linked with what over a corpus."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from array import array
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tokens import _byte_letters, encoder, small_batches
from corpuslens.session import ensure_on_workers, materialize

#: No piece holds a space after another character, so a text may be cut before a space that follows one.
_CUT = re.compile(r"(?<=[^ ▁]) (?!\Z)")
_WIDE = "▁"
_REMEMBER, _LONGEST = 240_000, 48
#: Id pairs that are broadcast at once, 13 bytes each; the table's other slices get passes of their own.
SLICE = 2_000_000
_pieces: dict[str, Pieces] = {}
_bytes: dict[str, list] = {}


class Pieces:
    """ids(texts) of a sentencepiece file: those of each whole text, or None where the pieces' bytes aren't a space and the text.

    Between cuts a text is encoded alone: the model puts a space before it, which is the one that was cut. Short stretches
    (words, as a rule) are remembered, up to a fixed number in each of two generations: what is met again of the older one goes
    on to the newer. Models that merge over spaces, or change them, are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or m.encode("a  b", out_type=str)[0] != "▁a" or m.decode(m.encode("a  b")) != "a  b" or len(pieces) > 1 << 16:
            raise ValueError(f"{path} merges over spaces, changes them or has too many pieces")
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _new(self, parts: list[str]) -> list[bytes | None]:
        found = self.model.encode(parts, num_threads=1)
        right = (b"".join(map(self.bytes.__getitem__, ids)) == (" " + p).encode() for ids, p in zip(found, parts))
        return [array("H", ids).tobytes() if ok else None for ids, ok in zip(found, right)]

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        if len(self.words) > _REMEMBER:
            self.older, self.words = self.words, {}
        words = self.words
        cut = [(t.split(" ") if "  " not in t and t[:1] != " " and t[-1:] != " " and not any(c in t for c in _WIDE) else _CUT.split(t)) if t else [] for t in texts]
        found = [list(map(words.get, parts)) for parts in cut]
        missing = {w for parts, ids in zip(cut, found) if None in ids for w, x in zip(parts, ids) if x is None}
        known = {w: self.older[w] for w in missing if w in self.older}
        new = list(missing - known.keys())
        for s in range(0, len(new), 4096):
            known |= zip(new[s : s + 4096], self._new(new[s : s + 4096]))
        out = []
        for parts, ids in zip(cut, found):
            if None in ids:
                ids = [known[w] if x is None else x for w, x in zip(parts, ids)]
            out.append(None if None in ids else np.frombuffer(b"".join(ids), "<u2").astype(np.int64))
        words |= {w: x for w, x in known.items() if x is not None and len(w) <= _LONGEST}
        return out


def piece_model(path: str) -> Pieces:
    """One per worker process and file."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    if path not in _bytes:
        back = {c: b for b, c in _byte_letters().items()}
        d = json.load(open(path, encoding="utf-8"))
        vocab = {t["content"]: t["id"] for t in d["added_tokens"]} | d["model"]["vocab"]
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        _bytes[path] = out
    return _bytes[path]


def shared_cuts(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), ascending: all places with a[i] == b[j], where a and b are ascending ends of tokens, and a_at and b_at cut them into texts.

    Divide and conquer over all texts level by level: of each interval the common end next to its middle is located by
    bisecting b for the ends of a about the middle, more of them (twice as many each time) while none is common; both halves
    go on. An interval with none is a leaf. Ends of texts are common.
    """
    some = np.flatnonzero((a_at[1:] > a_at[:-1]) & (b_at[1:] > b_at[:-1]))
    found_a, found_b = [a_at[1:][some] - 1], [b_at[1:][some] - 1]
    lo, hi, blo, bhi = a_at[:-1][some], a_at[1:][some] - 1, b_at[:-1][some], b_at[1:][some] - 1
    while True:
        go = (lo < hi) & (blo < bhi)
        lo, hi, blo, bhi = lo[go], hi[go], blo[go], bhi[go]
        if not len(lo):
            break
        mid = (lo + hi) >> 1
        cut_a, cut_b = mid.copy(), np.searchsorted(b, a[mid])
        hit = b[cut_b] == a[mid]  # an end of a text lies behind every inner one
        rest, width = np.flatnonzero(~hit), 4
        while len(rest):
            first, last = np.maximum(lo[rest], mid[rest] - width), np.minimum(hi[rest], mid[rest] + width + 1)
            n = last - first
            starts = np.cumsum(n) - n
            probe = np.repeat(first - starts, n) + np.arange(n.sum())
            at = np.searchsorted(b, a[probe])
            ok = np.flatnonzero(b[at] == a[probe])
            owner = np.repeat(np.arange(len(rest)), n)[ok]
            off = np.abs(probe[ok] - mid[rest][owner])
            order = np.lexsort((off, owner))
            _, nearest = np.unique(owner[order], return_index=True)
            best = ok[order[nearest]]
            won = rest[np.repeat(np.arange(len(rest)), n)[best]]
            cut_a[won], cut_b[won], hit[won] = probe[best], at[best], True
            whole = (first == lo[rest]) & (last == hi[rest])
            rest, width = rest[~hit[rest] & ~whole], width * 2
        cut_a, cut_b, lo, hi, blo, bhi = cut_a[hit], cut_b[hit], lo[hit], hi[hit], blo[hit], bhi[hit]
        found_a.append(cut_a)
        found_b.append(cut_b)
        pair = lambda x, y: np.stack([x, y], 1).ravel()
        lo, hi, blo, bhi = pair(lo, cut_a + 1), pair(cut_a, hi), pair(blo, cut_b + 1), pair(cut_b, bhi)
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligned:
    """Tokens and cuts of a list of texts: ids a and b, where each text's begin (a_at, b_at), the last tokens of the groups (cut_a, cut_b; of texts: cut_at)."""

    def __init__(self, texts: list[str | None], a_path: str, b_path: str):
        enc, texts = encoder(a_path, plain=True), [t or "" for t in texts]
        a_bytes, pieces = byte_tokens(a_path), piece_model(b_path)
        a = [np.frombuffer(x, enc.dtype).astype(np.int64) for x in enc.ids([" " + t if t else "" for t in texts])]
        b = pieces.ids(texts)
        for i, t in enumerate(texts):
            if t and (b[i] is None or b"".join(map(a_bytes.__getitem__, a[i].tolist())) != (" " + t).encode()):
                a[i] = b[i] = np.zeros(0, np.int64)
        at = lambda x: np.r_[0, np.cumsum([len(y) for y in x], dtype=np.int64)]
        self.a_at, self.b_at = at(a), at(b)
        self.a, self.b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        ends = lambda ids, table: np.cumsum(np.array([len(x) for x in table], np.int64)[ids])
        self.cut_a, self.cut_b = shared_cuts(ends(self.a, a_bytes), ends(self.b, pieces.bytes), self.a_at, self.b_at)
        self.cut_at = np.searchsorted(self.cut_a, self.a_at)
        self.n_a, self.n_b = len(a_bytes), len(pieces.bytes)
        if self.n_a * self.n_b > 1 << 32:
            raise ValueError("id pairs of these vocabularies don't fit in 32 bits")

    def spelled(self) -> list[bytes]:
        """Each text's groups as decimal ids: a1,a2|b1;a3|b2,b3."""
        rows = _decimals(self.n_a, self.n_b)
        a_row, b_row = self.a.copy(), self.b + 2 * self.n_a
        a_row[self.cut_a] += self.n_a
        b_row[self.cut_b] += self.n_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        sizes = lambda cut: np.diff(np.r_[-1, cut])
        before_b = np.r_[0, self.cut_b + 1][:-1]  # tokens of b in earlier groups
        out[np.arange(len(self.a)) + np.repeat(before_b, sizes(self.cut_a))] = a_row
        out[np.arange(len(self.b)) + np.repeat(self.cut_a + 1, sizes(self.cut_b))] = b_row
        text = rows[out]
        there = text != 0
        ends = np.r_[0, np.cumsum(there.sum(1))][self.a_at + self.b_at]
        flat = text[there].tobytes()
        return [flat[s:e].rstrip(b";") for s, e in zip(ends, ends[1:])]

    def links(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's (pairs, counts): a's id times b's vocabulary plus b's id, of the tokens that end together."""
        doc = np.repeat(np.arange(len(self.a_at) - 1), np.diff(self.cut_at))
        key, n = np.unique(doc << 32 | self.a[self.cut_a] * self.n_b + self.b[self.cut_b], return_counts=True)
        at = np.searchsorted(key >> 32, np.arange(len(self.a_at)))
        pairs = key & 0xFFFFFFFF
        return [(pairs[s:e], n[s:e]) for s, e in zip(at, at[1:])]


_spelling: dict[tuple, np.ndarray] = {}


def _decimals(n_a: int, n_b: int) -> np.ndarray:
    """Rows of bytes, filled up with zeros: ids of a with a comma, with a bar, ids of b with a comma, with a semicolon."""
    if (n_a, n_b) not in _spelling:
        words = [f"{i}{mark}".encode() for n, mark in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]
        width = max(map(len, words))
        _spelling[n_a, n_b] = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return _spelling[n_a, n_b]


# ---- on Spark ---------------------------------------------------------------------------------------------------


def _aligned(docs: DataFrame, a_path: str, b_path: str, make, schema: str) -> DataFrame:
    """make(ids of the documents, Aligned) gives the columns of schema for a list of documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ensure_on_workers(docs.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for rows in small_batches(batches, ("doc_id", "text"), 1_000_000):
            cols = make([i for i, _ in rows], Aligned([t for _, t in rows], a_path, b_path))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a, b, a_cuts, b_cuts): a document's ids by both tokenizers; group k ends before place a_cuts[k] of a and b_cuts[k] of b.

    a is a byte-level vocabulary over a space and the text, b a sentencepiece model over the text. Null and empty texts, and
    those that either's tokens don't give back byte by byte, have no tokens. Marks of added tokens are plain text. Rows stay
    as they are, repeated ones too; other columns are left out; an empty table gives an empty one. Texts of any length are
    taken whole, one text's tokens at a time in memory at least.
    """

    def make(ids, x):
        cut = lambda v, at: [v[s:e] for s, e in zip(at, at[1:])]
        ends = lambda c, at: [c[s:e] + 1 - base for s, e, base in zip(x.cut_at, x.cut_at[1:], at)]
        return ids, cut(x.a, x.a_at), cut(x.b, x.b_at), ends(x.cut_a, x.a_at), ends(x.cut_b, x.b_at)

    return _aligned(docs, a_path, b_path, make, "doc_id long, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>")


def _packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    return zlib.compress(np.diff(pairs, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
    return np.cumsum(x[: len(x) // 2]), x[len(x) // 2 :]


def link_tables(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of each document, as a written table; links are its packed id pairs with counts."""

    def make(ids, x):
        links = x.links()
        groups, n_a, n_b = np.diff(x.cut_at), np.diff(x.a_at), np.diff(x.b_at)
        sha = [hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(x.spelled(), groups)]
        return ids, n_a, n_b, groups, [int(n.sum()) for _, n in links], sha, [_packed(*k) for k in links]

    found = _aligned(docs, a_path, b_path, make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "links")


def pair_counts(links: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(pair, n): how many links hold each id pair. Tasks add up what they see, and hand it on whenever it has grown to `most` pairs."""

    def run(batches):
        import pyarrow as pa

        def merged(parts):
            p, n = (np.concatenate(x) for x in zip(*parts))
            pairs, at = np.unique(p, return_inverse=True)
            return pairs, np.bincount(at, n, len(pairs)).astype(np.int64)

        held, size = [], 0
        for b in batches:
            for raw in b.column(0):
                held.append(_unpacked(raw.as_py()))
                size += len(held[-1][0])
                if size >= 2 * most:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "n"])
                        held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score_links(links: DataFrame, n_b: int, slice_: int = SLICE) -> DataFrame:
    """(row, n_best, count_sum): links whose pair is as frequent as any of its b id, and the sum of the pairs' counts.

    The table of counted pairs is bounded by the two vocabularies, not by the corpus. It is broadcast in slices of about
    slice_ pairs; each slice is a pass over the packed links, so no table is too large.
    """
    spark = links.sparkSession
    counts = materialize(pair_counts(links).withColumn("b", F.col("pair") % n_b), "pair-counts")
    top = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("top")))  # a row for each id of b's vocabulary at most
    slices = max(1, math.ceil(counts.count() / slice_))
    table = counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"), F.pmod(F.xxhash64("pair"), F.lit(slices)).alias("slice"))
    table = materialize(table, "pair-table")
    sent, passes = [], []
    for k in range(slices):
        t = table.where(F.col("slice") == k).select("pair", "n", "best").toArrow()
        pair = t["pair"].to_numpy()
        order = np.argsort(pair)
        sent.append(spark.sparkContext.broadcast((pair[order].astype(np.uint32), t["n"].to_numpy()[order], t["best"].to_numpy()[order])))
        passes.append(materialize(_probed(links, sent[-1]), "scores"))
        sent[-1].unpersist()
    return reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _probed(links: DataFrame, table) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        known, count, best = table.value
        for b in batches:
            sums = []
            for raw in b.column(1):
                pairs, n = _unpacked(raw.as_py())
                at = np.minimum(np.searchsorted(known, pairs.astype(np.uint32)), max(0, len(known) - 1))
                here = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                sums.append((int(n[here & best[at]].sum()), int((n * count[at])[here].sum())) if len(pairs) and len(known) else (0, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in sums], pa.int64()), pa.array([y for _, y in sums], pa.int64())], names=["row", "n_best", "count_sum"])

    return links.select("row", "links").mapInArrow(run, "row long, n_best long, count_sum long")


def op11(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    links = link_tables(docs, a, b)
    scores = score_links(links, len(piece_model(b).bytes))
    return links.join(scores, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
