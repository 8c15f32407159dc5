"""Best-fit packing: best-fit decreasing with a segment tree over the open bins' remaining capacities."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tokens import encoder, small_batches
from corpuslens.session import materialize

#: Pieces that one task packs together (about). Tens of thousands fill all but a handful of its bins.
GROUP = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open bins by remaining capacity; a segment tree of counts finds the tightest that fits in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.made = capacity, 1 << capacity.bit_length(), 0
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, left: int, by: int) -> None:
        i = left + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def _tightest(self, need: int) -> int:
        """Least remaining capacity of an open bin that is at least need, else -1."""
        tree, i = self.tree, need + self.leaves
        while not tree[i]:
            while i & 1:  # the parent's right part lies before need: go up
                i >>= 1
                if not i:
                    return -1
            i += 1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.leaves

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this length."""
        left = self._tightest(length)
        if left < 0:
            bin_, left = self.made, self.capacity
            self.made += 1
        else:
            bin_ = self.open[left].pop()
            self._change(left, -1)
        if left > length:
            self.open[left - length].append(bin_)
            self._change(left - length, 1)
        return bin_, self.capacity - left


def pack_lengths(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, offsets) of pieces given longest first."""
    b = Bins(capacity)
    out = [b.put(int(n)) for n in lengths]
    return np.array([x[0] for x in out], "int64"), np.array([x[1] for x in out], "int64")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """One row per piece of docs(doc_id, text): ids plus end id, cut every `capacity` ids only where longer.

    A null or empty text is one piece of the end id alone (none where there is no end id). Null and repeated ids are kept
    as they are, each row by itself. Other columns are ignored.
    """

    def cut(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for rows in small_batches(batches, ("doc_id", "text")):
            out = []
            for (doc, _), raw in zip(rows, enc.ids([t for _, t in rows])):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    x = ids[a : a + capacity]
                    out.append((doc, k, a, len(x), zlib.crc32(x.tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """pieces plus sequence_id and offset.

    Pieces are dealt evenly over ceil(n / group) groups, whatever document they come from, and each group is packed
    alone, longest first (ties by doc_id, piece). Only lengths and ids of a group are in a task's memory. Pieces of no
    length take no room; an empty table gives an empty result.
    """
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))

    def pack(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, at = pack_lengths(pdf["length"], capacity)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=at).drop(columns="g")

    dealt = pieces.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack, PIECES + ", sequence_id long, offset long")


def op10(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return best_fit(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
