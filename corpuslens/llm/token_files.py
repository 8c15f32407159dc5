"""Token files: ids of every document, zstandard-compressed one by one with a shared dictionary.

A token folder holds two Parquet tables, so any store that Spark writes to will do. `dictionary` has one row: the
dictionary, its sha256, the id width and the tokenizer's name. `shards` has one row per run of consecutive documents:
`frames` (the documents' zstandard frames end to end) and the offset index doc_ids / counts / ends, so that one short
document is read by its offsets without touching its neighbours, and `dict_sha256`, which a reader checks.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.tokens import encoder, small_batches
from corpuslens.session import shared_dir

#: The dictionary is trained on about SAMPLE documents, picked by a hash, of each SAMPLE_CHARS characters at most.
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 1000, 8192, 65536
SHARD_DOCS, SHARD_BYTES, LEVEL = 2048, 4 << 20, 3
SHARD_SCHEMA = "part int, shard int, n_docs int, n_ids long, first_id long, last_id long, dict_sha256 string, doc_ids array<long>, counts array<int>, ends array<long>, frames binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> bytes:
    """Dictionary from the ids of a bounded sample: of documents picked by a hash a stretch each, whose place a hash picks too.

    Where the sample is too small to train one, its ids themselves are the dictionary; only a table without rows has none.
    """
    import zstandard

    step = max(1, docs.count() // SAMPLE)
    h = F.xxhash64("doc_id", "text")
    at = F.pmod(F.xxhash64(h), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    picked = docs.where(F.pmod(h, F.lit(step)) == 0).limit(2 * SAMPLE)
    texts = [r[0] for r in picked.select(F.substring(F.coalesce("text", F.lit("")), F.coalesce(at, F.lit(1)).cast("int"), F.lit(SAMPLE_CHARS))).collect()]
    enc = encoder(tokenizer)
    end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
    samples = [x + end for x in enc.ids(texts)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICT_BYTES:]
        return raw if len(raw) >= 8 else raw.ljust(8, b"\0") if raw else b""


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0) -> None:
    """Encode docs(doc_id, text) in ascending doc_id order (nulls first; equal ids by a hash of the text) into a token folder.

    A null text is written as an empty one; an empty table gives a folder without shards. One range shuffle of the texts (rows
    that share an id may be many tasks); each task encodes and compresses its stretch of documents shard by shard. A very long
    text is a frame like others, in a shard that ends with it. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = train_dictionary(docs, tokenizer, end_id)
    sha = hashlib.sha256(shared).hexdigest()
    width = encoder(tokenizer).dtype.itemsize
    spark.createDataFrame([(bytearray(shared), sha, width, tokenizer.rpartition("/")[2])], "dictionary binary, dict_sha256 string, id_bytes int, tokenizer string").write.parquet(f"{path}/dictionary")

    def shards(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        zc = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        part, no = TaskContext.get().partitionId(), 0
        ids, counts, ends, frames, size = [], [], [], [], 0

        def flush():
            nonlocal no, ids, counts, ends, frames, size
            row = dict(part=part, shard=no, n_docs=len(ids), n_ids=sum(counts), first_id=ids[0], last_id=ids[-1], dict_sha256=sha, doc_ids=ids, counts=counts, ends=ends, frames=b"".join(frames))
            no, ids, counts, ends, frames, size = no + 1, [], [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("frames", pa.binary())])
        for rows in small_batches(batches, ("doc_id", "text")):
            for (doc, _), raw in zip(rows, enc.ids([t for _, t in rows])):
                raw += end
                frame = zc.compress(raw)
                size += len(frame)
                ids.append(doc)
                counts.append(len(raw) // width)
                ends.append(size)
                frames.append(frame)
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield flush()
        if ids:
            yield flush()

    dealt = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    dealt.select("doc_id", "text").mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["dict_sha256"]:
        raise ValueError(f"the dictionary in {path} doesn't match its hash")
    return bytes(row["dictionary"]), row["dict_sha256"], row["id_bytes"]


def _frames(batch, wanted: set | None):
    """(part, shard, no, doc_id, first id's place in the shard, frame) of an Arrow batch of shards."""
    for r in batch.select(["part", "shard", "dict_sha256", "doc_ids", "counts", "ends", "frames"]).to_pylist():
        a = start = 0
        for no, (doc, n, b) in enumerate(zip(r["doc_ids"], r["counts"], r["ends"])):
            if wanted is None or doc in wanted:
                yield r["dict_sha256"], r["part"], r["shard"], no, doc, start, memoryview(r["frames"])[a:b]
            a, start = b, start + n


def _decode(spark: SparkSession, path: str, shards: DataFrame, make, schema: str, wanted: set | None = None) -> DataFrame:
    shared, sha, width = _dictionary(spark, path)

    def run(batches):
        import pyarrow as pa
        import zstandard

        zd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                for used, part, shard, no, doc, start, frame in _frames(batch.slice(i, 1), wanted):
                    if used != sha:
                        raise ValueError("a shard was written with another dictionary")
                    out.append((part, shard, no, doc, start, *make(np.frombuffer(zd.decompress(frame), f"<u{width}"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k else pa.array(list(c), pa.int32()) for k, c in ((n > 2, c) for n, c in enumerate(zip(*out)))], names=[x.split()[0] for x in schema.split(", ")])

    return shards.select("part", "shard", "dict_sha256", "doc_ids", "counts", "ends", "frames").mapInArrow(run, schema)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows with start made global: ids in all earlier parts, then shards. The window without partitions sees one row per written task."""
    n = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = n.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("p"))
    base = n.withColumn("s", before(W.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("s") + F.col("p")).alias("base"))
    return rows.join(base, ["part", "shard"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document; start counts the ids of all documents before it."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    rows = _decode(spark, path, shards, lambda ids: (ids.astype("int32"),), "part int, shard int, no int, doc_id long, start long, ids array<int>")
    return _with_start(spark, path, rows).select("doc_id", "start", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of documents: shards are pruned by their id range, frames are read by offset."""
    wanted = {int(x) for x in doc_ids}
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    near = F.lit(False)
    for x in sorted(wanted):
        near = near | F.lit(x).between(F.col("first_id"), F.col("last_id"))
    rows = _decode(spark, path, shards.where(near), lambda ids: (ids.astype("int32"),), "part int, shard int, no int, doc_id long, start long, ids array<int>", wanted)
    return rows.select("doc_id", "ids")


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; crc32 of its ids as unsigned 32-bit integers."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    rows = _decode(spark, path, shards, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "part int, shard int, no int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/corpuslens-tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest_token_files(spark, path)
