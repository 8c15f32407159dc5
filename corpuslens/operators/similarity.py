"""Near-duplicate pairs of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import ensure_on_workers, materialize


def sign_bits(vector: Column) -> Column:
    """Bit i set when component i is positive, as one long (64 components)."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.when(i == 63, F.lit(-(2**63))).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


#: Beyond this distance bands are shorter than 8 bits, and blocks are compared instead.
BANDED = 7
#: Hashes of a block; a task holds two blocks and a strip of their distances.
BLOCK = 8192


def near_duplicates(hashes: DataFrame, max_distance: int = 7, key: str = "id", value: str = "hash", block: int = BLOCK) -> DataFrame:
    """(a, b, distance), a < b: pairs whose 64-bit hashes differ in at most max_distance bits. Rows without a hash meet nothing.

    Equal hashes are collapsed before and given back as pairs with the smallest id of their value, never all with all. Up to
    a distance of 7 different hashes are cut into max_distance + 1 bands, of which a pair must share one, so none is missed.
    Bands of fewer bits would propose more pairs than there are; beyond 7 every pair of blocks of packed hashes is compared
    once, inside a task, which gives only the near pairs. That work grows with the square of the different hashes.
    """
    cls = hashes.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.min(key).alias("id"))
    pairs = _by_bands(cls, max_distance) if max_distance <= BANDED else _by_blocks(cls, max_distance, block)
    low = cls.select(F.col("id").alias("_low"), "h")
    same = hashes.join(low, F.col(value) == F.col("h")).where(F.col(key) > F.col("_low")).select(F.col("_low").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(same)


def _by_bands(cls: DataFrame, most: int) -> DataFrame:
    n = most + 1
    cuts = [64 * i // n for i in range(n + 1)]
    band = lambda i: F.shiftrightunsigned("h", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1 if cuts[i + 1] - cuts[i] < 64 else -1))
    bands = cls.select("id", "h", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), band(i).alias("v")) for i in range(n)))).alias("x")).select("id", "h", "x.k", "x.v")
    a, b = bands.alias("a"), bands.alias("b")
    d = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    near = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") < F.col("b.id"))).where(d <= most)
    return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance")).distinct()


def _by_blocks(cls: DataFrame, most: int, block: int) -> DataFrame:
    spark = cls.sparkSession
    ensure_on_workers(spark)
    cls = materialize(cls, "hashes")
    n = max(1, -(-cls.count() // block))
    dealt = cls.groupBy((F.pmod(F.xxhash64("h"), F.lit(n))).alias("k")).agg(F.collect_list(F.struct("id", "h")).alias("x"))
    packed = materialize(dealt.select("k", F.col("x.id").alias("ids"), F.col("x.h").alias("hs")), "hash-blocks")
    # the pairs of blocks i <= j, numbered 0 to n (n + 1) / 2
    i = F.floor((2 * n + 1 - F.sqrt(F.lit(float((2 * n + 1) ** 2)) - 8 * F.col("id"))) / 2).cast("long")
    first = lambda c: c * (2 * n + 1 - c) / 2
    i = i - F.when(first(i) > F.col("id"), 1).when(first(i + 1) <= F.col("id"), -1).otherwise(0)
    pairs = spark.range(n * (n + 1) // 2).select(i.alias("i"), "id").select("i", (F.col("i") + F.col("id") - first(F.col("i"))).cast("long").alias("j"))
    left, right = (packed.select(F.col("k").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("hs").alias(f"hs_{s}")) for s in "ij")
    met = pairs.join(left, "i").join(right, "j").select("i", "j", "ids_i", "hs_i", "ids_j", "hs_j")
    kind = dict(cls.dtypes)["id"]

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                same = b.column(0)[r].as_py() == b.column(1)[r].as_py()
                ids = [b.column(c)[r].values for c in (2, 4)]
                x, y = (b.column(c)[r].values.to_numpy().view(np.uint64) for c in (3, 5))
                for s in range(0, len(x), 512):
                    d = np.bitwise_count(x[s : s + 512, None] ^ y[None, :])
                    near = d <= most
                    if same:  # each pair once
                        near &= np.arange(s, s + len(d))[:, None] < np.arange(len(y))[None, :]
                    p, q = np.nonzero(near)
                    if len(p):
                        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(p + s)), ids[1].take(pa.array(q)), pa.array(d[p, q].astype("int32"))], names=["p", "q", "distance"])

    near = met.mapInArrow(compare, f"p {kind}, q {kind}, distance int")
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")
