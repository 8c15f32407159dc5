"""Joins of many rows with one row per key, whole and even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds this share of all counted rows or more: there are at most 1 / HEAVY such keys.
HEAVY = 1 / 10_000


def join_by_key(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with counted, which has one row a key, its values, and n: how many of rows have the key.

    Heavy keys, of which there are at most 10,000 whatever the input's size, are broadcast, and their rows are dealt evenly
    over all tasks. All others are joined by shuffle, where no key then has more than a ten-thousandth of the rows. counted
    is read three times and should be a written table. Null keys meet nothing. n isn't handed on.
    """
    values = [c for c in counted.columns if c not in (*keys, n)]
    least = max(1.0, (counted.agg(F.sum(n)).first()[0] or 0) * HEAVY)
    heavy = counted.where(F.col(n) >= least).select(*keys, F.struct(F.lit(True).alias("met"), *values).alias("of_heavy"))
    light = counted.where(F.col(n) < least).select(*keys, F.struct(F.lit(True).alias("met"), *values).alias("of_light"), F.lit(0).cast("long").alias("spread"))
    marked = rows.join(F.broadcast(heavy), keys, "left")
    marked = marked.withColumn("spread", F.when(F.col("of_heavy").isNotNull(), 1 + F.monotonically_increasing_id()).otherwise(0))
    met = marked.join(light, [*keys, "spread"], "left").withColumn("of_key", F.coalesce("of_heavy", "of_light"))
    met = met.where(F.col("of_key").isNotNull()) if how == "inner" else met
    return met.select(*rows.columns, *(F.col("of_key").getField(c).alias(c) for c in values))
