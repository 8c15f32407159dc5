"""The findings table and its search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.session import materialize

FINDINGS = ("source", "section", "grp", "field", "value")


def to_findings(df: DataFrame, source: str, section: str, grp: str | Column, fields: list[str] | None = None) -> DataFrame:
    """Long form of an operator's result: one (source, section, grp, field, value) row per column and row; nulls left out."""
    g = F.lit(grp) if isinstance(grp, str) else grp
    fields = fields or df.columns
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields))
    return df.select(F.lit(source).alias("source"), F.lit(section).alias("section"), g.cast("string").alias("grp"), F.explode(rows).alias("x")).select("source", "section", "grp", "x.field", "x.value").where("value is not null")


def expand(query: str, synonyms: dict[str, list[str]] | None = None) -> list[str]:
    """The lower-case query and its synonyms, looked up without spaces."""
    q = query.strip().lower()
    return list(dict.fromkeys([q, *(w.lower() for w in (synonyms or {}).get(q.replace(" ", ""), []))])) if q else []


def search(findings: DataFrame, query: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows that hold any term in field or value; where a section has none, all its rows if its name or group does."""
    terms = expand(query, synonyms)
    hit = lambda text: F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)), F.lit(False)) if terms else F.lit(False)
    row, whole = hit(F.concat_ws(" ", "field", "value")), hit(F.concat_ws(" ", "section", "grp"))
    w = W.partitionBy("source", "section")
    f = findings.withColumns({"_row": row, "_whole": whole}).withColumn("_any", F.max("_row").over(w))
    return f.where("_row or (not _any and _whole)").select(*findings.columns, F.when(F.col("_row"), "row").otherwise("section").alias("matched"))


def search_texts(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, hits): texts that hold any term, with the number of places."""
    terms = expand(query, synonyms)
    low = F.lower(F.col(text))
    n = sum(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0))
    return docs.select(key, n.cast("long").alias("hits")).where("hits > 0")


def search_catalog(catalog: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Catalogue rows whose label, tags or an extension holds the query (an extension may be given with its dot)."""
    q = query.strip().lower()
    ext = q.removeprefix(".")
    hit = F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower(F.coalesce("tags", F.lit(""))), F.lit(q)) | F.exists("exts", lambda e: F.contains(F.lower(e), F.lit(ext)))
    rows = catalog.where(hit) if q else catalog
    return rows.where(F.col("cat") == category) if category else rows


def number_matches(hits: DataFrame, order: list[str]) -> DataFrame:
    """hits with match, their number in this order: ranked within ranges, which start at the rows counted before them."""
    dealt = hits.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "hits")  # ranges are drawn from a sample: the counts must be those of the same deal
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    ranked = dealt.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    return ranked.select(*hits.columns, (F.col("_rank") + F.col("_before")).alias("match"))
