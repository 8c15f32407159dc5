"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept; between stages the documents are written as Parquet and read again, so a
lost executor costs one stage's tasks at most. Null ids, languages and sources are values like others, rows that share an
id are rows of their own, columns besides those of COLUMNS are left out, very long texts are taken whole, and an empty table
gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import mixing, packing, pii, quality, shingle_join
from corpuslens.session import discard, ensure_on_workers, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. A null, empty or blank text breaks one (it is too short)."""
    return quality.quality_rules(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles by links: the one with the smallest id (null last).

    Rows equal in id and text are one document; texts that share an id are documents of their own. Documents without words
    have no shingles and stay.
    """
    ensure_on_workers(spark)
    return shingle_join.near_duplicates_removed(docs, n=5, num=80, den=100).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data; the key is the session's (spark.corpuslens.pii.key). A null text stays null."""
    ensure_on_workers(spark)
    return pii.pseudonymize(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources have their weights, in the order of the mix's schedule. Texts without words are left out."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it. A null or empty text is one piece of the end id alone."""
    ensure_on_workers(spark)
    return packing.op10(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizing, pseudonyms and the shingle join can't be said in SQL; tests hold the stages and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # written anew: nothing reads it any more (the given table isn't ours and stays)
    return STAGES[-1][1](spark, docs, sf_dir)
