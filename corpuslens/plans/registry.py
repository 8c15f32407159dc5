"""Every registered query with its SQL twin, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import profile
from corpuslens.session import table

#: Modules of this package that hold QUERIES (name -> function) and ORACLE (name -> SQL).
MODULES: list[str] = ["profiling", "usage", "corpus", "media", "audio", "pictures", "streams", "records", "formats", "values"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return profile.quality_report(customer.select(*(F.col(c).cast("string").alias(c) for c in customer.columns)), "customer")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"corpuslens.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"corpuslens.plans.{m}").ORACLE.items()}
