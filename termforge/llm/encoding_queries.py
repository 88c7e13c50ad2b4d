"""Queries of problem 4 over docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.encodings import garbled_fields
from termforge.plans.tables import one_row_per_key, read_table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every docid."""
    return one_row_per_key(read_table(spark, folder, "docs", "docid", "title", "body", "loaded_at"), ["docid"], ["loaded_at"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = garbled_fields(_docs(spark, folder), "docid", ["title", "body"])
    return found.select(F.col("record").alias("docid"), F.col("field").alias("field_name"))


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled fields with the text restored as far as its bytes are known."""
    found = garbled_fields(_docs(spark, folder), "docid", ["title", "body"], restoring=True)
    return found.select(F.col("record").alias("docid"), F.col("field").alias("field_name"), "restored", "complete")


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
ORACLE: dict[str, str] = {}
