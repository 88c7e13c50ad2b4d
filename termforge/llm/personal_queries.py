"""Queries of problem 9 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.personal import Names, known_names, masked_texts, personal_spans
from termforge.plans.tables import read_table


#: The kinds that the query reports; payment cards and accounts are masked, but are no identity numbers.
KINDS = ("email", "phone", "id_number", "address", "name")


def _names(spark: SparkSession, folder: str) -> tuple[DataFrame, Names]:
    texts = read_table(spark, folder, "documents", "doc_id", "text")
    return texts, known_names(texts, "text", read_table(spark, folder, "name_parts", "name_part", "part_kind"), "name_part", "part_kind")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    texts, names = _names(spark, folder)
    return personal_spans(texts, "doc_id", "text", names).where(F.col("kind").isin(*KINDS)).withColumnRenamed("record", "doc_id")


def p9_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders."""
    texts, names = _names(spark, folder)
    return masked_texts(texts, "doc_id", "text", names).withColumnRenamed("record", "doc_id")


QUERIES = {"p9_found": p9_found, "p9_masked": p9_masked}
ORACLE: dict[str, str] = {}
