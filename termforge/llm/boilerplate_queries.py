"""Queries of problem 3 over docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.boilerplate import articles, furniture_lines
from termforge.plans.tables import one_row_per_key, read_table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every docid."""
    return one_row_per_key(read_table(spark, folder, "docs", "docid", "title", "body", "site", "loaded_at"), ["docid"], ["loaded_at"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return furniture_lines(_pages(spark, folder), "docid", "body", "title", "site").select(F.col("record").alias("docid"), "line_no")


def p3_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The main part of every page, one row per docid."""
    return articles(_pages(spark, folder), "docid", "body", "title", "site").select(F.col("record").alias("docid"), "article")


QUERIES = {"p3_found": p3_found, "p3_articles": p3_articles}
ORACLE: dict[str, str] = {}
