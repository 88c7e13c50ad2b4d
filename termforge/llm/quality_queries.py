"""Queries of problem 1 over docs and feature_schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.quality import COMMON, classified, learned_rules, measures, name_rules, odd_names, statistics
from termforge.plans.tables import cut, one_row_per_key, read_table


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    docs = one_row_per_key(read_table(spark, folder, "docs", "docid", "loaded_at", "body"), ["docid"], ["loaded_at"])
    stats = cut(statistics(docs, "docid", "body"), "statistics")
    return classified(stats, learned_rules(stats, read_table(spark, folder, "body_labels"), "docid", "body_kind"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bodies = _kinds(spark, folder).where("kind <> 'prose'").select(F.lit("body").alias("field_name"), F.col("record").alias("record_id"))
    schema = read_table(spark, folder, "feature_schema", "schema_id", "column_index", "feature_name")
    names = odd_names(schema, ["schema_id", "column_index"], "feature_name", name_rules(schema, "schema_id", "feature_name"))
    return bodies.unionByName(names.select(F.lit("feature_name").alias("field_name"), F.concat_ws("/", "schema_id", "column_index").alias("record_id")).distinct())


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of every document's main part."""
    return _kinds(spark, folder).select(F.col("record").alias("docid"), "kind")


def p1_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The measures that feature schemas name, over the whole body of every docid."""
    docs = one_row_per_key(read_table(spark, folder, "docs", "docid", "loaded_at", "body"), ["docid"], ["loaded_at"])
    found = measures(docs, "docid", "body")
    return found.select(F.col("record").alias("docid"), *[F.round(c, 6).alias(c) if c != "doc_word_count" else F.col(c) for c in found.columns[1:]])


_COMMON = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON)) + "]"
QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds, "p1_measures": p1_measures}
ORACLE = {
    "p1_measures": rf"""with texts as (select docid, coalesce(arg_max(body, loaded_at), max(body), '') as t from docs where docid is not null group by docid),
parts as (select docid, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') as w,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') as l from texts)
select docid, len(w) as doc_word_count,
  coalesce(round(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 6), 0)::double as doc_mean_word_length,
  coalesce(round(length(regexp_replace(t, '[\p{{L}}\p{{N}}\s\x0b]+', '', 'g')) / nullif(length(t), 0), 6), 0)::double as doc_symbol_ratio,
  coalesce(round(len(list_filter(l, lambda x: contains('.!?。…”"’»:', right(x, 1)))) / nullif(len(l), 0), 6), 0)::double as doc_terminal_line_ratio,
  coalesce(round(len(list_filter(w, lambda x: list_contains({_COMMON}, x))) / nullif(len(w), 0), 6), 0)::double as doc_common_word_ratio
from parts""",
}
