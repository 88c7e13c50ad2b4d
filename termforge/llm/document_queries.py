"""Queries of problems 7 and 8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.byte_bpe import token_ids
from termforge.llm.leakage import leak_report, leaks
from termforge.plans.tables import read_table


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("record", "doc_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", read_table(spark, folder, "benchmark", "item_id", "text"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "run_words")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(p8_leaks(spark, folder).withColumnRenamed("item_id", "item")).withColumnRenamed("item", "item_id")


_RUNS = r"""doc_words as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents where text is not null),
item_words as (select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from benchmark where text is not null),
doc_runs as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: hash(array_to_string(w[i:i + 11], ' ')))) as run from doc_words where len(w) >= 12),
item_runs as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: hash(array_to_string(w[i:i + 11], ' ')))) as run from item_words where len(w) >= 12)"""

_PLACES = """places as (select doc_id, i, hash(array_to_string(w[i:i + 11], ' ')) as run from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from doc_words where len(w) >= 12)),
item_places as (select item_id, j, hash(array_to_string(w[j:j + 11], ' ')) as run from (select item_id, w, unnest(range(1, len(w) - 10)) as j from item_words where len(w) >= 12)),
hits as (select distinct doc_id, item_id, i, i - j as shift from places join item_places using (run)),
islands as (select doc_id, item_id, count(*) + 11 as n from (select *, i - row_number() over (partition by doc_id, item_id, shift order by i) as island from hits) group by doc_id, item_id, shift, island),
leaks as (select doc_id, item_id, max(n) as run_words from islands group by doc_id, item_id)"""

QUERIES = {"p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}
_WORDS_SQL = ",\n".join(_RUNS.split(",\n")[:2])
ORACLE = {
    "p8_found": f"with {_RUNS} select distinct doc_id, item_id from doc_runs join item_runs using (run)",
    "p8_leaks": f"with {_WORDS_SQL}, {_PLACES} select doc_id, item_id, run_words from leaks",
    "p8_items": f"with {_WORDS_SQL}, {_PLACES} select item_id, count(*) as documents, max(run_words) as longest_run from leaks group by item_id",
}
