"""Queries of problem 2 over docs, and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.neardup import NearDuplicates, Shingling, expanded, near_duplicates
from termforge.plans.tables import read_table


def _docs(spark: SparkSession, folder: str, shingling: Shingling) -> NearDuplicates:
    return near_duplicates(read_table(spark, folder, "docs", "docid", "title", "body", "loaded_at"), "docid", ["title", "body"], "loaded_at", shingling)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _docs(spark, folder, Shingling(words=3, least_words=20, threshold=Fraction(6, 10)))
    return expanded(found).select(F.col("record_a").alias("docid_a"), F.col("record_b").alias("docid_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with enough words: its class of equal sets and the number of other classes within five-word similarity 0.8."""
    found = _docs(spark, folder, Shingling(words=5, least_words=20, threshold=Fraction(8, 10)))
    ends = found.links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    # a class is named by its first document
    named = found.members.join(found.members.groupBy("class").agg(F.min("record").alias("class_docid")), "class")
    return named.join(ends, "class", "left").select(F.col("record").alias("docid"), "class_docid", F.coalesce("links", F.lit(0)).alias("links"))


_SETS = r"""rows_ as (select docid, arg_max(coalesce(title, '') || chr(10) || coalesce(body, ''), loaded_at) as text from docs where docid is not null group by docid),
words_ as (select docid, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) as w from rows_),
grams as (select docid, unnest(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: hash(array_to_string(w[i:i + {n} - 1], ' '))))) as g from words_ where len(w) >= 20),
sizes as (select docid, count(*) as size, sum(g::hugeint) as sum_, bit_xor(g) as xor_ from grams group by docid),
common as (select a.docid as a, b.docid as b, count(*) as common from grams a join grams b on a.g = b.g and a.docid < b.docid group by all),
pairs as (select a, b from common join sizes x on a = x.docid join sizes y on b = y.docid where 10 * common >= {t} * (x.size + y.size - common))"""

QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLE = {
    "p2_found": f"with {_SETS.format(n=3, t=6)} select a as docid_a, b as docid_b from pairs",
    "p2_groups": f"""with {_SETS.format(n=5, t=8)},
classes as (select docid, min(docid) over (partition by size, sum_, xor_) as class_docid from sizes),
links as (select least(x.class_docid, y.class_docid) as a, greatest(x.class_docid, y.class_docid) as b from pairs join classes x on a = x.docid join classes y on b = y.docid where x.class_docid <> y.class_docid group by all),
ends as (select class_docid, count(*) as links from (select a as class_docid from links union all select b from links) group by all)
select docid, class_docid, coalesce(links, 0) as links from classes left join ends using (class_docid)""",
}
