"""Queries of problems 5 and 6 over the corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.distinctive import PLAIN, Weighting, distinctive_terms, distinctive_values
from termforge.llm.frequency import marked, text_term_counts, value_pairs, value_term_counts
from termforge.plans.tables import newest_per_key, one_row_per_key, read_table


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    return one_row_per_key(read_table(spark, folder, "docs", "docid", "loaded_at", "body"), ["docid"], ["loaded_at"])


def schema_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "feature_schema", "schema_id", "column_index", "feature_name", "exported_at")
    return value_pairs(newest_per_key(rows, ["schema_id", "column_index"], ["exported_at"]), "schema_id", "feature_name")


def model_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "linear_monomials", "model_id", "monomial_no", "split_no", "feature_name", "trained_at")
    return value_pairs(newest_per_key(rows, ["model_id", "monomial_no", "split_no"], ["trained_at"]), "model_id", "feature_name")


def _field(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("field_name"), "*")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    text = distinctive_terms(bodies(spark, folder), "docid", "body", PLAIN)
    values = distinctive_values(schema_names(spark, folder), PLAIN)
    return _field("body", text).unionByName(_field("feature_name", values)).select("field_name", F.col("record").alias("record_id"), "term")


def p5_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The three best terms of each record by the saturating, length-normalised weight."""
    text = distinctive_terms(bodies(spark, folder), "docid", "body", Weighting(), top=3)
    values = distinctive_values(schema_names(spark, folder), Weighting(), top=3)
    return _field("body", text).unionByName(_field("feature_name", values)).select("field_name", F.col("record").alias("record_id"), F.col("place").cast("bigint").alias("place"), "term")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of both collections with its counts and mark."""
    text = marked(text_term_counts(bodies(spark, folder), "body"), 40)
    values = marked(value_term_counts(model_names(spark, folder)), 60)
    return _field("body", text).unionByName(_field("feature_name", values))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_counts(spark, folder).where("mark is not null").select("field_name", "term", "mark")


_BODY = r"""body_rows as (select docid as record, max(body) as body from docs where docid is not null group by docid),
body_tokens as (select record, unnest(regexp_extract_all(body, '[A-Za-z]{3,}')) as token from body_rows),
body_terms as (select record, lower(token) as term, count(*) as n from body_tokens group by all)"""
_VALUES = r"""name_rows as (select {record} as record, {keys}, max(feature_name) as v from {table} group by all),
name_terms as (select record, lower(trim(v, E' \t')) as term, count(*) as n from name_rows where v is not null and trim(v, E' \t') <> '' group by all)"""
_SCHEMA = _VALUES.format(record="schema_id", keys="column_index", table="feature_schema")
_MODEL = _VALUES.format(record="model_id", keys="monomial_no, split_no", table="linear_monomials")

ORACLE = {
    "p5_found": f"""with {_BODY}, {_SCHEMA},
terms as (select 'body' as field_name, * from body_terms union all select 'feature_name', * from name_terms),
totals as (select field_name, count(distinct record) as total from terms group by all),
dfs as (select field_name, term, count(*) as df from terms group by all),
scored as (select t.field_name, t.record, t.term, round(t.n * ln(total / df), 6) as score
  from terms t join dfs using (field_name, term) join totals using (field_name) where df >= 2)
select field_name, record as record_id, term from (select *, row_number() over (partition by field_name, record order by score desc, term) as place
  from scored where score > 0) where place = 1""",
    "p5_bm25": f"""with {_BODY}, {_SCHEMA},
terms as (select 'body' as field_name, * from body_terms union all select 'feature_name', * from name_terms),
lengths as (select field_name, record, sum(n) as length from terms group by all),
totals as (select field_name, count(*) as total, avg(length) as average from lengths group by all),
dfs as (select field_name, term, count(*) as df from terms group by all),
scored as (select t.field_name, t.record, t.term, round(ln(1 + (total - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / average)), 6) as score
  from terms t join dfs using (field_name, term) join totals using (field_name) join lengths using (field_name, record) where df >= 2)
select field_name, record as record_id, place, term from (select *, row_number() over (partition by field_name, record order by score desc, term) as place
  from scored where score > 0) where place <= 3""",
    "p6_counts": f"""with {_BODY}, {_MODEL},
terms as (select 'body' as field_name, * from body_terms union all select 'feature_name', * from name_terms),
totals as (select field_name, count(distinct record) as total, if(field_name = 'body', 40, 60) as percent from terms group by field_name),
counts as (select field_name, term, sum(n)::bigint as occurrences, count(*) as records from terms group by all)
select field_name, term, occurrences, records, case when 100 * records > percent * total then 'common' when records < 3 then 'rare' end as mark
from counts join totals using (field_name)""",
}
ORACLE["p6_found"] = f"select field_name, term, mark from ({ORACLE['p6_counts']}) where mark is not null"

QUERIES = {"p5_found": p5_found, "p5_bm25": p5_bm25, "p6_counts": p6_counts, "p6_found": p6_found}
