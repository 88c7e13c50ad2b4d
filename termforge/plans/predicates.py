"""Features against thresholds as conditions on an index: the forms that need no score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least(ratio: float | None, count: float | None, terms: Column) -> Column:
    """How many of a query's distinct terms must match for a match ratio or count above a border: floor(terms * ratio) + 1 or floor(count) + 1, within 1 and all terms."""
    if (ratio is None) == (count is None):
        raise ValueError("give either a ratio or a count")
    need = F.floor(terms * F.lit(float(ratio))) + 1 if ratio is not None else F.lit(math.floor(count) + 1)
    return F.greatest(F.lit(1), F.least(terms, need))


def matches_terms(query_tokens: str, tokens: str, ratio: float | None = None, count: float | None = None) -> Column:
    """Whether enough distinct query terms stand in the tokens; never for a query without terms. Clamped as above, so extreme borders differ from the plain comparison."""
    terms = F.size(F.array_distinct(F.col(query_tokens)))
    return (terms > 0) & (F.size(F.array_intersect(F.array_distinct(query_tokens), F.col(tokens))) >= at_least(ratio, count, terms))


def any_ngram(*counts: Column) -> Column:
    """Whether any of the query's n-grams of the counted lengths stands in the document, whatever the border."""
    return F.greatest(*counts) > 0 if len(counts) > 1 else counts[0] > 0


def any_window(count: Column) -> Column:
    """Whether any two different query terms stand near each other, whatever the border."""
    return count > 0


def with_any_term(rows: DataFrame, postings: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of documents that hold one of a query's terms, by a semi-join with the postings of those terms (the filter reaches the scan of the table, which is clustered by term)."""
    return rows.join(postings.where(F.col("term").isin(terms)).select("doc_id"), "doc_id", "left_semi")
