"""One query over a stored index: its terms, their statistics and its own features are known while planning, documents come from the postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import model
from termforge.operators.index import Index
from termforge.operators.pair_features import PAIR_FEATURES, features, found_terms, with_hits


@dataclass(frozen=True)
class Query:
    """The tokens of a query; per distinct one by first occurrence (at, term, times, df); the collection's statistics."""

    tokens: tuple[str, ...]
    terms: tuple[tuple[int, str, int, int], ...]
    stats: dict[str, float]


def planned(index: Index, text: str, tokens: Column | None = None) -> Query:
    """Reads the rows of the query's terms (at most as many as it has) and the one row of statistics."""
    spark = index.terms.sparkSession
    own = spark.createDataFrame([(text,)], "query string").select((tokens if tokens is not None else T.whitespace_tokens("query")).alias("t")).first()["t"]
    first = {t: i for i, t in reversed(list(enumerate(own)))}
    df = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(sorted(first))).collect()} if first else {}
    return Query(tuple(own), tuple((at, t, own.count(t), df.get(t, 0)) for t, at in sorted(first.items(), key=lambda x: x[1])), index.stats.first().asDict())


def matching(index: Index, query: Query) -> DataFrame:
    """``doc_id, found, coded_length`` of the documents with a term of the query; the filter reaches the scan of the postings, which are clustered by term."""
    asked = index.postings.sparkSession.createDataFrame(list(query.terms), "at int, term string, qtf int, df long")
    there = index.postings.where(F.col("term").isin([t for _, t, _, _ in query.terms])) if query.terms else index.postings.limit(0)
    return found_terms(there.join(F.broadcast(asked), "term"), "doc_id")  # one row per term of one query


def search_rows(index: Index, query: Query, names: tuple[str, ...] = PAIR_FEATURES, every: bool = True) -> DataFrame:
    """The index's documents with the named features of the query: all documents, or (``every=False``) those with a term of it, in the body or, if a
    feature of the title is named, in the title."""
    titles = any(n.startswith("Title") for n in names)
    words = F.array(*[F.lit(t) for t in query.tokens]).cast("array<string>")
    rows = index.docs.drop("coded_length").join(matching(index, query), "doc_id", "left" if every or titles else "inner").withColumn("title_tokens", T.whitespace_tokens("title"))
    if titles and not every:
        rows = rows.where(F.col("found").isNotNull() | F.arrays_overlap("title_tokens", words))
    grams = {n: [" ".join(query.tokens[i : i + n]) for i in range(len(query.tokens) - n + 1)] for n in (2, 3)}
    known = {"q_tokens": words} | {f"q_grams{n}": F.array(*[F.lit(g) for g in dict.fromkeys(gs)]).cast("array<string>") for n, gs in grams.items()}
    known |= {c: F.lit(query.stats[c]).cast(t) for c, t in (("num_docs", "bigint"), ("doc_count", "bigint"), ("average_length", "float"))}
    found = features()
    return with_hits(rows).withColumns(known).select(*index.docs.drop("coded_length").columns, *[found[n].cast("float").alias(n) for n in names])


def needs_a_term(m: model.Model, threshold: float, constants: dict[str, float] | None = None) -> bool:
    """Whether no document without a term of the query, in body or title, can score above the threshold: the intercept does not, and each positive
    conjunction asks for more than 0 of a feature that such a document has 0 of (or is false by the query's own features)."""
    if threshold < m.intercept:
        return False
    constants = constants or {}

    def impossible(s: model.Split) -> bool:
        return s.feature in PAIR_FEATURES and not 0.0 > s.border or s.feature in constants and not constants[s.feature] > s.border

    return all(any(map(impossible, x.splits)) for x in m.monomials if x.coefficient > 0)


def feature_search(index: Index, query: Query, feature: str, comparison: str, border: float) -> DataFrame:
    """``doc_id`` and the value of the documents whose feature of the query compares with the border. If 0 fails the comparison, documents without a
    term of the query are not looked at."""
    zero = {"GT": 0.0 > border, "LT": 0.0 < border, "GE": 0.0 >= border, "LE": 0.0 <= border}[comparison]
    rows = search_rows(index, query, (feature,), every=zero)
    return rows.where(model.compare(F.col(feature), comparison, border)).select("doc_id", F.col(feature).alias("value"))
