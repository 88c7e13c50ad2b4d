"""The features of a query and a document, for given pairs.

The pairs are joined with the postings of their query's terms, on term and document; so no body is read, and what a pair works
on is a few positions. The same expressions serve one query over an index (``plans.search``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions.scores import B, K1, bm25_idf, bm25_term, ratio_or_zero, tfidf_idf
from termforge.operators.index import postings_of

PAIR_FEATURES = ("BM25Score", "TFIDFScore", "ExactMatchRatio", "ExactMatchCount", "TitleExactMatchRatio", "TitleExactMatchCount", "BigramCount", "TrigramCount", "UnorderedWindow4", "UnorderedWindow8")


def query_terms(queries: DataFrame, terms: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``query_id, q_tokens, q_terms``: tokens in order and, per distinct one by first occurrence, (at, term, qtf, df)."""
    rows = queries.select("query_id", (tokens if tokens is not None else T.whitespace_tokens("query")).alias("q_tokens"))
    each = rows.select("query_id", F.posexplode("q_tokens").alias("at", "term")).groupBy("query_id", "term").agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("qtf"))
    known = each.join(terms.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    listed = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "term", "qtf", "df"))).alias("q_terms"))
    none = F.array().cast("array<struct<at:int,term:string,qtf:int,df:bigint>>")
    return rows.join(listed, "query_id", "left").withColumn("q_terms", F.coalesce(F.col("q_terms"), none))


def hits() -> Column:
    """(position, token) of the document's tokens that the query holds, in order."""
    return F.sort_array(F.flatten(F.transform("found", lambda q: F.transform(q["positions"], lambda i: F.struct(i.alias("i"), q["term"].alias("t"))))))


def bm25(k1: float = K1, b: float = B) -> Column:
    """Sum over the distinct query terms, by first occurrence, in double precision, then float."""
    one = lambda x: bm25_term(x["tf"], x["qtf"], bm25_idf(F.col("doc_count"), x["df"]), F.col("coded_length"), F.col("average_length"), k1, b).cast("double")
    return F.aggregate(F.filter("found", lambda x: x["df"] > 0), F.lit(0.0), lambda a, x: a + one(x)).cast("float")


def tfidf() -> Column:
    """Sum over the query tokens with repeats of tf * idf, then float."""
    return F.aggregate("found", F.lit(0.0), lambda a, x: a + x["qtf"] * x["tf"] * tfidf_idf(F.col("num_docs"), x["df"])).cast("float")


def match_count(of: str) -> Column:
    """Distinct query terms in the body (``found``) or among the tokens of another column."""
    return F.size("found") if of == "found" else F.size(F.array_intersect(F.array_distinct("q_tokens"), F.col(of)))


def match_ratio(of: str) -> Column:
    return ratio_or_zero(match_count(of), F.size(F.array_distinct("q_tokens")))


def grams_at(n: int) -> Column:
    """The n-grams of query terms in the document, in order; null where the tokens after a position are no query terms."""

    def gram(h: Column, k: Column) -> Column:
        after = [F.get("hits", k + j) for j in range(1, n)]
        whole = after[-1]["i"] == h["i"] + (n - 1)  # positions differ, so those between stand there too
        return F.when(whole, F.concat_ws(" ", h["t"], *[x["t"] for x in after]))

    return F.transform("hits", gram)


def ngram_count(n: int) -> Column:
    """Positions of the document whose n-gram is one of the query's distinct n-grams."""
    return F.size(F.filter(grams_at(n), lambda g: F.coalesce(F.array_contains(F.col(f"q_grams{n}"), g), F.lit(False))))


def window_count(reach: int) -> Column:
    """Ordered pairs of positions at most ``reach`` apart with different query terms; 0 unless the query has two terms."""
    near = lambda h, k: F.size(F.filter(F.slice("hits", k + 2, reach), lambda g: (g["i"] <= h["i"] + reach) & (g["t"] != h["t"])))
    return F.when(F.size(F.array_distinct("q_tokens")) < 2, F.lit(0)).otherwise(F.aggregate(F.transform("hits", near), F.lit(0), lambda a, x: a + x))


def features() -> dict[str, Column]:
    return {
        "BM25Score": bm25(),
        "TFIDFScore": tfidf(),
        "ExactMatchRatio": match_ratio("found"),
        "ExactMatchCount": match_count("found"),
        "TitleExactMatchRatio": match_ratio("title_tokens"),
        "TitleExactMatchCount": match_count("title_tokens"),
        "BigramCount": ngram_count(2),
        "TrigramCount": ngram_count(3),
        "UnorderedWindow4": window_count(5),
        "UnorderedWindow8": window_count(9),
    }


_FOUND = "array<struct<at:int,term:string,qtf:int,df:bigint,tf:int,positions:array<int>>>"


def found_terms(rows: DataFrame, *key: str) -> DataFrame:
    """``key``, ``found`` (terms by first occurrence in the query) and ``coded_length`` from rows of one term, pair and posting each."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "term", "qtf", "df", "tf", "positions"))).alias("found"), F.first("coded_length").alias("coded_length"))


def with_hits(rows: DataFrame) -> DataFrame:
    """Rows after an outer join with ``found_terms``: pairs without a term get empty arrays, and all get ``hits``."""
    filled = rows.withColumns({"found": F.coalesce(F.col("found"), F.array().cast(_FOUND)), "coded_length": F.coalesce("coded_length", F.lit(0))})
    return filled.withColumn("hits", hits())


def prepared(pairs: DataFrame, queries: DataFrame, docs: DataFrame, terms: DataFrame, stats: DataFrame, tokens: Column | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Pairs (``query_id, doc_id`` and any other columns) with the arrays and statistics that features work on.

    Pairs whose query or document is unknown are dropped; see ``checked_pairs`` where they must not be. ``stats`` has one row. Without
    ``postings`` those of ``docs`` are worked out.
    """
    known = query_terms(queries, terms, tokens).withColumns({"q_grams2": F.array_distinct(T.ngrams(F.col("q_tokens"), 2)), "q_grams3": F.array_distinct(T.ngrams(F.col("q_tokens"), 3))})
    postings = postings_of(docs) if postings is None else postings
    asked = known.select("query_id", F.explode("q_terms").alias("q")).select("query_id", "q.*")
    met = pairs.select("query_id", "doc_id").distinct().join(asked, "query_id").join(postings.select("term", "doc_id", "tf", "positions", "coded_length"), ["term", "doc_id"])
    texts = docs.select("doc_id", T.whitespace_tokens("title").alias("title_tokens"))
    rows = pairs.join(known, "query_id").join(texts, "doc_id").join(found_terms(met, "query_id", "doc_id"), ["query_id", "doc_id"], "left").crossJoin(F.broadcast(stats))
    return with_hits(rows)


def pair_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, terms: DataFrame, stats: DataFrame, names: tuple[str, ...] = PAIR_FEATURES, postings: DataFrame | None = None) -> DataFrame:
    """The pairs' own columns and the named features as floats."""
    rows = prepared(pairs, queries, docs, terms, stats, postings=postings)
    found = features()
    return rows.select(*pairs.columns, *[found[n].cast("float").alias(n) for n in names])


def checked_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs, failing where a document is unknown: the mandatory join."""
    known = docs.select("doc_id", F.lit(True).alias("_there"))
    missing = F.raise_error(F.concat(F.lit("unknown document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("boolean")
    return pairs.join(known, "doc_id", "left").where(F.when(F.col("_there"), F.lit(True)).otherwise(missing)).drop("_there").select(*pairs.columns)
