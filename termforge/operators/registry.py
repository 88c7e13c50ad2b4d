"""All features in their fixed order, by family, and extraction of whole feature vectors for pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.scores import sigmoid
from termforge.operators.document_features import document_features
from termforge.operators.index import Index
from termforge.operators.pair_features import pair_features
from termforge.operators.query_features import query_features
from termforge.operators.ranking import Packed
from termforge.operators.retrieval import top_scores

#: Fixed values: (family, its features), in the order of the columns.
FAMILIES: list[tuple[str, tuple[str, ...]]] = [
    ("QueryWords", ("QueryWordCount", "QueryNonDictionaryCount")),
    ("QueryCharacters", ("QueryVowelCount", "QueryConsonantCount", "QuerySpecialCharacterCount")),
    ("QueryNumbers", ("QueryNumberCount",)),
    ("QueryNouns", ("QueryNounCount",)),
    ("QueryFrequency", ("QueryMinLogFrequency", "QueryMaxLogFrequency", "QueryMeanLogFrequency")),
    ("DocumentWords", ("doc_word_count", "doc_title_non_dictionary_count", "doc_body_non_dictionary_count", "doc_non_dictionary_ratio", "doc_non_dictionary_ratio_count")),
    ("DocumentCharacters", ("doc_vowel_count", "doc_special_character_count")),
    ("DocumentNumbers", ("doc_title_number_count", "doc_body_number_count")),
    ("DocumentParagraphs", ("doc_paragraph_count",)),
    ("DocumentSize", ("doc_size_kbyte",)),
    ("DocumentUrls", ("doc_has_url",)),
    ("JointBM25", ("BM25Score",)),
    ("TFIDF", ("TFIDFScore",)),
    ("ExactMatch", ("ExactMatchRatio", "ExactMatchCount")),
    ("TitleExactMatch", ("TitleExactMatchRatio", "TitleExactMatchCount")),
    ("UnorderedWindow", ("BigramCount", "TrigramCount", "UnorderedWindow4", "UnorderedWindow8")),
    ("BM25TopScores", ("BM25Top1Score", "BM25Top2Score", "BM25Top3Score")),
]
FEATURES: list[tuple[str, str]] = [(name, family) for family, names in FAMILIES for name in names]


def described() -> list[dict]:
    """Place, name and family of every feature."""
    return [{"index": i, "name": n, "family": f} for i, (n, f) in enumerate(FEATURES)]


def all_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, index: Index, dictionary: DataFrame, frequencies: DataFrame, query_dictionary: DataFrame | None = None, nouns: bool = True, packed: Packed | None = None) -> DataFrame:
    """Pairs (``query_id, doc_id`` and other columns) with all features as floats, in order; ``nouns=False`` leaves out the noun count.

    Features of a query or a document alone are worked out once per query or document and joined, not once per pair. Top scores are those over ``packed``,
    or over the documents of the index.
    """
    found = pair_features(pairs, queries, docs, index.terms, index.stats, postings=index.postings)
    found = found.join(query_features(queries, query_dictionary if query_dictionary is not None else dictionary, frequencies, nouns=nouns), "query_id")
    found = found.join(top_scores(queries, packed or index), "query_id").join(document_features(docs, dictionary), "doc_id")
    return found.select(*pairs.columns, *[n for n, _ in FEATURES if nouns or n != "QueryNounCount"])


def checked(rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """The rows, failing where a feature is null or not finite."""
    bad = None
    for n in names:
        wrong = F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf"))
        bad = wrong if bad is None else bad | wrong
    return rows.where(F.when(bad, F.raise_error(F.lit("a feature is not finite")).cast("boolean")).otherwise(F.lit(True)))


def vector(names: Iterable[str]) -> Column:
    """The named features as one array of floats."""
    return F.array(*[F.col(n).cast("float") for n in names])


def joined_vector(*vectors: Column | str) -> Column:
    return F.concat(*[F.col(v) if isinstance(v, str) else v for v in vectors])


def predicted(rows: DataFrame, names: list[str], predict: Callable[[pd.DataFrame], pd.Series], output: str = "probability") -> DataFrame:
    """Rows with the sigmoid of any model's raw prediction, over Arrow batches; ``predict`` maps the feature columns to raw values."""

    @F.pandas_udf("double")
    def raw(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(predict(columns), dtype="float64")

    return rows.withColumn(output, sigmoid(raw(F.struct(*[F.col(n).alias(n) for n in names]))))
