"""The twelve features of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions.scores import ratio_or_zero
from termforge.plans.tables import cut, fits_broadcast

DOCUMENT_FEATURES = ("doc_word_count", "doc_title_non_dictionary_count", "doc_body_non_dictionary_count", "doc_non_dictionary_ratio", "doc_non_dictionary_ratio_count", "doc_vowel_count", "doc_special_character_count", "doc_title_number_count", "doc_body_number_count", "doc_paragraph_count", "doc_size_kbyte", "doc_has_url")
TOKENIZATIONS = {"whitespace": T.words, "unicode": T.unicode_words}


def text_features() -> dict[str, Column]:
    """The features that need no dictionary, over columns ``title`` and ``body``."""
    return {
        "doc_word_count": T.word_count("title") + T.word_count("body"),
        "doc_vowel_count": T.vowel_count("body"),
        "doc_special_character_count": T.special_count("title") + T.special_count("body"),
        "doc_title_number_count": T.number_count("title"),
        "doc_body_number_count": T.number_count("body"),
        "doc_paragraph_count": T.paragraph_count("body"),
        "doc_size_kbyte": T.kilobytes("title", "body"),
        "doc_has_url": T.has_url("title", "body"),
    }


def dictionary_features(docs: DataFrame, dictionary: DataFrame, counts: str = "whitespace", ratio: str = "unicode") -> DataFrame:
    """``doc_id`` and the four counts of words outside a dictionary (column ``word``, lower-cased).

    A dictionary of a size that allows it goes to every task, where words are looked up one by one and only counts are shuffled; beside a
    larger one words are counted per document and text first and then joined. Same result either way. Documents without words have zeros.
    """

    def of(kind: str, source: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.lower(t).alias("word")))

    tokens = F.concat(*[of(kind, source, TOKENIZATIONS[name](source)) for kind, name in (("count", counts), ("ratio", ratio)) for source in ("title", "body")])
    words = docs.select("doc_id", F.explode(tokens).alias("x")).select("doc_id", "x.*")
    known = cut(dictionary.select(F.col("word")).distinct(), "dictionary").withColumn("known", F.lit(True))
    if fits_broadcast(known):
        looked = words.join(F.broadcast(known), "word", "left").withColumn("n", F.lit(1))
    else:
        looked = words.groupBy("doc_id", "kind", "source", "word").agg(F.count(F.lit(1)).alias("n")).join(known, "word", "left")
    unknown = F.when(F.col("known").isNull(), F.col("n")).otherwise(0)
    total = lambda kind, source, value: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("source").isin(*source)), value)), F.lit(0))
    found = looked.groupBy("doc_id").agg(
        total("count", ["title"], unknown).alias("doc_title_non_dictionary_count"),
        total("count", ["body"], unknown).alias("doc_body_non_dictionary_count"),
        total("ratio", ["title", "body"], unknown).alias("doc_non_dictionary_ratio_count"),
        total("ratio", ["title", "body"], F.col("n")).alias("_all"),
    )
    names = [c for c in found.columns if c != "doc_id"]
    whole = docs.select("doc_id").join(found, "doc_id", "left").fillna(0, names)
    return whole.withColumn("doc_non_dictionary_ratio", ratio_or_zero(F.col("doc_non_dictionary_ratio_count"), F.col("_all"))).drop("_all")


def document_features(docs: DataFrame, dictionary: DataFrame, counts: str = "whitespace", ratio: str = "unicode") -> DataFrame:
    """``doc_id`` and all twelve features as floats, in their fixed order."""
    plain = docs.select("doc_id", *[c.alias(n) for n, c in text_features().items()])
    joined = plain.join(dictionary_features(docs, dictionary, counts, ratio), "doc_id")
    return joined.select("doc_id", *[F.col(n).cast("float").alias(n) for n in DOCUMENT_FEATURES])
