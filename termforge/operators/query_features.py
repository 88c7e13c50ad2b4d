"""The ten features of a query."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions.scores import log_plus_one
from termforge.plans.tables import join_sized

QUERY_FEATURES = ("QueryWordCount", "QueryNonDictionaryCount", "QueryVowelCount", "QueryConsonantCount", "QuerySpecialCharacterCount", "QueryNumberCount", "QueryNounCount", "QueryMinLogFrequency", "QueryMaxLogFrequency", "QueryMeanLogFrequency")
#: English words and endings that are no nouns, for the fallback without a tagging model.
NO_NOUNS = frozenset("the a an this that these those and or but if of in on at by for from with to as is are was were be been being am do does did have has had will would can could may might must shall should not no i you he she it we they me him her us them my your his its our their who what which when where why how there here very more most some any all each few many much".split())
NO_NOUN_ENDS = ("ly", "ing", "ed", "ous", "ful", "able", "ible", "ive", "ish", "less")


def text_features() -> dict[str, Column]:
    """Features that need no other table, over a column ``query``."""
    return {"QueryWordCount": T.word_count("query"), "QueryVowelCount": T.vowel_count("query"), "QueryConsonantCount": T.consonant_count("query"), "QuerySpecialCharacterCount": T.special_count("query"), "QueryNumberCount": T.number_count("query")}


def noun_count(query: Column | str, lexicon: dict[str, str] | None = None) -> Column:
    """Nouns of a query: words (runs of letters) whose tag starts with NN.

    ``lexicon`` maps lower-cased words to tags. Words outside it go by a small deterministic rule in place of a
    trained tagger: no function word, and no adverb, adjective or verb ending.
    """
    tags = lexicon or {}
    among = lambda words: F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")
    words = F.filter(F.regexp_extract_all(F.lower(T.text(query)), F.lit(r"[\p{L}\p{M}\p{Nl}\p{No}]+"), F.lit(0)), lambda w: w.rlike(r"^\p{L}+$"))
    rule = lambda w: ~F.array_contains(among(NO_NOUNS), w) & ~w.rlike(f"(?:{'|'.join(NO_NOUN_ENDS)})$")
    if not tags:
        return F.size(F.filter(words, rule))
    noun = lambda w: F.array_contains(among(w_ for w_, t in tags.items() if t.startswith("NN")), w) | ~F.array_contains(among(tags), w) & rule(w)
    return F.size(F.filter(words, noun))


def query_frequencies(queries: DataFrame, query: str = "query") -> DataFrame:
    """``word, n``: in how many of the rows each lower-cased word occurs (once per row)."""
    return queries.where(F.col(query).isNotNull()).select(F.explode(F.array_distinct(T.leading_split(query))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _joined_features(queries: DataFrame, dictionary: DataFrame, frequencies: DataFrame) -> DataFrame:
    lowered = F.filter(F.split(F.lower(T.control_trim("query")), r"\s+"), lambda x: (x != "") | (F.col("query") != ""))
    words = queries.select("query_id", F.explode(lowered).alias("word"))
    outside = join_sized(words, dictionary.select("word").distinct(), "word", "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("QueryNonDictionaryCount"))
    spoken = queries.where(T.control_trim("query") != "").select("query_id", F.explode(T.leading_split("query")).alias("word"))
    n = F.coalesce(F.col("n"), F.lit(0))
    rates = join_sized(spoken, frequencies, "word", "left").groupBy("query_id").agg(log_plus_one(F.min(n)).alias("QueryMinLogFrequency"), log_plus_one(F.max(n)).alias("QueryMaxLogFrequency"), log_plus_one(F.avg(n).cast("float")).alias("QueryMeanLogFrequency"))
    return queries.select("query_id").join(outside, "query_id", "left").join(rates, "query_id", "left")


def query_features(queries: DataFrame, dictionary: DataFrame, frequencies: DataFrame, lexicon: dict[str, str] | None = None, nouns: bool = True) -> DataFrame:
    """``query_id`` and the features as floats, in their fixed order; ``nouns=False`` leaves out the noun count.

    ``queries`` has unique ``query_id`` and ``query``; a blank query has one word outside the dictionary, an empty one none.
    """
    rows = queries.select("query_id", T.text("query").alias("query"))
    plain = rows.select("query_id", *[c.alias(n) for n, c in text_features().items()], *([noun_count("query", lexicon).alias("QueryNounCount")] if nouns else []))
    joined = plain.join(_joined_features(rows, dictionary, frequencies), "query_id")
    names: Iterable[str] = [n for n in QUERY_FEATURES if nouns or n != "QueryNounCount"]
    return joined.select("query_id", *[F.coalesce(F.col(n), F.lit(0)).cast("float").alias(n) for n in names])
