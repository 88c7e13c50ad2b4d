"""Text functions as Columns: tokenizers, cleaners, counts. Null text counts as empty everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates whitespace tokens (blanks that allow a line break, and the separator controls).
WHITESPACE = r"[\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]+"
#: Longer tokens are cut into pieces of this many characters.
LONGEST_TOKEN = 255
#: Stop words of the stemming tokenizer.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
NUMBER = r"\b\d+(?:\.\d+)?\b"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _no_empty(tokens: Column) -> Column:
    return F.array_remove(tokens, "")


def control_trim(c: Column | str) -> Column:
    """Strips every character up to the blank from both ends."""
    return F.regexp_replace(text(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def whitespace_tokens(c: Column | str) -> Column:
    """Tokens between blanks, case and punctuation kept; tokens over 255 characters in pieces; blank text has none."""
    tokens = _no_empty(F.split(text(c), WHITESPACE))
    pieces = F.flatten(F.transform(tokens, lambda t: F.when(F.length(t) <= LONGEST_TOKEN, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(r"(?s).{1,255}"), F.lit(0)))))
    return F.when(text(c).rlike(r"\S{256}"), pieces).otherwise(tokens)


def words(c: Column | str) -> Column:
    """``control_trim`` and split at blanks; blank text has none."""
    return _no_empty(F.split(control_trim(c), r"\s+"))


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def leading_split(c: Column | str) -> Column:
    """Lower-cased split at blanks that keeps a leading empty token and drops trailing ones."""
    return F.split(F.regexp_replace(F.lower(text(c)), r"\s+$", ""), r"\s+")


def unicode_words(c: Column | str) -> Column:
    """Lower-cased runs of Unicode word characters."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def ascii_words(c: Column | str) -> Column:
    """Lower-cased, everything but ASCII letters, digits and blanks made a blank, split."""
    return _no_empty(F.split(F.trim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", " ")), r"\s+"))


def ascii_words_with_empty(c: Column | str) -> Column:
    """``ascii_words``, but text without any such word is one empty token."""
    found = ascii_words(c)
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def ascii_word_set(c: Column | str) -> Column:
    """Distinct ``ascii_words`` with apostrophes removed first."""
    return F.array_distinct(ascii_words(F.regexp_replace(text(c), "'", "")))


def stem(token: Column) -> Column:
    """The first suffix of ies, es, s, ing, ed is taken off words of more than three letters (ies becomes y)."""
    longer = F.length(token) > 3
    without = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    return (
        F.when(longer & token.endswith("ies"), F.concat(without(3), F.lit("y")))
        .when(longer & token.endswith("es"), without(2))
        .when(longer & token.endswith("s"), without(1))
        .when(longer & token.endswith("ing"), without(3))
        .when(longer & token.endswith("ed"), without(2))
        .otherwise(token)
    )


def stemmed_words(c: Column | str) -> Column:
    """``ascii_words`` without stop words, stemmed."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(ascii_words(c), lambda x: ~F.array_contains(stop, x)), stem)


def without_punctuation(c: Column | str) -> Column:
    """Runs of ASCII punctuation become one blank; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\p{Punct}+", " ")


def without_operators(c: Column | str) -> Column:
    """The query operators OR, AND, NOT and TO, as whole upper-case tokens, are dropped; inner double blanks stay, trailing ones go."""
    column = F.col(c) if isinstance(c, str) else c
    tokens = F.filter(F.split(F.regexp_replace(column, r"\s+$", ""), r"\s"), lambda x: ~x.isin("OR", "AND", "NOT", "TO"))
    return F.array_join(tokens, " ")


def query_tokens(c: Column | str) -> Column:
    """Tokens of a cleaned query: punctuation and operators removed, split at blanks."""
    return whitespace_tokens(without_operators(without_punctuation(text(c))))


def standard_tokens(c: Column | str) -> Column:
    """Tokens of standard analysis: lower-cased runs of letters, marks and digits (inner apostrophes, dots and commas between like characters kept), without stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    runs = F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{M}]+(?:['’.][\p{L}\p{M}]+)*[\p{L}\p{M}\p{Nd}]*|\p{Nd}+(?:[.,]\p{Nd}+)*[\p{L}\p{M}\p{Nd}]*"), F.lit(0))
    return F.filter(runs, lambda x: ~F.array_contains(stop, x))


def json_field(c: Column | str, name: str) -> Column:
    """The string value of a field cut out of a line of JSON without parsing the rest; null where there is none."""
    found = F.regexp_extract(text(c), rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    return F.when(text(c).rlike(rf'"{name}"\s*:\s*"'), found)


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(text(c), F.lit(pattern))


def number_count(c: Column | str) -> Column:
    return count_matches(c, NUMBER)


def vowel_count(c: Column | str) -> Column:
    return count_matches(c, "[aeiouAEIOU]")


def consonant_count(c: Column | str) -> Column:
    """ASCII letters but a, e, i, o, u; y counts as a consonant."""
    return count_matches(c, "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]")


def special_count(c: Column | str) -> Column:
    """Characters that are no ASCII letters, digits or blanks, in UTF-16 units (a character beyond the basic plane counts twice)."""
    rest = F.regexp_replace(text(c), r"[a-zA-Z0-9\s]+", "")
    return F.length(rest) + F.regexp_count(rest, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def kilobytes(title: Column | str, body: Column | str) -> Column:
    """UTF-8 size of title and body in units of 1024 bytes, as float."""
    return (F.octet_length(F.concat(text(title), text(body))).cast("float") / F.lit(1024.0).cast("float")).cast("float")


def paragraph_count(c: Column | str) -> Column:
    """Non-blank parts between blank lines."""
    parts = F.split(control_trim(c), r"\n\s*\n")
    return F.size(F.filter(parts, lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "") != ""))


def has_url(title: Column | str, body: Column | str) -> Column:
    """1 if title and body, joined without a separator, hold http://, https:// or www., else 0, as float."""
    return F.concat(text(title), text(body)).rlike(r"https?://|www\.").cast("float")


def ngrams(tokens: Column, n: int) -> Column:
    """The token n-grams, each joined by a blank, in order."""
    last = F.size(tokens) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def shard_of(docid: Column | str) -> Column:
    """The shard number in ids like ``name_07_000123``; null where there is none."""
    found = F.regexp_extract(F.col(docid) if isinstance(docid, str) else docid, r"^[^_]+_(\d{2})_", 1)
    return F.when(found != "", found.cast("int"))


def preview(c: Column | str, most: int = 80) -> Column:
    """Blanks collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def csv_field(c: Column | str) -> Column:
    """A field of a comma-separated file: quoted, with doubled quotes, where it holds a comma, quote or line end."""
    column = text(c)
    return F.when(column.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(column)
