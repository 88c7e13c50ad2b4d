"""Families of features that others can add: values and conditions that must agree."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators.model import compare


class Family(ABC):
    """A named group of features: their values as Columns, and each of them compared with a border as a condition."""

    name: str
    features: tuple[str, ...]

    @abstractmethod
    def values(self) -> dict[str, Column]:
        """The value of every feature over the columns that the family reads."""

    def condition(self, feature: str, comparison: str, border: float) -> Column:
        """A condition that holds where the feature's value, in single precision, compares with the border. Override it with one that needs no value."""
        if feature not in self.features:
            raise KeyError(f"unknown feature {feature!r}")
        return compare(self.values()[feature].cast("float"), comparison, border)


class DocumentFamily(Family):
    """Features of a document; ``calculate`` gets title and body, null as empty."""

    @abstractmethod
    def calculate(self, title: Column, body: Column) -> Iterable[Column]: ...

    def values(self) -> dict[str, Column]:
        return dict(zip(self.features, self.calculate(T.text("title"), T.text("body")), strict=True))


class QueryFamily(Family):
    """Features of a query; ``calculate`` gets its text, null as empty."""

    @abstractmethod
    def calculate(self, query: Column) -> Iterable[Column]: ...

    def values(self) -> dict[str, Column]:
        return dict(zip(self.features, self.calculate(T.text("query")), strict=True))


class PairFamily(Family):
    """Features of a query and a document; ``calculate`` works on the columns of ``pair_features.prepared``."""

    @abstractmethod
    def calculate(self) -> Iterable[Column]: ...

    def values(self) -> dict[str, Column]:
        return dict(zip(self.features, self.calculate(), strict=True))


class Factor(ABC):
    """An older factor: a single value with a name, absent inputs giving 0."""

    name: str

    @abstractmethod
    def value(self) -> Column: ...

    def column(self) -> Column:
        return F.coalesce(self.value().cast("float"), F.lit(0.0).cast("float")).alias(self.name)


class DocumentFactor(Factor):
    """Over ``title`` and ``body``."""


class QueryFactor(Factor):
    """Over ``query``."""


class JointFactor(Factor):
    """Over the columns of ``pair_features.prepared``."""


class WordLengths(DocumentFamily):
    """Mean and greatest length of a body's words."""

    name, features = "WordLengths", ("doc_mean_word_length", "doc_longest_word")

    def calculate(self, title: Column, body: Column) -> Iterable[Column]:
        lengths = F.transform(T.words(body), lambda w: F.length(w))
        total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(lengths) == 0, F.lit(0.0)).otherwise(total / F.size(lengths)), F.coalesce(F.array_max(lengths), F.lit(0))


class TitleShare(DocumentFamily):
    """The share of the text that the title takes, with a condition that needs no division."""

    name, features = "TitleShare", ("doc_title_share",)

    def calculate(self, title: Column, body: Column) -> Iterable[Column]:
        whole = F.length(title) + F.length(body)
        return (F.when(whole == 0, F.lit(0.0)).otherwise(F.length(title) / whole),)


def with_families(rows: DataFrame, families: Iterable[Family]) -> DataFrame:
    """Rows with every family's features as floats; a name that two families share is an error."""
    found: dict[str, Column] = {}
    for family in families:
        for name, value in family.values().items():
            if name in found:
                raise ValueError(f"feature {name!r} is in two families")
            found[name] = value.cast("float")
    return rows.withColumns(found)


def disagreements(rows: DataFrame, families: Iterable[Family], borders: Iterable[float]) -> DataFrame:
    """``feature, comparison, border, met, differing``: how many rows meet each condition, and for how many it differs from the numeric comparison."""
    checks = []
    for family in families:
        for feature, value in family.values().items():
            for border in borders:
                for c in ("GT", "LT", "GE", "LE"):
                    checks.append(F.struct(F.lit(feature).alias("feature"), F.lit(c).alias("comparison"), F.lit(float(border)).alias("border"), family.condition(feature, c, border).alias("met"), compare(value.cast("float"), c, border).alias("numeric")))
    each = rows.select(F.explode(F.array(*checks)).alias("x")).select("x.*")
    return each.groupBy("feature", "comparison", "border").agg(F.count_if("met").alias("met"), F.count_if(F.col("met") != F.col("numeric")).alias("differing"))
