"""Scores as Columns. Single-precision steps are cast back to float, so results match single-precision arithmetic bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def _float(c: Column) -> Column:
    return c.cast("float")


def _lit(x: float) -> Column:
    return F.lit(x).cast("float")


def length_code(length: Column) -> Column:
    """A length as it survives a one-byte code: exact below 24, beyond that the four leading bits of what exceeds 24."""
    over = F.greatest(length.cast("int") - 24, F.lit(0))
    shift = F.greatest(F.length(F.bin(over)) - 4, F.lit(0)).cast("int")
    kept = (F.floor(over / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)).cast("int")
    return F.when(length < 24, length.cast("int")).otherwise(24 + kept)


def bm25_idf(docs: Column, df: Column) -> Column:
    """Float of ln(1 + (N - df + 0.5) / (df + 0.5)); N counts records with a term."""
    return _float(F.log(1 + (docs - df + 0.5) / (df + 0.5)))


def bm25_term(tf: Column, query_tf: Column, idf: Column, coded_length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """The contribution of one term in single precision: w - w / (1 + tf / norm), w = query tf * idf."""
    w = _float(_float(query_tf) * idf)
    norm = _float(_lit(k1) * _float(_float(_lit(1.0) - _lit(b)) + _float(_float(_lit(b) * _float(coded_length)) / _float(average))))
    inverse = _float(_lit(1.0) / norm)
    return _float(w - _float(w / _float(_lit(1.0) + _float(_float(tf) * inverse))))


def tfidf_idf(docs: Column, df: Column) -> Column:
    """ln(N + 1) for a term in no record, else ln((N + 1) / (df + 1)) + 1; N counts all records."""
    return F.when(df == 0, F.log(docs + 1.0)).otherwise(F.log((docs + 1.0) / (df + 1.0)) + 1.0)


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def log_plus_one(x: Column) -> Column:
    return _float(F.log(1.0 + x.cast("double")))


def pmi(together: Column, parts: list[Column], docs: Column) -> Column:
    """Positive pointwise mutual information of terms that stand together in ``together`` records; 0 if any count is 0."""
    product = _float(parts[0])
    for p in parts[1:]:
        product = _float(product * _float(p))
    any_zero = together == 0
    for p in parts:
        any_zero = any_zero | (p == 0)
    value = F.log(together.cast("double") * F.pow(docs.cast("double"), F.lit(float(len(parts) - 1))) / product.cast("double"))
    return F.when(any_zero, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), value))


def ratio_or_nan(a: Column, b: Column) -> Column:
    """a / b in single precision, NaN for b = 0 (the plain division of the older factors)."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b).cast("float")


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b).cast("float")
