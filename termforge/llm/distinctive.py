"""Problem 5: how much each term marks its record against the whole collection.

Weight of a term: idf(df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)); with ``k1`` None the
term frequency does not saturate and the weight is idf(df) * tf. ``idf`` is ``probabilistic``,
ln(1 + (N - df + 0.5) / (df + 0.5)), or ``plain``, ln(N / df).

The document frequencies are split by size. Terms in at least a share of the records are the head; as each of them
takes that share of all (record, term) pairs, there are at most ``HEAD_TERMS`` of them at any size of the table, and they
go to every task. The pairs of all other terms, a small rest, are joined by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm.frequency import ALL, _ascii_lower, text_term_counts, value_term_counts
from termforge.llm.words import TERM, slices
from termforge.plans.tables import cut

#: A term with fewer than this share of the records is never in the head.
HEAD_SHARE = 1e-3
#: The head has at most this many terms; with longer records the share above rises accordingly.
HEAD_TERMS = 200_000


@dataclass(frozen=True)
class Weighting:
    k1: float | None = 1.2
    b: float = 0.75
    idf: str = "probabilistic"

    def column(self, n: Column, df: Column, length: Column, records: int, average: float) -> Column:
        records_ = F.lit(float(records))
        idf = F.log(records_ / df) if self.idf == "plain" else F.log(1 + (records_ - df + 0.5) / (df + 0.5))
        if self.k1 is None:
            return n * idf
        return idf * n * (self.k1 + 1) / (n + self.k1 * (1 - self.b + self.b * length / F.lit(average)))

    def idf_of(self, df: int, records: int) -> float:
        return math.log(records / df) if self.idf == "plain" else math.log(1 + (records - df + 0.5) / (df + 0.5))


#: n * ln(N / df), neither saturating nor length-normalised.
PLAIN = Weighting(k1=None, b=0.0, idf="plain")


def _candidates(idf: dict[str, float], weighting: Weighting, average: float, top: int):
    """For Arrow batches of (record, text): (record, term, n, length) of head terms near the top by weight and of every term outside the head."""
    k1, b = weighting.k1, weighting.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            rows, terms, counts, lengths = [], [], [], []
            for row, text in enumerate(texts):
                if not text:
                    continue
                found = Counter(TERM.findall(text.lower() if text.isascii() else _ascii_lower(text)))
                length = sum(found.values())
                norm = 0.0 if k1 is None else k1 * (1 - b + b * length / average)
                scored = []
                for term, n in found.items():
                    weight = idf.get(term)
                    if weight is None:
                        rows.append(row)
                        terms.append(term)
                        counts.append(n)
                        lengths.append(length)
                    elif weight > 0:
                        scored.append((weight * n if k1 is None else weight * n * (k1 + 1) / (n + norm), term, n))
                # all that may tie with the last place after rounding to six digits
                least = sorted((x[0] for x in scored), reverse=True)[:top][-1] - 2e-6 if scored else 0
                for score, term, n in scored:
                    if score >= least:
                        rows.append(row)
                        terms.append(term)
                        counts.append(n)
                        lengths.append(length)
            record = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([record, pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], names=["record", "term", "n", "length"])

    return run


def _split(counts: DataFrame) -> tuple[DataFrame, int, float, int]:
    """The cut counts, the number of records, the average length and the least df of a head term."""
    counts = cut(counts, "term-counts")
    row = counts.agg(F.sum(F.when(F.col("term") == ALL, F.col("records"))).alias("n"), F.sum(F.when(F.col("term") != ALL, F.col("occurrences"))).alias("tokens"), F.sum(F.when(F.col("term") != ALL, F.col("records"))).alias("pairs")).first()
    records = row["n"] or 0
    head = max(HEAD_SHARE * records, (row["pairs"] or 0) / HEAD_TERMS, 1)
    return counts.where(F.col("term") != ALL), records, (row["tokens"] or 0) / max(records, 1), math.ceil(head)


def _top(scored: DataFrame, top: int, record_type: str) -> DataFrame:
    """The ``top`` terms per record by score, equal scores by term."""
    kept = scored.where("score > 0")
    if top == 1:
        best = kept.groupBy("record").agg(F.min(F.struct((-F.col("score")).alias("s"), "term", "n", "records")).alias("x"))
        return best.select("record", F.col("x.term").alias("term"), F.col("x.n").alias("n"), F.col("x.records").alias("records"), (-F.col("x.s")).alias("score"), F.lit(1).alias("place"))
    # candidates per record are few: the head's near-top terms and the record's rare terms
    best = kept.groupBy("record").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term", "n", "records"))).alias("x"))
    return best.select("record", F.posexplode(F.slice("x", 1, top))).select("record", F.col("col.term").alias("term"), F.col("col.n").alias("n"), F.col("col.records").alias("records"), (-F.col("col.s")).alias("score"), (F.col("pos") + 1).alias("place"))


def distinctive_terms(df: DataFrame, record: str, text: str, weighting: Weighting = Weighting(), top: int = 1, least_records: int = 2) -> DataFrame:
    """``record, term, n, records, score, place``: the ``top`` terms of each record by weight, of a table with one record per row.

    Terms in fewer than ``least_records`` records and scores of 0 or less are left out; scores are rounded to six
    digits, and equal scores go by term. Records without a term (null, empty, blank) and null records give no row;
    an empty table gives none. Two rows of one record count as two records: make rows unique first.
    """
    source = df.select(F.col(record).alias("record"), F.col(text).alias("text")).where("record is not null")
    counts, records, average, head_df = _split(text_term_counts(source, "text"))
    head = {r["term"]: weighting.idf_of(r["records"], records) for r in counts.where((F.col("records") >= head_df) & (F.col("records") >= least_records)).select("term", "records").toLocalIterator()}
    kind = source.schema["record"].dataType.simpleString()
    # cut, as the head's terms and the others are joined apart and the texts must not be read for each
    found = cut(source.mapInArrow(_candidates(head, weighting, average, top), f"record {kind}, term string, n bigint, length bigint"), "term-candidates")
    return _top(_scored(found, counts, head_df, least_records, weighting, records, average), top, kind)


def _scored(pairs: DataFrame, counts: DataFrame, head_df: int, least_records: int, weighting: Weighting, records: int, average: float) -> DataFrame:
    """Pairs with their term's records and score; the head's counts are broadcast (bounded, see above), the others joined by shuffle."""
    usable = counts.where(F.col("records") >= least_records).select("term", "records")
    head, rest = F.broadcast(usable.where(F.col("records") >= head_df)), usable.where(F.col("records") < head_df)
    known = pairs.join(head, "term", "left")
    joined = known.where("records is not null").unionByName(pairs.join(head, "term", "left_anti").join(rest.hint("shuffle_merge"), "term").select(known.columns))
    score = F.round(weighting.column(F.col("n"), F.col("records"), F.col("length"), max(records, 1), max(average, 1e-9)), 6)
    return joined.withColumn("score", score)


def distinctive_values(pairs: DataFrame, weighting: Weighting = Weighting(), top: int = 1, least_records: int = 2) -> DataFrame:
    """``distinctive_terms`` of a table of ``record, term, n`` rows, one per record and term (see ``frequency.value_pairs``)."""
    pairs = cut(pairs.select("record", "term", "n"), "term-pairs")
    counts, records, average, head_df = _split(value_term_counts(pairs))
    if weighting.k1 is None:
        sized = pairs.withColumn("length", F.lit(0).cast("bigint"))
    else:
        sized = pairs.join(pairs.groupBy("record").agg(F.sum("n").alias("length")), "record")
    return _top(_scored(sized, counts, head_df, least_records, weighting, records, average), top, "string")
