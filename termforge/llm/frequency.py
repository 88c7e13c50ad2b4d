"""Problem 6: occurrences and records of every term of a collection, and which terms are too rare or too common.

Last-seen counters: tokens pass through a counter table in record order; each term stores its occurrences, its
records and the record that it was last seen in, so no set of terms is kept per record. A table is flushed to
partial counts at a record's end when it grows past ``TABLE_TERMS``; partial counts are summed by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.words import TERM, slices
from termforge.plans.tables import cut, join_sized

#: A counter table is flushed at the next record's end beyond this many terms, which bounds a task's memory.
TABLE_TERMS = 300_000
#: The key under which the number of records with at least one term is counted; no term is empty.
ALL = ""
_PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


class LastSeen:
    """The counters of one partition; ``add`` takes the tokens of one record (or of the next piece of it)."""

    def __init__(self) -> None:
        self.table: dict[str, list] = {}

    def add(self, record: object, tokens: list[str], weights: list[int] | None = None) -> None:
        table = self.table
        if tokens:
            tokens, weights = [*tokens, ALL], [*weights, 0] if weights else weights
        for i, token in enumerate(tokens):
            n = weights[i] if weights else 1
            seen = table.get(token)
            if seen is None:
                table[token] = [n, 1, record]
            else:
                seen[0] += n
                if seen[2] != record:
                    seen[1] += 1
                    seen[2] = record

    def flush(self) -> pa.RecordBatch:
        table, self.table = self.table, {}
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array([x[0] for x in table.values()], pa.int64()), pa.array([x[1] for x in table.values()], pa.int64())], schema=_PARTIAL)


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters, record = LastSeen(), 0
    for _, texts in slices(batches, 0):
        for text in texts:
            if text:
                record += 1
                counters.add(record, TERM.findall(text.lower() if text.isascii() else _ascii_lower(text)))
                if len(counters.table) > TABLE_TERMS:
                    yield counters.flush()
    if counters.table:
        yield counters.flush()


def _ascii_lower(text: str) -> str:
    """Lower-cases A-Z only: lower() turns some other letters into ASCII ones."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = LastSeen()
    for batch in batches:
        last = object()
        for record, term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if record != last and len(counters.table) > TABLE_TERMS:
                yield counters.flush()
            last = record
            counters.add(record, [term], [n])
    if counters.table:
        yield counters.flush()


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def text_term_counts(df: DataFrame, text: str) -> DataFrame:
    """``term, occurrences, records`` over a table with one record per row; terms are runs of at least three ASCII letters, lower-cased.

    The row with the empty term holds in ``records`` how many records have a term. Null, empty and blank texts hold
    no term; an empty table gives no row. A record is whole in its row, so partitions count independently and only
    partial counts (at most the vocabulary per task) are shuffled. Columns other than ``text`` are not read.
    """
    partial = df.select(F.col(text).alias("text")).mapInArrow(_count_texts, "term string, occurrences bigint, records bigint")
    return _summed(partial)


def value_pairs(df: DataFrame, record: str, value: str) -> DataFrame:
    """``record, term, n`` of a table with many rows per record: the values without blanks and tabs around, lower-cased, as terms.

    Null values, values that are empty after trimming and null records give none. Combines before the shuffle, so a record with a third
    of all rows shuffles at most its distinct terms per task.
    """
    term = F.lower(F.regexp_replace(F.col(value), "^[ \\t]+|[ \\t]+$", ""))
    named = df.select(F.col(record).alias("record"), term.alias("term"))
    return named.where("record is not null and term <> ''").groupBy("record", "term").agg(F.count(F.lit(1)).alias("n"))


def value_term_counts(pairs: DataFrame) -> DataFrame:
    """``text_term_counts`` of ``record, term, n`` rows: hash-partitioned and ordered by record, then counted with last-seen counters.

    The rows are combined by record and term before (``value_pairs``), as one record may hold a third of all occurrences and would
    gather in one task; so a term comes once per record here, and the last-seen test holds for rows that are not combined.
    """
    ordered = pairs.select("record", "term", "n").repartition("record").sortWithinPartitions("record")
    partial = ordered.mapInArrow(_count_values, "term string, occurrences bigint, records bigint")
    return _summed(partial)


def marked(counts: DataFrame, common_percent: float, rare_below: int = 3) -> DataFrame:
    """Adds ``mark``: ``common`` if 100 * records > common_percent * all records, else ``rare`` if records < rare_below, else null.

    ``counts`` is one of the tables above; the row of the empty term is taken out. The counts are cut to a table
    first, as two passes read them.
    """
    counts = cut(counts, "term-counts")
    total = counts.where(F.col("term") == ALL).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("all_records"))
    mark = F.when(100 * F.col("records") > F.lit(common_percent) * F.col("all_records"), "common").when(F.col("records") < rare_below, "rare")
    return counts.where(F.col("term") != ALL).crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))


def usable_terms(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``record, term, n`` whose term has no mark; the marked terms are broadcast only if they are few."""
    return join_sized(pairs, marks.where("mark is not null").select("term"), "term", "left_anti")
