"""Deterministic samples and cuts of ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.plans.tables import cut


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``_at``, the place from 1 in the group, and ``_n``, the group's size.

    Rows are range-partitioned by group and order, so a group of any size spreads over tasks; they are numbered within their
    partition and shifted by the group's rows in those before (one row per group and partition).
    """
    parts = cut(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = parts.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*group)
    before = F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("_n"))
    numbered = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return numbered.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_r")).alias("_at"), "_n")


def head_fraction(rows: DataFrame, group: list[str], order: list[str], fraction: float) -> DataFrame:
    """The first round(n * fraction) rows of each group, at least one."""
    kept = F.greatest(F.lit(1), F.least(F.col("_n"), F.round(F.col("_n") * fraction).cast("bigint")))
    return placed(rows, group, order).where(F.col("_at") <= kept).drop("_n", "_at")


def evenly_spaced(rows: DataFrame, group: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` rows of each group at the places floor(i * n / count), all where there are fewer."""
    step = F.greatest(F.col("_n") / F.lit(float(count)), F.lit(1.0))
    at = F.col("_at") - 1
    index = F.ceil(at / step)  # the least i whose place reaches this row
    chosen = (F.floor(index * step) == at) & (index < count)
    return placed(rows, group, order).where(chosen).drop("_n", "_at")


def first_per_group(rows: DataFrame, group: list[str], order: list[str], count: int) -> DataFrame:
    return placed(rows, group, order).where(F.col("_at") <= count).drop("_n", "_at")


def nonzero_count(vector: Column) -> Column:
    """How many values of a feature vector are not within 1e-4 of zero."""
    return F.size(F.filter(vector, lambda x: F.abs(x) >= 1e-4))


def best_query(pairs: DataFrame) -> DataFrame:
    """Per document the query with the best score (``bm25``), equal scores by query id."""
    return pairs.groupBy("doc_id").agg(F.min(F.struct((-F.col("bm25")).alias("s"), "query_id")).alias("x")).select("doc_id", F.col("x.query_id").alias("query_id"), (-F.col("x.s")).alias("bm25"))


def above_both(pairs: DataFrame, first: str, second: str, border: float = 0.4) -> DataFrame:
    """The pairs whose two features both lie above the border."""
    return pairs.where((F.col(first) > F.lit(border)) & (F.col(second) > F.lit(border)))


def sorted_batches(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """Rows in descending order within each partition only: batches are sorted, the whole is not."""
    return rows.sortWithinPartitions(F.desc(by), tie)
